"""Exact Jaccard join of shingle sets, with skipping by set relations; its classes of linked documents.

A document's set holds the hashes of its distinct runs of five words. Documents with equal sets
are one node from the start. The join works in these steps, none of which drops a link:

1. Sets are ordered by hash. Two linked sets share at least ``slack`` of the first tokens of both.
   Tokens are counted over all sets; a set with too few shared tokens among its first has no link.
   Of those left, the same count over whole sets leaves the ones that can have a link at all.
2. The tokens of the remaining sets are put in order of their frequency, and an index lists the
   sets of each of the rarest. Linked sets meet in at least one list.
3. Every set is compared with the least set of each of its lists. That gives links, and families:
   sets that are similar, linked or not.
4. The lists are cut into blocks, one for each family, with bounds of size and of position. A set
   skips every block whose bounds rule a link out. For a family that it does not skip, the answers
   of its least set are computed, and those of the others derived from them by the few tokens in
   which they differ. Inside a family, only sets outside its largest class are compared.

Classes are the connected components of the links. Nothing is compared whose class is already the
same, so that large groups of near copies don't need all their pairs.

Contract: lower-cased (A-Z) words are runs without space, tab and line ends; a text with fewer than
five words is one shingle; without words (or null) the set is empty and linked with nothing. Hashes
have 64 bits. Repeated rows and null keys are documents like others; the smallest key of a class
disregards nulls. Other columns stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from almanac.llm import text as T
from almanac.llm.graph import components
from almanac.sources.sinks import stored

SHINGLE = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
# Sets this similar to the least set of a list are of its family.
FAMILY_PERCENT = 50
# Most tokens that a task holds before it hands them on, and most sets of a family in one task.
FLUSH_TOKENS = 1_500_000
FAMILY_SETS = 2_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    words = T.words_of(texts)
    h = words.hashes()
    runs = T.windows(h, size)
    out = []
    for a, z in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if z - a >= size:
            x = np.sort(runs[a : z - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif z > a:
            out.append(np.array([T.combine(h[a:z])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """The least intersection of a set of n with any set that it is linked with."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """How many shared tokens the beginnings of two linked sets are extended to hold. More of them
    rule out more sets that only share a passage, and take more tokens to the first step."""
    return max(1, n // 8)


def beginning(n: int, percent: int) -> int:
    """How many first tokens of a set hold at least ``slack`` tokens of every set linked with it."""
    return n - least_overlap(n, percent) + slack(n)


def slack_sql(n: str, percent: int) -> Column:
    """The fewest tokens that the beginnings of a set of n and of any linked set share."""
    return F.expr(f"greatest(1L, (({percent} * {n} + 99) div 100) div 8)")


def least_sql(n: str, percent: int) -> Column:
    return F.expr(f"({percent} * {n} + 99) div 100")


def _spread(frame: DataFrame, key_kind: str, read: Callable, buckets: int) -> DataFrame:
    """Rows of documents (bucket below 0: key, n, node) and of tokens by bucket (tokens, nodes).
    ``read`` takes a batch and gives pieces of it: keys, set sizes, nodes, and each node's tokens.
    A token that several sets of a task share is handed on once, without a node, and counted on
    the spot (rows with a node and a count)."""
    ddl = f"bucket int, key {key_kind}, n long, node long, shared long, tokens binary, nodes binary"
    schema = T.arrow_schema(ddl)

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f in schema], schema=schema
        )

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        # Copies of a set count once.
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
        tokens, nodes = tokens[new], nodes[new]
        first = np.r_[True, tokens[1:] != tokens[:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(tokens)])
        shared = np.repeat(size > 1, size)
        who, times = np.unique(nodes[shared], return_counts=True)
        if len(who):
            yield rows(bucket=-1 - (who % buckets), node=who, shared=times)
        nodes = np.where(shared, 0, nodes)[first]
        tokens = tokens[first]
        bucket = (tokens >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        short, nodes = tokens[order].astype(np.uint32), nodes[order]
        used = np.flatnonzero(np.diff(cuts))
        yield rows(
            bucket=used,
            tokens=[short[cuts[i] : cuts[i + 1]].tobytes() for i in used],
            nodes=[nodes[cuts[i] : cuts[i + 1]].tobytes() for i in used],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            for keys, sizes, nodes, tokens in read(batch):
                if keys is not None:
                    yield rows(bucket=-1 - (nodes % buckets), key=keys, n=sizes, node=nodes)
                for x, node in zip(tokens, nodes.tolist(), strict=True):
                    if len(x):
                        held.append((x, np.full(len(x), node)))
                        total += len(x)
                if total > FLUSH_TOKENS:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return frame.mapInArrow(run, ddl)


def _counted(frame: DataFrame, key_kind: str, read: Callable) -> DataFrame:
    """Documents (key, n, node) and counts (node, shared): how many tokens of a set other sets also
    hold. A count may be too high where hashes cut to fewer bits meet."""
    width = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = 4 * width, max(1, width // 4)
    spread = _spread(frame, key_kind, read, buckets)
    ddl = f"part int, key {key_kind}, n long, node long, shared long, nodes binary, counts binary"
    schema = T.arrow_schema(ddl)

    def count(table: pa.Table) -> pa.Table:
        """The counts of a bucket, packed for each part of the nodes."""
        if table.column("bucket")[0].as_py() < 0:
            part = pa.array(table.column("node").to_numpy() % parts, pa.int32())
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table([part, *[table.column(c) for c in ("key", "n", "node", "shared")], none, none], schema=schema)
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("tokens")])
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("nodes")])
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
        # A token that was shared within a task stands with node 0, and counts for all others too.
        several = np.r_[False, (tokens[1:] == tokens[:-1])] & new | (nodes == 0)
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        shared = np.repeat(np.logical_or.reduceat(several, first), np.diff(np.r_[first, len(tokens)]))
        who, times = np.unique(nodes[shared & new & (nodes != 0)], return_counts=True)
        part = who % parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        who, times = who[order], times[order].astype(np.int64)
        used = np.flatnonzero(np.diff(cuts))
        pack = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary())
        none = [pa.nulls(len(used), f.type) for f in list(schema)[1:5]]
        return pa.table([pa.array(used, pa.int32()), *none, pack(who), pack(times)], schema=schema)

    out = f"key {key_kind}, n long, node long, shared long"
    out_schema = T.arrow_schema(out)

    def total(table: pa.Table) -> pa.Table:
        """The documents of a part, and one count for each of its nodes."""
        documents = table.filter(pc.is_valid(table.column("n"))).select(["key", "n", "node", "shared"])
        single = table.filter(pc.is_valid(table.column("shared")))
        packed = table.filter(pc.is_valid(table.column("nodes")))
        unpack = lambda c: [np.frombuffer(x.as_buffer(), np.int64) for x in packed.column(c)]
        who = np.concatenate([single.column("node").to_numpy(), *unpack("nodes")])
        times = np.concatenate([single.column("shared").to_numpy(), *unpack("counts")])
        node, at = np.unique(who, return_inverse=True)
        n = len(node)
        counts = [pa.nulls(n, out_schema.field("key").type), pa.nulls(n, pa.int64()), pa.array(node, pa.int64()), pa.array(np.bincount(at, times, n), pa.int64(), safe=False)]
        return pa.concat_tables([documents.cast(out_schema), pa.table(counts, schema=out_schema)])

    return spread.groupBy("bucket").applyInArrow(count, ddl).groupBy("part").applyInArrow(total, out)


def _seen(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """All documents, and the counts of the beginnings of their sets."""
    frame = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for piece in T.pieces(batch):
            sets = shingle_sets(piece.column(1))
            nodes = np.array([node_of(x) if len(x) else 0 for x in sets], np.int64)
            yield piece.column(0), [len(x) for x in sets], nodes, [x[: beginning(len(x), percent)] for x in sets]

    return stored(_counted(frame, frame.schema["key"].dataType.simpleString(), read), "seen")


def _supported(sets: DataFrame, percent: int) -> DataFrame:
    """The sets of which enough tokens occur in other sets, too, for a link."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield None, None, part.column(0).to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]

    counts = _counted(sets.select("node", "tokens"), "long", read).groupBy("node").agg(F.sum("shared").alias("shared"))
    enough = counts.join(sets.select("node", "n"), "node").where(100 * F.col("shared") >= percent * F.col("n")).select("node")
    return stored(sets.join(enough, "node"), "sets")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, n, tokens) of the wanted (key, node)."""
    frame = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    both = frame.join(wanted.select(F.col("key").alias("wanted"), "node"), F.col("key").eqNullSafe(F.col("wanted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "text"):
                sets = shingle_sets(piece.column(0))
                # Another text under the same key is not the one that is wanted.
                made = [(w, x) for w, x in zip(piece.column(1).to_pylist(), sets, strict=True) if len(x) and node_of(x) == w]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in made], pa.int64()), pa.array([len(x) for _, x in made], pa.int64()), pa.array([x.tobytes() for _, x in made], pa.binary())],
                    names=["node", "n", "tokens"],
                )

    return stored(both.select("text", "node").mapInArrow(run, "node long, n long, tokens binary").dropDuplicates(["node"]), "sets")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, rest): the lists of the rarest tokens; ``rest`` counts the set's tokens from
    this one on, in order of frequency."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)])
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n))], names=["token", "node", "n"])

    whole = sets.select("node", "n", "tokens").mapInArrow(explode, "token long, node long, n long")
    often = whole.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = whole.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # The tokens that no other set has come first; what is left of the prefix lies in ``shared``.
    kept = F.size("shared") - least_sql("n", percent) + 1
    return stored(
        shared.where(kept > 0)
        .select("node", "n", F.size("shared").alias("k"), F.posexplode(F.slice("shared", F.lit(1), kept.cast("int"))).alias("at", "entry"))
        .select(F.col("entry.token").alias("token"), "node", "n", (F.col("k") - F.col("at")).cast("long").alias("rest")),
        "index",
    )


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, percent): how similar the sets of each pair are, rounded down."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(x, y)
                out.append(100 * both // (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["a", "b", "percent"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, percent long")


def derived_overlaps(members: list[np.ndarray], probes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each probe, its intersection with every member: counted for the first member, and derived
    for the others from the tokens that they have more or less than the first."""
    first = members[0]
    more = [x[~np.isin(x, first, assume_unique=True)] for x in members]
    less = [first[~np.isin(first, x, assume_unique=True)] for x in members]

    def count(tokens: np.ndarray, bounds: np.ndarray, probe: np.ndarray) -> np.ndarray:
        if not len(tokens) or not len(probe):
            return np.zeros(len(bounds) - 1, np.int64)
        at = np.minimum(np.searchsorted(probe, tokens), len(probe) - 1)
        total = np.concatenate(([0], np.cumsum(probe[at] == tokens)))
        return total[bounds[1:]] - total[bounds[:-1]]

    more_at, less_at = (np.concatenate(([0], np.cumsum([len(x) for x in part]))) for part in (more, less))
    more_all, less_all = np.concatenate(more), np.concatenate(less)
    for probe in probes:
        yield overlap(probe, first) + count(more_all, more_at, probe) - count(less_all, less_at, probe)


def _family_links(members: DataFrame, probes: DataFrame, sets: DataFrame, percent: int, family_sets: int) -> DataFrame:
    """(a, b): links found when ``probes`` (node, class, family) are compared with the ``members``
    (node, class, family) of other classes; one for each probe, class and task. Large families are
    cut into parts, and so are their probes; every part of the one meets every part of the other."""

    def parts(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / family_sets).alias(name))

    shape = parts(members, "m").join(parts(probes, "p"), "family")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    tokens = sets.select("node", "tokens")
    # New names, so that the two sides' columns can be told apart.
    named = lambda frame, side: frame.select(*[F.col(c).alias(f"{side}_{c}") for c in ("family", "mp", "pp", "node", "class", "tokens")])
    left = members.join(shape, "family").select("family", "class", "node", own("m").alias("mp"), F.explode(every("p")).alias("pp")).join(tokens, "node")
    right = probes.join(shape, "family").select("family", "class", "node", own("p").alias("pp"), F.explode(every("m")).alias("mp")).join(tokens, "node")

    def compare(m: pa.Table, p: pa.Table) -> pa.Table:
        a, b = [], []
        if m.num_rows and p.num_rows:
            sets_m = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.column("m_tokens")]
            sets_p = [np.frombuffer(x.as_buffer(), np.uint64) for x in p.column("p_tokens")]
            sizes = np.array([len(x) for x in sets_m])
            nodes, classes = m.column("m_node").to_numpy(), m.column("m_class").to_numpy()
            probe_nodes, probe_classes = p.column("p_node").to_numpy(), p.column("p_class").to_numpy()
            for i, both in enumerate(derived_overlaps(sets_m, sets_p)):
                linked = (100 * both >= percent * (sizes + len(sets_p[i]) - both)) & (classes != probe_classes[i])
                _, at = np.unique(classes[linked], return_index=True)
                b += nodes[linked][at].tolist()
                a += [int(probe_nodes[i])] * len(at)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    left, right = named(left, "m").groupBy("m_family", "m_mp", "m_pp"), named(right, "p").groupBy("p_family", "p_mp", "p_pp")
    return left.cogroup(right).applyInArrow(compare, "a long, b long")


def link_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, family_percent: int = FAMILY_PERCENT, family_sets: int = FAMILY_SETS
) -> DataFrame:
    """(key, n_shingles, component_id): for every document the size of its set and the smallest
    key that links lead to, its own included."""
    joined, none = _node_classes(docs, key, text, percent, family_percent, family_sets)
    least = joined.groupBy("component").agg(F.min("key").alias("component_id"))
    return (
        joined.join(least, "component")
        .select("key", "n", "component_id")
        .unionAll(none.select("key", "n", F.col("key").alias("component_id")))
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
    )


def _node_classes(docs: DataFrame, key: str, text: str, percent: int, family_percent: int, family_sets: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, node, component) of every document with a set, and (key, n) of those without."""
    seen = _seen(docs, key, text, percent)
    documents = seen.where("n is not null").select("key", "n", "node")
    nodes = documents.where("n > 0").groupBy("node", "n").agg(F.min("key").alias("key"))
    counts = seen.where("n is null").groupBy("node").agg(F.sum("shared").alias("shared"))
    wanted = nodes.join(counts, "node").where(F.col("shared") >= slack_sql("n", percent)).select("key", "node")
    sets = _supported(_sets(docs, key, text, wanted), percent)
    index = _index(sets, percent)

    leaders = index.groupBy("token").agg(F.min("node").alias("b"))
    pairs = index.join(leaders, "token").select(F.col("node").alias("a"), "b").where("a != b").distinct()
    near = stored(_compared(pairs, sets), "near")
    links = near.where(F.col("percent") >= percent)
    classes = components(links, "a", "b").select("node", F.col("component").alias("class"))
    families = components(near.where(F.col("percent") >= family_percent), "a", "b").select("node", F.col("component").alias("family"))
    own = lambda c: F.coalesce(c, "node").alias(c)
    members = stored(
        index.select("node", "n").distinct().join(classes, "node", "left").join(families, "node", "left").select("node", "n", own("class"), own("family")), "members"
    )

    by_class = members.groupBy("family", "class").agg(F.count(F.lit(1)).alias("size"))
    shape = by_class.groupBy("family").agg(F.sum("size").alias("family_size"), F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("size", "class")).alias("main"))
    inside = members.join(shape.where("classes > 1"), "family").where("class != main").select("node", "class", "family")
    placed = index.join(members.select("node", "class", "family"), "node").join(shape.select("family", "family_size"), "family")
    blocks = placed.groupBy("token", "family", "family_size").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most_rest"))
    x, y = placed.alias("x"), blocks.alias("y")
    across = (
        x.join(y, "token")
        # The smaller family asks the larger one.
        .where(F.struct("x.family_size", "x.family") < F.struct(F.col("y.family_size").alias("family_size"), F.col("y.family").alias("family")))
        .where((100 * F.col("high") >= percent * F.col("x.n")) & (percent * F.col("low") <= 100 * F.col("x.n")))
        .where(F.least("x.rest", "most_rest") >= least_sql("x.n", percent))
        .select("x.node", "x.class", "y.family")
        .distinct()
    )
    probes = stored(inside.unionAll(across), "probes")
    asked = members.join(probes.select("family").distinct(), "family", "left_semi").select("node", "class", "family")
    found = _family_links(asked, probes, sets, percent, family_sets)
    edges = found.unionAll(classes.where("node != class").select(F.col("node").alias("a"), F.col("class").alias("b")))
    final = components(edges, "a", "b")

    # An empty set is linked with nothing, its copies included.
    some, none = documents.where("n > 0"), documents.where("n = 0")
    joined = some.join(final, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("component"))
    return joined, none


def _with_nodes(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with their set's node, 0 for an empty set, as a column ``name`` at the end."""
    schema = StructType(list(docs.schema.fields)).add(name, "long")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, text):
                sets = shingle_sets(piece.column(piece.schema.get_field_index(text)))
                nodes = pa.array([node_of(x) if len(x) else 0 for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*piece.columns, nodes], schema=out)

    return docs.mapInArrow(run, schema)


def first_of_class(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: of those with the smallest key that with the
    least set hash, and of equal ones the least row; documents with empty sets and without key all stay.

    A key that one row has alone decides for its row. Rows that share their key with others, which keys
    are not meant to do, are told apart by their sets.
    """
    joined, none = _node_classes(docs, key, text, PERCENT, FAMILY_PERCENT, FAMILY_SETS)
    joined = stored(joined.where(F.col("key").isNotNull()), "classes")
    me = F.struct("key", "node")
    first = joined.groupBy("component").agg(F.min(me).alias("first"))
    judged = joined.join(first, "component").select("key", (me != F.col("first")).alias("later"))
    empty = none.where(F.col("key").isNotNull()).select("key", F.lit(False).alias("later"))
    by_key = judged.unionAll(empty).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("later").alias("later"))
    by_key = stored(by_key.where((F.col("rows") > 1) | F.col("later")), "keys")
    settled = by_key.select("key")
    kept = docs.join(settled, docs[key] == settled["key"], "left_anti")

    node = "_node"
    while node in docs.columns:
        node += "_"
    shared = by_key.where("rows > 1").select("key")
    clashing = _with_nodes(docs.join(shared, docs[key] == shared["key"], "left_semi"), text, node)
    winners = first.select("first.key", "first.node")
    same = (clashing[key] == winners["key"]) & (clashing[node] == winners["node"])
    # Equal sets of one key collapse to one row before they are dealt.
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    chosen = clashing.join(winners, same, "left_semi").select(F.col(key).alias("k"), F.col(node).alias("n"), row)
    chosen = chosen.groupBy("k", "n").agg(F.min("row").alias("row")).select("row.*")
    blank = clashing.where(clashing[node] == 0).select(*docs.columns)
    return kept.unionAll(chosen).unionAll(blank)
