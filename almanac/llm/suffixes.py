"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Removed is each byte that lies in a string of ``LENGTH`` bytes which also starts earlier: in a
document with a smaller key, or earlier in the same one. Overlaps count, and strings are judged on
the input.

1. Anchors. Of the ``GRAM``-byte strings in a window of LENGTH bytes the one with the least hash
   (the first of equals) is the window's anchor. Equal windows have the same anchor at the same
   place, so only windows around anchors that occur twice can be repeated.
2. The surroundings of each repeated anchor go to the anchor's bucket; equal ones of a task go once.
3. There the suffixes from the anchors on are sorted by a mergesort whose comparisons take a
   logarithmic number of steps: prefix polynomial hashes tell by binary search how far two suffixes
   agree. The same sort runs on the reversed surroundings before the anchors. Neighbours' common
   extensions are then verified byte by byte; should a hash have collided, the bucket is
   sorted anew with another base.
4. The two orders cut each window's occurrences into classes of equal windows; all but the first
   are repeated.

Texts are UTF-8 bytes; a null text is empty. Rows that repeat a key and text are one document and
get the same result. Texts under one key are ordered by their digest; a null key comes last. Other
columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm import text as T
from almanac.sources.sinks import stored

LENGTH = 100
GRAM = 32
# Gram positions in a window, and the most bytes before an anchor in a window.
PLACES = LENGTH - GRAM + 1
FLUSH_ANCHORS = 1_000_000
FLUSH_BYTES = 24 << 20

_BASES = [int(x) for x in T._odd(8, 21)]
_LETTERS = T._odd(256, 22)


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array, from one pass over it."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = _BASES[seed % len(_BASES)]
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * T.powers(n, base)[:n], out=self.sums[1:])
        # The base is odd, so that it has an inverse modulo 2 ** 64.
        self.inverse = T.powers(n + 1, pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors, their gram hashes, and the first and last start of the windows of each."""
    n = len(data) - GRAM + 1
    starts = np.arange(max(len(data) - LENGTH + 1, 0))
    # Windows that end within their row.
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = starts[starts + LENGTH <= ends[: len(starts)]]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    grams = T.mix(PrefixHash(data).of(np.arange(n), GRAM))
    place = T.first_least((grams >> np.uint64(32)).astype(np.uint32), PLACES)
    owner = place[starts]
    # Windows of one anchor neighbour each other, except where rows meet.
    cut = np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(starts)] - 1
    return owner[first].astype(np.int64), grams[owner[first]], starts[first], starts[last]


def _spread(docs: DataFrame, buckets: int) -> DataFrame:
    """Grams by bucket with the document (a digest of its text) that has them. A gram that a task
    meets twice is handed on once, without a document, and named on the spot (node, gram)."""
    ddl = "bucket int, node long, gram long, grams binary, nodes binary"
    schema = T.arrow_schema(ddl)

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else pa.array(c, f.type) for f in schema], schema=schema)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        grams, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(grams, kind="stable")
        grams, nodes = grams[order], nodes[order]
        first = np.r_[True, grams[1:] != grams[:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(grams)])
        several = np.repeat(size > 1, size)
        n = int(several.sum())
        if n:
            yield rows(n, bucket=-1 - (nodes[several] % buckets), node=nodes[several], gram=grams[several].view(np.int64))
        grams, nodes = grams[first], np.where(several, 0, nodes)[first]
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        grams, nodes = grams[order], nodes[order]
        used = np.flatnonzero(np.diff(cuts))
        yield rows(
            len(used), bucket=used, grams=[grams[cuts[i] : cuts[i + 1]].tobytes() for i in used], nodes=[nodes[cuts[i] : cuts[i + 1]].tobytes() for i in used]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        met: set[int] = set()
        total = 0
        for batch in batches:
            for piece in T.pieces(batch):
                nodes = piece.column(0).to_numpy()
                # Copies of a text are one document.
                new = np.array([not (x in met or met.add(x)) for x in nodes.tolist()], bool)
                piece = piece.filter(pa.array(new))
                data, offsets = T.as_bytes(piece.column(1))
                at, grams, _, _ = anchors(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                held.append((grams, nodes[new][row]))
                total += len(grams)
                if total > FLUSH_ANCHORS:
                    yield from flush(held)
                    held, total, met = [], 0, set()
        if total:
            yield from flush(held)

    return docs.select("node", "text").mapInArrow(run, ddl)


def _repeated_grams(firsts: DataFrame) -> DataFrame:
    """(node, grams): the grams of each document that occur twice or more."""
    buckets = 4 * int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "node long, gram long"
    schema = T.arrow_schema(ddl)

    def repeated(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["node", "gram"]).cast(schema)
        grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")])
        nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("nodes")])
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])]
        grams, nodes = grams[new], nodes[new]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        size = np.diff(np.r_[first, len(grams)])
        several = np.repeat(size > 1, size) & (nodes != 0)
        return pa.table({"node": nodes[several], "gram": grams[several].view(np.int64)}, schema=schema)

    return _spread(firsts, buckets).groupBy("bucket").applyInArrow(repeated, ddl).groupBy("node").agg(F.collect_set("gram").alias("grams"))


def _surroundings(joined: DataFrame) -> DataFrame:
    """For each repeated anchor (bucket, gram, node, rank, place, before, low, high, around): bytes
    around it and how many of them stand before it; its windows start ``low`` to ``high`` bytes
    before it. Rows without a gram are findings already: (node, place, high) as (node, start, end)."""
    buckets = 4 * int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "bucket int, gram long, node long, key string, place long, before int, low int, high long, around binary"
    schema = T.arrow_schema(ddl)

    def flush(held: dict) -> pa.RecordBatch:
        rows = [(int(np.uint64(g & T.MASK) % np.uint64(buckets)), g, *x, low, high, around) for (g, before, low, high, around), x in ((k, (*v, k[1])) for k, v in held.items())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def done(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        n = len(rows)
        columns = {"bucket": [-1 - (x[0] % buckets) for x in rows], "node": [x[0] for x in rows], "place": [x[1] for x in rows], "high": [x[2] for x in rows]}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for piece in T.pieces(batch):
                data, offsets = T.as_bytes(piece.column(2))
                at, grams, first, last = anchors(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                lists = piece.column(3)
                wanted_row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                # Row and gram together, for all rows at once.
                keys = T.mix(lists.flatten().to_numpy().view(np.uint64)) + wanted_row.astype(np.uint64)
                kept = np.isin(T.mix(grams) + row.astype(np.uint64), keys)
                at, grams, first, last, row = at[kept], grams[kept], first[kept], last[kept], row[kept]
                raw = data.tobytes()
                nodes, names = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                findings = []
                for p, g, a, z, r in zip(at.tolist(), grams.view(np.int64).tolist(), first.tolist(), last.tolist(), row.tolist(), strict=True):
                    k = (g, p - a, p - z, p - a, raw[a : z + LENGTH])
                    mine = (nodes[r], names[r], p - int(offsets[r]))
                    other = held.get(k)
                    if other is None:
                        held[k] = mine
                        size += len(k[4]) + 200
                        continue
                    if other == mine:
                        continue
                    # Of two equal surroundings the later one is repeated as a whole.
                    later = max(mine, other, key=lambda x: (x[1] is None, x[1], x[2]))
                    if later is other:
                        held[k] = mine
                    findings.append((later[0], later[2] - k[3], later[2] - k[2] + LENGTH))
                if findings:
                    yield done(findings)
                if size > FLUSH_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return joined.mapInArrow(run, ddl)


def agreement(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b on agree, up to ``most``, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = h.of(a, middle) == h.of(b, middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def sort_suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, h: PrefixHash) -> np.ndarray:
    """Order of the suffixes [start, end) of each group (groups ascend already): a mergesort that
    merges all pairs of runs of a width at once. Equal suffixes keep their order."""
    n = len(start)
    order = np.arange(n)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[head, n])
    base, count = np.repeat(head, size), np.repeat(size, size)
    padded = np.append(data, 0)

    def compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x stands before, equals or stands after suffix y."""
        nx, ny = end[x] - start[x], end[y] - start[y]
        most = np.minimum(nx, ny)
        common = agreement(h, start[x], start[y], most)
        cx, cy = padded[start[x] + common].astype(int), padded[start[y] + common].astype(int)
        return np.where(common == most, np.sign(nx - ny), np.sign(cx - cy))

    place = np.arange(n) - base
    width = 1
    while n and width < size.max():
        run = place // width
        other = (run ^ 1) * width
        low = np.minimum(base + other, base + count)
        high = np.minimum(base + other + width, base + count)
        origin = low.copy()
        left = (run & 1) == 0
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                break
            middle = (low[active] + high[active]) >> 1
            sign = compare(order[middle], order[active])
            # From the left run, others go before only if less; from the right run, also if equal.
            before = np.where(left[active], sign < 0, sign <= 0)
            low[active] = np.where(before, middle + 1, low[active])
            high[active] = np.where(before, high[active], middle)
        target = base + np.minimum(run, run ^ 1) * width + place % width + (low - origin)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def neighbours(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, order: np.ndarray, h: PrefixHash) -> np.ndarray | None:
    """Common extension of each suffix with the one before it in the order, -1 at the first of a
    group; None if a hash collided, as the bytes then show."""
    x, y = order[:-1], order[1:]
    most = np.minimum(end[x] - start[x], end[y] - start[y])
    common = agreement(h, start[x], start[y], most)
    inner = np.arange(int(common.sum())) - np.repeat(np.cumsum(common) - common, common)
    if (data[np.repeat(start[x], common) + inner] != data[np.repeat(start[y], common) + inner]).any():
        return None
    inside = group[x] == group[y]
    part = common < most
    cx, cy = data[(start[x] + common)[part]], data[(start[y] + common)[part]]
    if (cx == cy).any() or (cx > cy)[inside[part]].any() or (end[x] - start[x] > end[y] - start[y])[inside & ~part].any():
        return None
    return np.r_[-1, np.where(inside, common, -1)]


def _classes(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and the verified common extensions of neighbours."""
    for seed in range(len(_BASES)):
        h = PrefixHash(data, seed)
        order = sort_suffixes(data, start, end, group, h)
        common = neighbours(data, start, end, group, order, h)
        if common is not None:
            return order, common
    raise ArithmeticError("hashes collided under every base")


def repeated_windows(around: list[bytes], before: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows by bytes before the anchor (0 to PLACES - 1): whether the window that starts there
    also starts earlier. Rows come by group; ``rank`` orders them by document and place."""
    n = len(around)
    data = np.frombuffer(b"".join(around), np.uint8)
    sizes = np.array([len(x) for x in around], np.int64)
    start = np.cumsum(sizes) - sizes
    anchor, end = start + before, start + sizes
    right, right_common = _classes(data, anchor, np.minimum(end, anchor + LENGTH), group)
    total = len(data)
    left, left_common = _classes(data[::-1], total - anchor, total - start, group)
    out = np.zeros((n, PLACES), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(PLACES):
        has = np.flatnonzero((low <= back) & (back <= high))
        if not len(has):
            continue
        right_class[right] = np.cumsum(right_common < LENGTH - back)
        left_class[left] = np.cumsum(left_common < back)
        key = right_class[has] * (n + 1) + left_class[has]
        by = np.lexsort((rank[has], key))
        again = np.r_[False, key[by][1:] == key[by][:-1]]
        out[has[by[again]], back] = True
    return out


def _findings(surroundings: DataFrame) -> DataFrame:
    """(node, start, end) of repeated stretches."""
    ddl = "node long, start long, end long"
    schema = T.arrow_schema(ddl)

    def find(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([table.column(c).cast(pa.int64()) for c in ("node", "place", "high")], schema=schema)
        # A row that the input repeats has the same surroundings at the same places.
        by = np.lexsort(tuple(table.column(c).to_numpy() for c in ("place", "node", "gram")))
        table = table.take(pa.array(by))
        new = np.r_[True, np.logical_or.reduce([np.diff(table.column(c).to_numpy()) != 0 for c in ("place", "node", "gram")])]
        table = table.filter(pa.array(new))
        gram, node, place = (table.column(c).to_numpy() for c in ("gram", "node", "place"))
        before, low, high = (table.column(c).to_numpy() for c in ("before", "low", "high"))
        key = table.column("key").to_pylist()
        rank = np.empty(len(gram), np.int64)
        rank[sorted(range(len(gram)), key=lambda i: (key[i], place[i]))] = np.arange(len(gram))
        hit = repeated_windows(table.column("around").to_pylist(), before.astype(np.int64), low, high, gram, rank)
        # Neighbouring starts make one stretch. More bytes before the anchor is an earlier start.
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        return pa.table({"node": node[row], "start": place[row] - (stop - 1), "end": place[row] - begin + LENGTH}, schema=schema)

    return surroundings.groupBy("bucket").applyInArrow(find, ddl)


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, spans): every document with its repeated stretches of bytes as (start, end),
    in no order and possibly overlapping; null without any."""
    rows = docs.select(docs[key].alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # A key that orders as the documents do, whatever its type; ties go by the text's digest.
    marked = rows.withColumn("digest", F.md5(F.encode("text", "utf-8")))
    listed = stored(marked.select("doc", "digest", F.octet_length("text").cast("long").alias("size")).distinct().where(F.col("size") >= LENGTH), "texts")
    least = listed.groupBy("digest", "size").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc")).alias("least"))
    # Of equal texts the first document stands for all; the others are repeated as a whole.
    first = least.select("digest", F.col("least.doc").alias("doc"))
    node = F.xxhash64("digest", F.lit(1))
    copies = listed.join(least, ["digest", "size"]).where(~F.col("doc").eqNullSafe(F.col("least.doc")))
    whole = copies.select("doc", "digest", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))

    order = F.concat(_sortable("doc", docs.schema[key].dataType.typeName()), F.lit(":"), F.col("digest"))
    grams = stored(_repeated_grams(marked.select(node.alias("node"), "text")), "grams")
    wanted = first.select(F.col("doc").alias("d"), F.col("digest").alias("g"), node.alias("node")).join(grams, "node")
    ready = marked.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("node", order.alias("key"), "text", "grams")
    found = _findings(_surroundings(ready))
    named = found.join(first.select(node.alias("node"), "doc", "digest"), "node").select("doc", "digest", "start", "end")
    spans = stored(named.unionAll(whole).groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    spans = spans.select(F.col("doc").alias("d"), F.col("digest").alias("g"), "spans")
    joined = marked.join(spans, F.col("doc").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    return joined.select(F.col("doc").alias(key), "text", "spans")


def _sortable(column: str, kind: str):
    """A string that orders as the column does; nulls last."""
    c = F.col(column)
    if kind in ("long", "integer", "short", "byte"):
        # Shifted into the positive range, with leading zeros.
        c = F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(F.concat(F.lit("0"), c.cast("string")), F.lit("1"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): every document's bytes without the repeated ones."""
    repeats = find_repeats(docs, key, text)
    ddl = f"{key} {repeats.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    schema = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                out = []
                for t, spans in zip(piece.column(1), piece.column(2).to_pylist(), strict=True):
                    raw = t.as_buffer().to_pybytes()
                    gone = merged([(x["start"], x["end"]) for x in spans or ()])
                    edges = [0, *[e for span in gone for e in span], len(raw)]
                    kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(gone), kept))
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    return repeats.mapInArrow(run, ddl)


