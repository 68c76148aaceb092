"""Product codes of vectors: each part of a vector is the number of its nearest codebook entry.

Codebooks are fitted by Lloyd's rounds, done with two trees. Each task keeps its vectors in blocks, each
with one tree of bounding boxes for every part position, whose nodes hold the number and the sum of
their parts; these trees are made once and stored. A small tree stands over a position's codebook
entries. Both are descended together: bounds on the distance between a box of parts and
a box of entries drop entries that can be nearest to none of the parts, and between two single
entries the sign of the difference of distances over the whole box decides. A node with one entry left is
assigned whole, by its stored sum. What stays open down to a leaf is settled part by part. All
bounds and distances are integers, so that the result is that of the plain rounds, ties included.

A round is one pass over the stored trees; a task hands on one count and sum for each entry.

Components are floor(SCALE * x). Vectors that are null or empty or hold a null or a component that is not
finite fall out, as do those of another length than the commonest one (the greater of two). Parts are
cut at i * length // parts; there are no more parts than components. The codebooks start as the vectors of the least keys, nulls last, equal keys by vector;
fewer vectors make fewer entries. Of equal distances the lower entry counts. Repeated rows and rows with a null key
are all coded. Components whose squares would not fit 64 bits (beyond +-2**28 for parts of 16) are an error. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm import text as T
from almanac.sources.sinks import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Parts in a leaf, and bytes of a block's vectors.
LEAF = 16
BLOCK_BYTES = 1 << 20


@dataclass
class Level:
    """The nodes of one level: the box, number and sum of each one's parts."""

    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    total: np.ndarray


def tree_order(parts: np.ndarray) -> np.ndarray:
    """An order in which equal runs of parts, halved again and again down to leaves, are near each other."""
    order = np.arange(len(parts))[None]
    while order.shape[1] > LEAF:
        own = parts[order]
        widest = (own.max(1) - own.min(1)).argmax(1)
        value = np.take_along_axis(own, widest[:, None, None], 2)[:, :, 0]
        half = order.shape[1] // 2
        order = np.take_along_axis(order, np.argpartition(value, half, axis=1), 1).reshape(-1, half)
    return order.ravel()


class PartTree:
    """A tree over parts that are in ``tree_order``; the first ``real`` of them count, the rest fill it up."""

    def __init__(self, parts: np.ndarray, order: np.ndarray, real: int):
        self.parts, self.order = parts, order
        self.weight = (order < real).astype(np.int64)
        leaves = parts.reshape(-1, LEAF, parts.shape[1])
        weight = self.weight.reshape(-1, LEAF)
        low, high = leaves.min(1), leaves.max(1)
        count, total = weight.sum(1), (leaves * weight[:, :, None]).sum(1)
        self.levels = [Level(low, high, count, total)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            count, total = count[::2] + count[1::2], total[::2] + total[1::2]
            self.levels.append(Level(low, high, count, total))
        self.levels.reverse()


class EntryTree:
    """A tree over a codebook; its leaves are single entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.left, self.right, self.entry = [], [], [], [], []
        if len(entries):
            self._add(np.arange(len(entries)))
        for name in ("low", "high", "left", "right", "entry"):
            setattr(self, name, np.array(getattr(self, name), np.int64))

    def _add(self, held: np.ndarray) -> int:
        own, at = self.entries[held], len(self.low)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.entry.append(held[0] if len(held) == 1 else -1)
        self.left.append(-1)
        self.right.append(-1)
        if len(held) > 1:
            by = held[np.argsort(own[:, (own.max(0) - own.min(0)).argmax()], kind="stable")]
            self.left[at] = self._add(by[: len(by) // 2])
            self.right[at] = self._add(by[len(by) // 2 :])
        return at


def _open(node: np.ndarray, held: np.ndarray, book: EntryTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with both halves of every entry node that is not a single entry."""
    whole = book.entry[held] >= 0
    n, h = node[~whole], held[~whole]
    node = np.concatenate((node[whole], n, n))
    held = np.concatenate((held[whole], book.left[h], book.right[h]))
    by = np.argsort(node, kind="stable")
    return node[by], held[by]


def _prune(node: np.ndarray, held: np.ndarray, level: Level, book: EntryTree) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, by node, without those whose entries are nearest to none of the node's parts."""
    low, high = level.low[node], level.high[node]
    near = np.maximum(np.maximum(low - book.high[held], book.low[held] - high), 0)
    far = np.maximum(high - book.low[held], book.high[held] - low)
    near, far = (near * near).sum(1), (far * far).sum(1)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[start, len(node)])
    least = np.repeat(np.minimum.reduceat(far, start), size)
    keep = near <= least
    # Among single entries: the one with the least farthest distance against every other one.
    single = book.entry[held]
    rank = np.where(single >= 0, far, np.iinfo(np.int64).max)
    best = np.repeat(np.minimum.reduceat(rank, start), size)
    first = np.where((rank == best) & (single >= 0), single, len(book.entries))
    chosen = np.repeat(np.minimum.reduceat(first, start), size)
    known = (chosen < len(book.entries)) & (single >= 0) & (single != chosen)
    mine, other = book.entries[chosen[known]], book.entries[single[known]]
    step = other - mine
    # The least value over the box of the distance to the other entry less that to the chosen one.
    gain = ((other * other - mine * mine) - 2 * step * np.where(step > 0, high[known], low[known])).sum(1)
    keep[known] &= ~((gain > 0) | ((gain == 0) & (chosen[known] < single[known])))
    return node[keep], held[keep]


@dataclass
class Assigned:
    """Numbers and sums by entry, the entry of every part, and how many parts were settled one by one."""

    count: np.ndarray
    total: np.ndarray
    entry: np.ndarray
    singly: int


def assign(tree: PartTree, book: EntryTree) -> Assigned:
    """Every part with its nearest entry."""
    k, width = book.entries.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    entry = np.zeros(len(tree.parts), np.int64)
    node, held = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth, level in enumerate(tree.levels):
        last = depth == len(tree.levels) - 1
        while len(node):
            node, held = _prune(*_open(node, held, book), level, book)
            if not last or (book.entry[held] >= 0).all():
                break
        if not len(node):
            return Assigned(count, total, entry, 0)
        alone = np.r_[True, node[1:] != node[:-1]] & np.r_[node[1:] != node[:-1], True] & (book.entry[held] >= 0)
        settled, to = node[alone], book.entry[held[alone]]
        np.add.at(count, to, level.count[settled])
        np.add.at(total, to, level.total[settled])
        size = len(tree.parts) // len(level.count)
        entry.reshape(-1, size)[settled] = to[:, None]
        node, held = node[~alone], held[~alone]
        if not last:
            node, held = np.concatenate((2 * node, 2 * node + 1)), np.concatenate((held, held))
    if not len(node):
        return Assigned(count, total, entry, 0)
    by = np.argsort(node, kind="stable")
    node, held = node[by], book.entry[held[by]]
    apart = tree.parts.reshape(-1, LEAF, width)[node] - book.entries[held][:, None]
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    # Distance first, then the lower entry.
    best = np.minimum.reduceat((apart * apart).sum(2) * k + held[:, None], start, axis=0) % k
    entry.reshape(-1, LEAF)[node[start]] = best
    open_parts = (node[start][:, None] * LEAF + np.arange(LEAF)).ravel()
    member = (best.ravel() == np.arange(k)[:, None]) * tree.weight[open_parts]
    return Assigned(count + member.sum(1), total + member @ tree.parts[open_parts], entry, len(open_parts))


@dataclass
class Codebooks:
    """The entries of each part position, and the bounds of the parts."""

    entries: list[np.ndarray]
    bounds: list[int]


def usable(vector: Column, length: int | Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) == length) & F.forall(vector, finite)


def _images(values: np.ndarray, scale: int, widest: int) -> np.ndarray:
    image = np.floor(values.astype(np.float64) * scale)
    if image.size and np.abs(image).max() >= 2.0 ** (29 - max(widest - 1, 1).bit_length() / 2):
        raise ValueError("a component is too large to be coded")
    return image.astype(np.int64)


def common_length(vectors: DataFrame, vector: str) -> int:
    """The commonest length of vectors that can be coded, the greater of equally common ones; 0 without any."""
    v = vectors[vector]
    sizes = vectors.where(usable(v, F.size(v))).groupBy(F.size(v).alias("size")).count()
    first = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return first["size"] if first else 0


def _blocks(bounds: list[int], scale: int, ddl: str):
    """Blocks of a task's vectors: keys, labels, and for each part the order and the parts in it."""
    schema, length = T.arrow_schema(ddl), bounds[-1]
    widest = max(z - a for a, z in zip(bounds[:-1], bounds[1:], strict=True))
    most = max(LEAF, 1 << (BLOCK_BYTES // (4 * length)).bit_length() - 1) if length else LEAF

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        n = len(whole)
        values = whole.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        image = _images(values, scale, widest).reshape(n, length)
        size = LEAF << max(0, -(-n // LEAF) - 1).bit_length()
        image = np.concatenate((image, np.repeat(image[-1:], size - n, axis=0)))
        orders, parts = [], []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            order = tree_order(image[:, a:z])
            orders.append(order.astype("<i4").tobytes())
            parts.append(image[order, a:z].astype("<i4").tobytes())
        listed = lambda i: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), whole.column(i).combine_chunks())
        columns = [listed(0), listed(1), pa.array([orders]), pa.array([parts])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - size)
                held.append(piece)
                size += piece.num_rows
                at += piece.num_rows
                if size == most:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return run


def _trees(row: pa.RecordBatch, i: int, bounds: list[int]) -> Iterator[PartTree]:
    """The trees of one block."""
    real = len(row.column(0)[i])
    for order, parts, a, z in zip(row.column(2)[i], row.column(3)[i], bounds[:-1], bounds[1:], strict=True):
        order = np.frombuffer(order.as_buffer(), "<i4")
        yield PartTree(np.frombuffer(parts.as_buffer(), "<i4").astype(np.int64).reshape(len(order), z - a), order, real)


def _round(trees: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after every part went to its nearest entry."""
    ddl = "part int, entry int, n long, total array<long>"
    schema = T.arrow_schema(ddl)
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = [EntryTree(e) for e in books.entries]
        count = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros_like(e) for e in books.entries]
        for batch in batches:
            for i in range(batch.num_rows):
                for p, tree in enumerate(_trees(batch, i, books.bounds)):
                    found = assign(tree, over[p])
                    count[p] += found.count
                    total[p] += found.total
        rows = [(p, e, int(n), total[p][e].tolist()) for p in range(parts) for e, n in enumerate(count[p]) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    widest = max(e.shape[1] for e in books.entries)
    sums = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(widest)])
    entries = [e.copy() for e in books.entries]
    # One row for each entry of each part.
    for r in trees.mapInArrow(run, ddl).groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("total")).collect():
        book = entries[r["part"]]
        book[r["entry"]] = [x // r["n"] for x in r["total"][: book.shape[1]]]
    return Codebooks(entries, books.bounds)


@dataclass
class Fit:
    """Codebooks, the stored trees of the vectors that they were fitted on, and the types of keys and labels."""

    books: Codebooks
    trees: DataFrame
    kinds: tuple[str, str]


def fit(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Fit:
    """Codebooks of all vectors; at most 256 entries a part."""
    kinds = vectors.schema[key].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    length = common_length(vectors, vector)
    parts = min(parts, max(length, 1))
    bounds = [i * length // parts for i in range(parts + 1)]
    frame = vectors.where(usable(vectors[vector], length)).select(
        vectors[key].alias("key"), vectors[label].alias("label"), vectors[vector].alias("vector")
    )
    first = frame.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    widest = max(z - a for a, z in zip(bounds[:-1], bounds[1:], strict=True))
    start = _images(np.array([r["vector"] for r in first], np.float64).reshape(len(first), length), scale, widest)
    books = Codebooks([start[:, a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)], bounds)
    ddl = f"keys array<{kinds[0]}>, labels array<{kinds[1]}>, orders array<binary>, parts array<binary>"
    trees = stored(frame.mapInArrow(_blocks(bounds, scale, ddl), ddl), "trees")
    for _ in range(rounds if first else 0):
        after = _round(trees, books)
        settled = all(np.array_equal(a, b) for a, b in zip(after.entries, books.entries, strict=True))
        books = after
        if settled:
            # All further rounds would give the same.
            break
    return Fit(books, trees, kinds)


def encode(fitted: Fit) -> DataFrame:
    """(key, label, code, error): one byte a part, and the squared distance to the coded vector."""
    books = fitted.books
    ddl = f"key {fitted.kinds[0]}, label {fitted.kinds[1]}, code binary, error long"
    schema = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = [EntryTree(e) for e in books.entries]
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(batch.column(0)[i])
                codes, error = np.zeros((n, len(over)), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(_trees(batch, i, books.bounds)):
                    entry = assign(tree, over[p]).entry
                    apart = tree.parts - books.entries[p][entry]
                    real = tree.weight > 0
                    codes[tree.order[real], p] = entry[real]
                    error[tree.order[real]] += (apart * apart).sum(1)[real]
                columns = [batch.column(0)[i].values, batch.column(1)[i].values, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return fitted.trees.mapInArrow(run, ddl)


def decoded(code: Column, books: Codebooks, scale: int = SCALE) -> Column:
    """The vector that a code stands for."""
    tables = [F.from_json(F.lit(str(e.tolist())), "array<array<bigint>>") for e in books.entries]
    at = lambda p: F.conv(F.substring(F.hex(code), 2 * p + 1, 2), 16, 10).cast("int") + 1
    whole = F.flatten(F.array(*[F.element_at(t, at(p)) for p, t in enumerate(tables)]))
    return F.transform(whole, lambda x: x / scale)


def label_errors(coded: DataFrame) -> DataFrame:
    """The coded rows with ``label_error``: the error summed over all rows with the same label; nulls are one label."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
