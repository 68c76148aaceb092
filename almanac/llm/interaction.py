"""How five text filters interact: what each removes, in every order in which they can be applied.

The filters are rules that a text fails: A has under 100 words, B fewer than 80 distinct words in
100, C more than one A-Z in ten characters, D any of ``#$%&*|``, E is the same text as a document with a
smaller key. Words are runs without white space; distinct ones are told apart by 64-bit hashes.

E needs every text of the table, but most texts have no equal. A prepass counts hashed texts in the
cells of a sketch (a counting Bloom filter whose counters end at two): each task counts its own,
slices of the sketch are summed, and a text that finds one of its cells counted once is certainly
unique. Only the others, possible repeats, are shuffled with their whole text for the least key
of each. The sketch grows with the table and goes to the tasks as one bit a cell, at most ``MOST_CELLS``
bits; a table that needs more than that goes without, and all its texts are grouped.

The flags of a document are one mask. Masks are counted by part, with counts of the labels,
and whatever an order of the filters removes is a sum over the 32 masks of a part: no order is
ever run over documents.

A null text is empty, a null part the empty string. A null key is greater than all others, so that
its rows repeat any other row's text but not each other's; rows with one key and text are each
counted, and none is a repeat of the other. Several label rows of a key count as one that has any
of their ones. A key without labels counts as neither. An empty table has no parts and gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm import text as T
from almanac.sources.sinks import stored

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_UPPER_PERCENT = 10
MARKS = b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")

# Cells of the sketch for a document, in a slice, and at most (a bit each when they are broadcast).
CELLS = 8
SLICE_CELLS = 1 << 18
MOST_CELLS = 1 << 29
# Hashes that a task holds before it counts them.
HELD = 1 << 20

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def own_flags(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each text fails."""
    data, offsets = T.as_bytes(texts)
    rows = len(offsets) - 1
    per_row = lambda marked: np.diff(np.concatenate(([0], np.cumsum(marked)))[offsets])
    words = T.Words(data, offsets, T.NOT_SPACE)
    count, row = np.diff(words.bounds), words.rows()
    # A hash of word and row: equal words of one row only are equal.
    both = T.mix(words.hashes() ^ T.mix(row.astype(np.uint64)))
    distinct = np.bincount(row[np.unique(both, return_index=True)[1]], minlength=rows)
    points = per_row((data & 0xC0) != 0x80)
    failed = [
        count < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * count,
        100 * per_row(_UPPER[data]) > MOST_UPPER_PERCENT * points,
        per_row(_MARK[data]) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash; ``cells`` is a power of two of at most 32 bits."""
    h = hashes.view(np.uint64)
    least = np.uint64(cells - 1)
    return (h & least).astype(np.int64), ((h >> np.uint64(32)) & least).astype(np.int64)


def _count_cells(cells: int):
    """A task's counts: for each slice of the sketch, cells seen and whether once or more often."""
    schema = T.arrow_schema("slice int, cells binary, often binary")

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate([c for h in held for c in cells_of(h, cells)]), return_counts=True)
        part = cell // SLICE_CELLS
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[starts[1:], len(cell)]
        inside, often = (cell % SLICE_CELLS).astype("<i4"), (n > 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts], pa.int32()),
                pa.array([inside[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()),
                pa.array([often[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= HELD:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """One slice's counts of all tasks summed: a bit for each cell that is counted more than once."""
    once, more = np.zeros(SLICE_CELLS, bool), np.zeros(SLICE_CELLS, bool)
    for cells, often in zip(group.column("cells"), group.column("often"), strict=True):
        at = np.frombuffer(cells.as_buffer(), "<i4")
        again = np.frombuffer(often.as_buffer(), np.uint8) > 0
        more[at] |= once[at] | again
        once[at] = True
    return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())})


def sketch_cells(documents: int) -> int:
    """How many cells a table needs; none where a sketch would be too large."""
    cells = 1 << max(documents * CELLS - 1, 1).bit_length()
    return cells if cells <= MOST_CELLS else 0


def repeat_sketch(hashes: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell that two or more of the hashes (column ``tag``) came to."""
    counted = hashes.select("tag").mapInArrow(_count_cells(cells), "slice int, cells binary, often binary")
    merged = counted.groupBy("slice").applyInArrow(_merge, "slice int, bits binary")
    out = np.zeros(max(cells, SLICE_CELLS) // 8, np.uint8)
    width = SLICE_CELLS // 8
    for row in merged.toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_repeat(bits: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    """Marks the hashes none of whose cells was counted once; all others are certainly unique."""
    first, second = cells_of(hashes, cells)
    held = lambda c: (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1
    return (held(first) & held(second)).astype(bool)


def flagged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, mask, n): how many rows of a key and part fail the filters of a mask."""
    frame = docs.select(
        docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text")
    ).withColumn("tag", F.xxhash64("text"))
    cells = sketch_cells(frame.count())
    held = docs.sparkSession.sparkContext.broadcast(repeat_sketch(frame, cells) if cells else None)
    ddl = f"key {frame.schema['key'].dataType.simpleString()}, part string, tag long, mask int, repeat string"
    schema = T.arrow_schema(ddl)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                tags = piece.column(3)
                alone = ~may_repeat(held.value, tags.to_numpy(), cells) if cells else np.zeros(len(tags), bool)
                # The text goes on only where it may be a repeat.
                texts = piece.column(2)
                kept = texts.take(pa.array(np.arange(len(texts)), mask=alone)).cast(pa.string())
                columns = [piece.column(0), piece.column(1), tags, pa.array(own_flags(texts), pa.int32()), kept]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    marked = stored(frame.mapInArrow(mark, ddl), "flags")
    held.unpersist()
    maybe = marked.where(F.col("repeat").isNotNull())
    first = maybe.groupBy("repeat").agg(F.min("key").alias("first"), F.min("tag").alias("first_tag")).drop("repeat")
    rows = marked.groupBy("key", "part", "tag", "mask", F.col("repeat").isNotNull().alias("maybe")).agg(F.count("*").alias("n"))
    joined = rows.join(first, rows["key"].eqNullSafe(first["first"]) & (rows["tag"] == first["first_tag"]), "left")
    later = F.col("maybe") & F.col("first_tag").isNull()
    return joined.select("key", "part", (F.col("mask") + F.when(later, REPEATED).otherwise(0)).alias("mask"), "n")


def mask_counts(flags: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents with a mask, and those of them with a label of one."""
    known = labels.groupBy(labels[key].alias("label_key")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("quality"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    joined = flags.join(known, flags["key"] == known["label_key"], "left")
    having = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0)))
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), having("quality").alias("good"), having("toxic").alias("toxic"))


def filter_orders() -> list[dict]:
    """Each step of each order: the filter's bit and the mask of those before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return rows


def audit(counts: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter removes and what it would have.

    ``counts`` has (part, mask, n, good, toxic), a row for each mask at most, 32 a part.
    """
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.from_json(F.lit(json.dumps(filter_orders())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    every = masks.select("part", "masks", F.inline(orders))
    bit, before = F.col("bit"), F.col("before")

    def total(wanted, value=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", wanted), F.lit(0).cast("long"), lambda s, m: s + value(m))

    fails = lambda m: m["mask"].bitwiseAND(bit) != 0
    passed = lambda m: m["mask"].bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    # Of all orders, the filter comes before the others that a document fails in one of as many as it fails.
    orders_first = lambda m: (F.lit(len(list(permutations(FILTERS)))) / F.bit_count(m["mask"])).cast("long")
    return every.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m["mask"] == bit).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * orders_first(m)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of all documents."""
    return audit(mask_counts(flagged(docs, key, text, part), labels, key))
