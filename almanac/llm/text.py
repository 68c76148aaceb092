"""Vectorised words of Arrow text columns, shared by the operators that read whole texts.

Texts are handled as their UTF-8 bytes. A word class is a table of 256 booleans: all classes
used here treat every byte beyond ASCII alike, so that bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Most bytes of text that are worked on at once. A longer text is one piece of its own.
PIECE_BYTES = 2 << 20
MASK = (1 << 64) - 1

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
# Digits, lower-case letters and everything beyond ASCII; texts are lower-cased first.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _odd(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(256, 11)
_BASE = int(_odd(1, 12)[0])
_STEP = _odd(64, 13)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in a row, and the offsets of its rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    index = batch.schema.get_field_index(column)
    lengths = np.diff(as_bytes(batch.column(index))[1])
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[data]


class Words:
    """Words of a text column: where each starts and ends among its bytes, and which row holds which."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # A word never runs from one row into the next.
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.data, self.offsets, self.inside = data, offsets, inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        # Row i holds the words bounds[i] up to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        values = _BYTE[self.data[self.inside]]
        values *= powers(int(lengths.max()))[np.arange(len(values)) - np.repeat(at, lengths)]
        return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * _STEP[-1])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes (rows are not regarded here)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _STEP[0]
    for i in range(1, size):
        out += h[i : i + n] * _STEP[i % 60]
    return mix(out)


def combine(h: np.ndarray) -> int:
    """One hash of a short run of any length, different from that of any ``windows`` run by its seed."""
    out = 0x9E3779B97F4A7C15
    for x in h.tolist():
        out = (out * _BASE + x) & MASK
    return int(mix(np.array([out], np.uint64))[0])


def first_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` neighbouring values, the place of its least one, the first of equals."""
    place = np.arange(len(values), dtype=np.int32)
    done = 1
    while done < span:
        step = min(done, span - done)
        later = values[step:] < values[:-step]
        values = np.where(later, values[step:], values[:-step])
        place = np.where(later, place[step:], place[:-step])
        done += step
    return place


def words_of(texts: pa.Array, kind: np.ndarray = NOT_SPACE) -> Words:
    """Words of a text column after lower-casing A-Z."""
    data, offsets = as_bytes(texts)
    return Words(lowered(data), offsets, kind)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema in SQL notation."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_texts(
    docs: DataFrame,
    key: str,
    text: str,
    schema: str,
    work: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]],
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """``work`` over pieces of (key, text), named so; its columns, by name, follow ``schema``.

    ``{key}`` in the schema stands for the key's type. All other columns of ``docs`` stay behind,
    so that none can clash with a result.
    """
    frame = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    ddl = schema.replace("{key}", frame.schema["key"].dataType.simpleString())
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=limit):
                made = work(piece)
                columns = [c if isinstance(c := made[f.name], pa.Array) else pa.array(c, f.type) for f in out]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return frame.mapInArrow(run, ddl)


def filter_texts(docs: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray], limit: int = PIECE_BYTES) -> DataFrame:
    """The rows, with all their columns, whose texts ``keep`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                yield piece.filter(pa.array(keep(piece.column(piece.schema.get_field_index(text))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
