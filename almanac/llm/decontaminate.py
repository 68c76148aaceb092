"""Benchmark decontamination by greedy string tiling.

Seeds: every run of ``min_match`` words of a benchmark item; documents that share seeds with an
item are candidates for it. Tiles: the longest common runs that do not overlap are marked first,
then shorter ones, with Karp-Rabin hashes of running lengths down to ``min_match``. A document is
contaminated by an item when the tiles cover at least ``COVERAGE`` of the item's words, wherever
they stand: reordered passages are caught too.

Words are runs of digits, letters and anything beyond ASCII, lower-cased. Items shorter than
``min_match`` words match as a whole. Items without words match nothing; null texts are empty.
The benchmark is worked through in blocks of bounded size, each of which is broadcast, so that
a large benchmark means more passes over the documents and not more memory. Every repeated
row of either table counts on its own; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm import text as T

MIN_MATCH = 5
COVERAGE = 0.5
# Most bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass(frozen=True)
class Index:
    """A block of the benchmark: its words and where each of its seeds stands."""

    items: list
    words: list[np.ndarray]
    seeds: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray
    known: np.ndarray
    sizes: list[int]


def build_index(items: list, texts: list[str | None], min_match: int) -> Index:
    w = T.words_of(pa.array(texts, pa.string()), T.ALNUM)
    h = w.hashes()
    words = [h[a:z] for a, z in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    hashes, owners, places = [], [], []
    # A short item is one seed of its own length.
    sizes = sorted({min(len(x), min_match) for x in words if len(x)})
    for i, x in enumerate(words):
        if len(x):
            made = T.windows(x, min(len(x), min_match))
            hashes.append(made)
            owners.append(np.full(len(made), i))
            places.append(np.arange(len(made)))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    seeds, first = np.unique(flat[order], return_index=True)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[seeds & np.uint64((1 << _FILTER_BITS) - 1)] = True
    return Index(
        items, words, seeds, np.append(first, len(flat)),
        (np.concatenate(owners) if owners else np.zeros(0, int))[order],
        (np.concatenate(places) if places else np.zeros(0, int))[order],
        known, sizes,
    )


def tiles(document: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two runs of word hashes: (document place, item place, length)."""
    free_d, free_i = np.ones(len(document), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = min(len(item), len(document))
    while size >= min_match:
        # Running Karp-Rabin: hashes of all unmarked runs of this length, on both sides.
        hd, hi = T.windows(document, size), T.windows(item, size)
        open_d = np.flatnonzero(np.convolve(free_d, np.ones(size, int), "valid") == size)
        open_i = np.flatnonzero(np.convolve(free_i, np.ones(size, int), "valid") == size)
        table: dict[int, list[int]] = {}
        for p in open_d[np.isin(hd[open_d], hi[open_i])].tolist():
            table.setdefault(int(hd[p]), []).append(p)
        marked = False
        for q in open_i.tolist():
            for p in table.get(int(hi[q]), ()):
                # The hash proposes, the words decide; an earlier tile may have taken some of them.
                if free_i[q : q + size].all() and free_d[p : p + size].all() and (document[p : p + size] == item[q : q + size]).all():
                    free_d[p : p + size] = free_i[q : q + size] = False
                    out.append((p, q, size))
                    marked = True
                    break
        # Nothing of this length is left; the next shorter common run is the next to mark.
        size -= 1
        if not marked and size >= min_match:
            size = _longest(document, item, free_d, free_i, min_match, size)
    return out


def _longest(d: np.ndarray, i: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, least: int, most: int) -> int:
    """The greatest length up to ``most`` at which unmarked runs may agree, by bisection: runs of
    a length agree only if their beginnings of any lesser length do. 0 if below ``least``."""

    def agree(size: int) -> bool:
        hd, hi = T.windows(d, size), T.windows(i, size)
        open_d = np.convolve(free_d, np.ones(size, int), "valid") == size
        open_i = np.convolve(free_i, np.ones(size, int), "valid") == size
        return bool(np.isin(hd[open_d], hi[open_i]).any())

    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        if agree(middle):
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


def _candidates(words: T.Words, h: np.ndarray, index: Index, min_match: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, item, document places, item places) of all shared seeds."""
    rows = words.rows()
    found = []
    for size in index.sizes:
        made = T.windows(h, size)
        at = np.flatnonzero(index.known[made & np.uint64((1 << _FILTER_BITS) - 1)])
        at = at[at + size <= words.bounds[rows[at] + 1]]
        slot = np.searchsorted(index.seeds, made[at])
        hit = (slot < len(index.seeds)) & (index.seeds[np.minimum(slot, len(index.seeds) - 1)] == made[at])
        at, slot = at[hit], slot[hit]
        n = index.starts[slot + 1] - index.starts[slot]
        places = np.repeat(at, n)
        entry = np.arange(int(n.sum())) + np.repeat(index.starts[slot] - (np.cumsum(n) - n), n)
        found.append((rows[places], index.item_of[entry], places - words.bounds[rows[places]], index.place_of[entry]))
    if not found:
        return []
    row, item, place, inside = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(row):
        return []
    order = np.lexsort((place, item, row))
    row, item, place, inside = row[order], item[order], place[order], inside[order]
    cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    return [
        (int(row[a]), int(item[a]), place[a:z], inside[a:z])
        for a, z in zip(cuts, [*cuts[1:], len(row)], strict=True)
    ]


def covered(places: np.ndarray, size: int, length: int) -> int:
    """How many of ``length`` words lie in runs of ``size`` words from these places."""
    edge = np.zeros(length + size + 1, int)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + size, -1)
    return int((np.cumsum(edge)[:length] > 0).sum())


def match(texts: pa.Array, index: Index, min_match: int, coverage: float) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(row, item, share of the item's words in tiles, tiles) of the pairs that reach ``coverage``."""
    words = T.words_of(texts, T.ALNUM)
    h = words.hashes()
    out = []
    for row, item, place, inside in _candidates(words, h, index, min_match):
        wanted = index.words[item]
        size = min(len(wanted), min_match)
        # Tiles consist of seeds, so that seeds bound what tiles can cover.
        if covered(np.unique(inside), size, len(wanted)) < coverage * len(wanted):
            continue
        # Only words in shared seeds can be in a tile. Stretches without them shrink to one gap,
        # a hash that no item has.
        used = np.unique(np.add.outer(place, np.arange(size)).ravel())
        jump = np.flatnonzero(np.diff(used) > 1) + 1
        origin = np.insert(used, jump, -1)
        own = h[words.bounds[row] : words.bounds[row + 1]]
        document = np.where(origin >= 0, own[origin], np.uint64(0))
        placed = [(int(origin[p]), q, n) for p, q, n in tiles(document, wanted, size)]
        share = sum(n for _, _, n in placed) / len(wanted)
        if share >= coverage:
            out.append((row, item, share, sorted(placed)))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in as many parts as its size asks for."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    n = -(-size // block_bytes)
    part = F.pmod(F.xxhash64(item, text), F.lit(max(n, 1)))
    return [benchmark.where(part == i).select(item, text) for i in range(n)]


def _indexes(benchmark: DataFrame, item: str, text: str, min_match: int, block_bytes: int) -> list:
    """One broadcast index for each block."""
    out = []
    for block in blocks(benchmark, item, text, block_bytes):
        rows = block.collect()
        index = build_index([r[0] for r in rows], [r[1] for r in rows], min_match)
        out.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item that it contains: (key, item, coverage, n_tiles,
    longest_tile, first_word, last_word), words of the document counted from 0."""
    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"{key} {{key}}, {item} {kind}, coverage double, n_tiles int, longest_tile int, first_word int, last_word int"

    def one(held) -> DataFrame:
        def work(piece: pa.RecordBatch) -> dict:
            found = match(piece.column(1), held.value, min_match, coverage)
            return {
                key: piece.column(0).take(pa.array([r for r, *_ in found], pa.int64())),
                item: [held.value.items[i] for _, i, _, _ in found],
                "coverage": [share for _, _, share, _ in found],
                "n_tiles": [len(t) for *_, t in found],
                "longest_tile": [max(n for _, _, n in t) for *_, t in found],
                "first_word": [min(p for p, _, _ in t) for *_, t in found],
                "last_word": [max(p + n for p, _, n in t) - 1 for *_, t in found],
            }

        return T.map_texts(docs, key, text, schema, work)

    parts = [one(held) for held in _indexes(benchmark, item, text, min_match, block_bytes)]
    if not parts:
        return T.map_texts(docs.limit(0), key, text, schema, lambda piece: {})
    return reduce(DataFrame.unionAll, parts)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""

    def clean(held):
        def keep(texts: pa.Array) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[r for r, *_ in match(texts, held.value, min_match, coverage)]] = False
            return out

        return keep

    for held in _indexes(benchmark, item, text, min_match, block_bytes):
        docs = T.filter_texts(docs, text, clean(held))
    return docs
