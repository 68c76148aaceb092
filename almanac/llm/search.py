"""Exact top-k search by BM25 over inverted indexes of shards, with block-max pruning.

Each task indexes its documents in shards of bounded size. A shard's postings are cut into blocks
of ``BLOCK`` neighbouring documents, each list keeping its greatest score in every block. For a
query, the sum of these maxima bounds every score in a block; blocks are scored in descending
order of the bound, and as soon as the k-th best score exceeds it, the rest is skipped. Documents
that have the same frequent words are neighbours, so that bounds are tight.

Maxima of terms that most blocks hold would say little. So the scores of a shard's most frequent terms
also stand in a matrix, whose product with many queries at once gives each document's sum of them; the
greatest one of a block goes into its bound. Where a k-th score is known, the scores of the rarer terms take the
place of their maxima, for many queries at once, and only the documents that can still be a result are scored, in the
blocks whose bound reaches it.
The matrix has single precision and only bounds; scores come from the postings. Scores use the number,
average length and document frequencies of all documents, so that the best of every
shard merge into the exact result.

Documents are searched in slices by a hash of their key, each several times as large as all before it.
What a slice found bounds the k-th score of every query from below, and the next slice starts from
these bounds: its tasks prune with them from their first block on, carry their own best from shard to shard,
and hand on only what can still be among the best. The first slice has no bounds yet and is gathered in a few
tasks. So each slice hands on a few times as many rows as there are results, however many shards it has.

The query set is worked through in blocks of bounded size, one after the other, each broadcast to all tasks. All
documents are indexed once for each block, so blocks are large: queries are cut into terms by tasks, and the driver
holds numbers of terms alone.

The score of a document is the sum over the query's distinct terms; terms are runs of digits,
letters and anything beyond ASCII, lower-cased. Only documents with a common term are results.
Equal scores go by key, nulls last. Every repeated row of the documents is a result of its own;
repeated query rows are one query. Null and empty texts have no terms. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm import text as T
from almanac.sources.sinks import stored

K = 10
K1, B = 1.2, 0.75
BLOCK = 32
# Blocks that are scored at first; each further step takes four times as many.
FIRST_BLOCKS = 4
# Most bytes of text in a shard, and of query text in a block of queries.
SHARD_BYTES = 12 << 20
QUERY_BYTES = 128 << 20
# The most frequent terms by which a shard's documents are ordered.
SORT_TERMS = 24
# A term in more than one of so many documents of a shard is frequent.
FREQUENT = 32
# Most cells of a shard's matrix of frequent terms and documents (the less frequent ones beyond that count as rare), and of its
# product with some queries; half as many postings of some queries' rarer terms. A single query may have more.
CELLS = 1 << 21
# Bounds are sums of floats in another order than scores.
SLACK = 1e-9
# Documents in the first slice, and how many times as many each further one reaches up to.
FIRST_SLICE, GROWTH = 4096, 4
# Least number of tasks for the first slice; more if its texts fill more shards.
FIRST_TASKS = 4
HASHES = 1 << 20
# Queries whose results a task hands on at once.
OUT = 4096


@dataclass
class Queries:
    """A block of queries: their keys, the terms of all, and the terms of each."""

    keys: list
    terms: np.ndarray
    offsets: np.ndarray
    members: np.ndarray


def read_queries(rows: list) -> Queries:
    hashes, offsets = distinct_hashes(pa.array([r[1] for r in rows], pa.string()))
    return numbered([r[0] for r in rows], [hashes], offsets)


def distinct_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's terms, ascending, and where each row's begin and end."""
    w = T.words_of(texts, T.ALNUM)
    h, row = w.hashes(), w.rows()
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(w.bounds)))


def numbered(keys: list, hashes: list[np.ndarray], offsets: np.ndarray) -> Queries:
    """Queries with a number for each term that any of them has; their terms' hashes come in parts."""
    none = np.zeros(0, np.uint64)
    terms = np.unique(np.concatenate([none, *map(np.unique, hashes)]))
    return Queries(keys, terms, offsets, np.concatenate([none.astype(np.int32), *[places_of(terms, h).astype(np.int32) for h in hashes]]))


def _gathered(asked: DataFrame) -> Queries:
    """The queries (q, t), cut into terms by tasks."""
    ddl = f"q {asked.schema['q'].dataType.simpleString()}, terms binary"
    schema = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "t"):
                h, at = distinct_hashes(piece.column(1))
                terms = [h[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(terms, pa.binary())], schema=schema)

    found = asked.mapInArrow(run, ddl).toArrow()
    parts = [T.as_bytes(x) for x in found.column("terms").chunks]
    sizes = [np.diff(at) // 8 for _, at in parts]
    return numbered(found.column("q").to_pylist(), [x.view(np.uint64) for x, _ in parts], np.r_[0, np.cumsum(np.concatenate([[], *sizes]))].astype(np.int64))


def places_of(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """As ``np.searchsorted(terms, h)``, for hashes: the first bits of each name the few places where it can stand."""
    bits = min(len(terms).bit_length() + 2, 24)
    shift = np.uint64(64 - bits)
    n = np.bincount((terms >> shift).astype(np.int64), minlength=1 << bits)
    at = (np.cumsum(n) - n)[(h >> shift).astype(np.int64)]
    left = np.flatnonzero(at < len(terms))
    while len(left := left[terms[at[left]] < h[left]]):
        at[left] += 1
        left = left[at[left] < len(terms)]
    return at


def term_rows(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, frequency) of the given terms, by term and row, and the number of words of each row."""
    w = T.words_of(texts, T.ALNUM)
    h = w.hashes()
    lengths = np.diff(w.bounds)
    if not len(terms) or not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, lengths
    at = np.minimum(places_of(terms, h), len(terms) - 1)
    known = terms[at] == h
    both, count = np.unique(at[known] * len(lengths) + w.rows()[known], return_counts=True)
    return both // len(lengths), both % len(lengths), count, lengths


class Shard:
    """An inverted index of some documents with the greatest score of each list in each block."""

    def __init__(self, texts: list[pa.Array], terms: np.ndarray, idf: np.ndarray, average: float):
        parts, lengths, before = [], [], 0
        for piece in texts:
            t, r, f, n = term_rows(piece, terms)
            parts.append((t, r + before, f))
            lengths.append(n)
            before += len(n)
        term, row, often = (np.concatenate(x) for x in zip(*parts, strict=True))
        length = np.concatenate(lengths)
        self.rows = before
        # Documents with the same frequent terms become neighbours.
        df = np.bincount(term, minlength=len(terms))
        common = np.flatnonzero(df)
        common = common[np.argsort(-df[common], kind="stable")]
        marks = common[:SORT_TERMS]
        bit = np.full(len(terms), -1)
        bit[marks] = np.arange(len(marks))
        mine = bit[term] >= 0
        pattern = np.zeros(before, np.int64)
        np.bitwise_or.at(pattern, row[mine], np.int64(1) << bit[term[mine]])
        self.order = np.lexsort((length, pattern))
        place = np.empty(before, np.int64)
        place[self.order] = np.arange(before)
        row = place[row]
        by = np.argsort(term * max(before, 1) + row)
        term, self.row, often, length = term[by], row[by], often[by], length[self.order]
        norm = K1 * (1 - B + B * length / max(average, 1e-9))
        self.score = idf[term] * often * (K1 + 1) / (often + norm[self.row])
        self.blocks = -(-before // BLOCK)
        entry = term * max(self.blocks, 1) + self.row // BLOCK
        self.first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if len(entry) else np.zeros(0, np.int64)
        self.after = np.r_[self.first[1:], len(entry)].astype(np.int64)
        self.entry_block = entry[self.first] % max(self.blocks, 1)
        self.most = np.maximum.reduceat(self.score, self.first) if len(entry) else np.zeros(0)
        self.of_term = np.r_[0, np.cumsum(np.bincount(term[self.first], minlength=len(terms)))]
        # Where each term's postings begin, and their scores rounded up.
        self.run = np.r_[0, np.cumsum(df)]
        self.upper = np.nextafter(self.score.astype(np.float32), np.float32(np.inf))
        # The most frequent terms' scores as a matrix, and the place of their entry for each block.
        common = common[: CELLS // max(self.blocks * BLOCK, 1)]
        common = common[df[common] * FREQUENT > before]
        if len(common) < BLOCK:
            # Maxima are fewer than the matrix's sums then, as for very many short texts.
            common = common[:0]
        self.slot = np.full(len(terms), -1)
        self.slot[common] = np.arange(len(common))
        slot = self.slot[term]
        self.matrix = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.matrix[slot[slot >= 0], self.row[slot >= 0]] = self.score[slot >= 0]
        slot = slot[self.first]
        self.entry_at = np.full((len(common), self.blocks), -1)
        self.entry_at[slot[slot >= 0], self.entry_block[slot >= 0]] = np.flatnonzero(slot >= 0)
        # The postings by document as well, and marks for the terms of a query.
        by = np.argsort(self.row.astype(np.min_scalar_type(max(before, 1))), kind="stable")
        self.begin = np.r_[0, np.cumsum(np.bincount(self.row, minlength=self.blocks * BLOCK))]
        self.term_of, self.score_of = term[by].astype(np.int32), self.score[by]
        self.asked = np.zeros(len(terms), bool)

    def search(self, query: np.ndarray, k: int, rank: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k documents that score ``floor`` or more, equal scores by ``rank``."""
        return next(self.search_all(query, np.array([0, len(query)]), k, rank, [floor]))

    def search_all(
        self, members: np.ndarray, offsets: np.ndarray, k: int, rank: np.ndarray, floors: Sequence[float]
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each of many queries, query i of the terms members[offsets[i]] up to members[offsets[i + 1]]."""
        every = max(CELLS // max(self.matrix.shape), 1)
        rare = np.where(self.slot < 0, np.diff(self.run), 0)
        for begin in range(0, len(offsets) - 1, every):
            # As many queries at a time as keep the arrays small.
            cuts = offsets[begin : begin + every + 1]
            partials = self._frequent(members[cuts[0] : cuts[-1]], cuts - cuts[0])
            own = np.r_[0, np.cumsum(rare[members[cuts[0] : cuts[-1]]])][cuts - cuts[0]]
            at = 0
            while at < len(partials):
                to = min(at + max(every // 8, 1), int(np.searchsorted(own, own[at] + CELLS // 2, "right")) - 1)
                to = max(to, at + 1)
                cut, asked, partial = cuts[at : to + 1] - cuts[at], members[cuts[at] : cuts[to]], partials[at:to]
                low = [floors[begin + i] for i in range(at, to)]
                known = [x > -np.inf and len(self.matrix) > 0 for x in low]
                docs, bounds, where = self._candidates(asked, cut, partial, low) if any(known) else (None, None, None)
                for i, part in enumerate(partial):
                    query = asked[cut[i] : cut[i + 1]]
                    if not known[i]:
                        yield self._best(query, k, rank, low[i], part)
                    elif where[i] < where[i + 1]:
                        yield self._among(query, k, rank, low[i], docs[where[i] : where[i + 1]], bounds[where[i] : where[i + 1]])
                    else:
                        yield np.zeros(0, np.int64), np.zeros(0)
                at = to

    def _frequent(self, members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By query, block and document: the most that it can score by frequent terms."""
        n = len(offsets) - 1
        query, slot = np.repeat(np.arange(n), np.diff(offsets)), self.slot[members]
        known = slot >= 0
        asked = np.zeros((n, len(self.matrix)), np.float32)
        asked[query[known], slot[known]] = 1
        if not len(self.matrix):
            return np.zeros((n, self.blocks, 1), np.float32)
        partial = (asked @ self.matrix).reshape(n, self.blocks, BLOCK)
        # A sum of m numbers of 24 bits is short by less than m + 1 roundings.
        partial *= np.float32(1 + (len(self.matrix) + 3) * 2.0**-23)
        return partial

    def _candidates(
        self, members: np.ndarray, offsets: np.ndarray, partial: np.ndarray, floors: list[float]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that may reach their query's floor, with the most that each can score, and where those of each query begin and end."""
        n, width = len(offsets) - 1, self.blocks * BLOCK
        base = np.repeat(np.arange(0, n * width, width), np.diff(offsets))
        rare = self.slot[members] < 0
        members, base = members[rare], base[rare]
        start, stop = self.run[members], self.run[members + 1]
        at = ranges(start, stop)
        cell = self.row.take(at, mode="clip")
        cell += np.repeat(base, stop - start)
        total = np.bincount(cell, self.upper.take(at, mode="clip"), minlength=n * width).reshape(partial.shape)
        total = total + partial
        under = np.array([_just_under(x) for x in floors])
        bound = total.max(axis=2)
        query, block = np.nonzero((bound > 0) & (bound >= under[:, None]))
        # In these blocks alone single documents are looked at.
        total = total[query, block]
        some, place = np.nonzero((total > 0) & (total >= under[query, None]))
        return block[some] * BLOCK + place, total[some, place], np.searchsorted(query[some], np.arange(n + 1))

    def _among(
        self, query: np.ndarray, k: int, rank: np.ndarray, floor: float, docs: np.ndarray, bounds: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """``search`` among the given documents by the most that each can score."""
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        worst, done, step = floor, 0, 2 * k
        order = np.argsort(-bounds, kind="stable")
        self.asked[query] = True
        while done < len(order) and bounds[order[done]] >= _just_under(worst):
            picked = docs[order[done : done + step]]
            done += step
            step *= 4
            # By term, so that scores are sums in one order always.
            at = ranges(self.begin[picked], self.begin[picked + 1])
            own = np.repeat(np.arange(len(picked)), self.begin[picked + 1] - self.begin[picked])
            mine = self.asked[self.term_of[at]]
            total = np.bincount(own[mine], self.score_of[at[mine]], minlength=len(picked))
            hit = np.flatnonzero(total >= _just_under(worst) if worst > 0 else total)
            places = np.concatenate((places, picked[hit]))
            scores = np.concatenate((scores, total[hit]))
            best = np.lexsort((rank[places], -scores))[:k]
            places, scores = places[best], scores[best]
            if len(scores) == k:
                worst = max(floor, scores[-1])
        self.asked[query] = False
        return places, scores

    def _best(self, query: np.ndarray, k: int, rank: np.ndarray, floor: float, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for one query by the maxima of blocks and its documents' partial scores."""
        slot = self.slot[query]
        rare = query[slot < 0]
        slot = slot[slot >= 0]
        entries = ranges(self.of_term[rare], self.of_term[rare + 1])
        sharp = not len(self.matrix)
        bound = np.bincount(self.entry_block[entries], self.most[entries], minlength=self.blocks) + partial.max(axis=1)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        worst, done, step = floor, 0, FIRST_BLOCKS
        order = np.flatnonzero((bound > 0) & (bound >= _just_under(worst)))
        order = order[np.argsort(-bound[order], kind="stable")]
        while done < len(order) and bound[order[done]] >= _just_under(worst):
            if worst > -np.inf and not sharp:
                # The rarer terms' scores instead of their maxima, once there is something to compare them with.
                order, done, sharp = order[done:], 0, True
                total = self._totals(entries[self._within(order)[self.entry_block[entries]]], self.blocks * BLOCK)
                bound = np.zeros(self.blocks)
                bound[order] = (total.reshape(self.blocks, BLOCK)[order] + partial[order]).max(axis=1)
                order = order[bound[order] >= _just_under(worst)]
                order = order[np.argsort(-bound[order], kind="stable")]
                continue
            # More and more blocks at a time, but none whose bound is below the k-th score.
            picked = order[done : done + step]
            picked = picked[bound[picked] >= _just_under(worst)]
            done += step
            step *= 4
            mine = self.entry_at[np.ix_(slot, picked)].ravel()
            # By term, so that scores are sums in one order always.
            mine = np.sort(np.concatenate((mine[mine >= 0], entries[self._within(picked)[self.entry_block[entries]]])))
            total = self._totals(mine, self.rows)
            hit = np.flatnonzero(total >= _just_under(worst) if worst > 0 else total)
            places = np.concatenate((places, hit))
            scores = np.concatenate((scores, total[hit]))
            best = np.lexsort((rank[places], -scores))[:k]
            places, scores = places[best], scores[best]
            if len(scores) == k:
                worst = max(floor, scores[-1])
        return places, scores

    def _within(self, blocks: np.ndarray) -> np.ndarray:
        """For each block, whether it is one of the given."""
        out = np.zeros(self.blocks, bool)
        out[blocks] = True
        return out

    def _totals(self, entries: np.ndarray, rows: int) -> np.ndarray:
        """Each document's score by some entries."""
        at = ranges(self.first[entries], self.after[entries])
        return np.bincount(self.row[at], self.score[at], minlength=rows)


def _just_under(score: float) -> float:
    return score - SLACK * abs(score) if score > -np.inf else score


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0] - 1, start[1] .. stop[1] - 1, and so on."""
    n = stop - start
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def _statistics(docs: DataFrame, key: str, text: str, held) -> tuple[int, float, float, np.ndarray]:
    """Number of documents, their average length in words and in bytes, and each term's document frequency."""
    ddl = "term int, n long"
    schema = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The numbers of documents, words and bytes stand behind those of the terms.
        terms = held.value.terms
        count = np.zeros(len(terms) + 3, np.int64)
        for batch in batches:
            for piece in T.pieces(batch, limit=T.PIECE_BYTES * 4):
                term, _, _, lengths = term_rows(piece.column(0), terms)
                count[: len(terms)] += np.bincount(term, minlength=len(terms))
                count[len(terms) :] += len(lengths), lengths.sum(), piece.column(0).nbytes
        known = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(count[known])], schema=schema)

    counted = docs.select(docs[text].alias("text")).mapInArrow(run, ddl).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(held.value.terms) + 3)
    total[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    n, words, size = total[-3:]
    return int(n), words / max(n, 1), size / max(n, 1), total[:-3]


def search(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", k: int = K,
    shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_key, rank, key, score): the best k documents for each (query_key, text) of ``queries``."""
    asked = queries.select(queries[query_key].alias("q"), F.coalesce(queries[text], F.lit("")).alias("t")).distinct()
    size = asked.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = -(-size // query_bytes)
    part = F.pmod(F.xxhash64("q", "t"), F.lit(max(parts, 1)))
    frame = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kinds = queries.schema[query_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    ddl = f"number int, q {kinds[0]}, key {kinds[1]}, score double"
    schema = T.arrow_schema(ddl)

    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())

    def block(number: int) -> DataFrame:
        """The best k documents of a block's queries."""
        context = docs.sparkSession.sparkContext
        held = context.broadcast(_gathered(asked.where(part == number)))
        n, average, width, df = _statistics(docs, key, text, held)
        idf = context.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
        best, floors, reached = None, np.full(len(held.value.keys), -np.inf), 0
        documents = FIRST_SLICE
        while best is None or reached < HASHES:
            upto = HASHES if documents >= n else int(HASHES * documents / n)
            place = F.pmod(F.xxhash64("key"), F.lit(HASHES))
            slice_ = frame.where((place >= reached) & (place < upto))
            if best is None and upto < HASHES:
                slice_ = slice_.repartition(max(FIRST_TASKS, math.ceil(width * documents / shard_bytes)))
            at_least = context.broadcast(floors)
            found = slice_.mapInArrow(_searching(held, idf, at_least, average, k, shard_bytes, schema), ddl)
            every = found if best is None else best.unionAll(found)
            best = stored(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
            if upto < HASHES:
                # One number for each query of the block.
                for r in best.groupBy("number").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).toLocalIterator():
                    floors[r["number"]] = r["score"]
            at_least.unpersist()
            reached, documents = upto, documents * GROWTH
        held.unpersist()
        idf.unpersist()
        return best.withColumn("rank", F.row_number().over(order))

    blocks = [block(i) for i in range(parts)]
    if not blocks:
        blocks = [docs.sparkSession.createDataFrame([], f"{ddl}, rank int")]
    found = reduce(DataFrame.unionAll, blocks)
    return found.select(F.col("q").alias(query_key), "rank", F.col("key").alias(key), "score")


def _searching(held, idf, at_least, average: float, k: int, shard_bytes: int, schema: pa.Schema):
    """A task's search: its documents in shards, the best k of all of them for each query, if they can still be results."""
    ordered = lambda x: (-x[0], x[1] is None, x[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floors = held.value, at_least.value.copy()
        best: list[list[tuple]] = [[] for _ in q.keys]

        def answer(keys: list, texts: list[pa.Array]) -> None:
            shard = Shard(texts, q.terms, idf.value, average)
            own = [keys[i] for i in shard.order]
            rank = np.empty(len(own), np.int64)
            rank[sorted(range(len(own)), key=lambda i: (own[i] is None, own[i]))] = np.arange(len(own))
            for i, (places, scores) in enumerate(shard.search_all(q.members, q.offsets, k, rank, floors)):
                if len(places):
                    best[i] = sorted([*best[i], *zip(scores.tolist(), (own[p] for p in places), strict=True)], key=ordered)[:k]
                    if len(best[i]) == k:
                        floors[i] = max(floors[i], best[i][-1][0])

        keys: list = []
        texts: list[pa.Array] = []
        size = 0
        for batch in batches:
            for piece in T.pieces(batch):
                keys += piece.column(0).to_pylist()
                texts.append(piece.column(1))
                size += piece.column(1).nbytes
                if size >= shard_bytes:
                    answer(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            answer(keys, texts)
        for at in range(0, len(best), OUT):
            out = [(i, q.keys[i], key, score) for i, found in enumerate(best[at : at + OUT], at) for score, key in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run
