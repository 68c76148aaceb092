"""Byte-pair encoding and decoding with the files of public tokenizers.

Encoding works on all distinct words of a piece of a partition at once. An index holds, for each
pair that has a merge rank, all its positions among these words. The active ranks are applied in
ascending order: one rank merges all its positions at once, and the pairs this makes are added to
the lists of their own ranks, which come later. The ids of a text are those of its words.

Normalising and cutting a text into words follow the tokenizer's file. Words of plain letters,
digits and signs below U+0250 are cut here; others by the tokenizer's own normaliser and cutter.
Strings of special tokens become their ids, as the tokenizer's library does.

A null or empty text has no ids and decodes to an empty text. Every row gives one row.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from almanac.llm import text as T

# Most bytes of text that share one pair index.
PIECE_BYTES = 5 << 20
END = "</w>"
# What the tokenizer takes for white space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PLAIN = re.compile("[!-~\xa1-\u024f]+")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others for the code points from 256 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-end byte-pair vocabulary, read from a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids: dict[str, int] = data["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.back = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + END] for x in letters], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.left, self.right = left, right
        pairs = left << 32 | right
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        # A product that a lower rank takes up again would have to go before the rank's other positions.
        first_use = np.full(len(self.tokens), len(merges), np.int64)
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        self.one_by_one = first_use[self.made] <= np.arange(len(merges))
        # The file's own normaliser and cutter, for words beyond the plain ones.
        self.library = Tokenizer.from_file(path)
        self.split_special = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, -1 for pairs without one."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.order[at], -1)

    def cut(self, chunk: str) -> list[str | int]:
        """The words of a run without white space, as strings or special ids."""
        if self.split_special and "<" in chunk and self.split_special.search(chunk):
            out: list[str | int] = []
            for part in self.split_special.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self.cut(part)
            return out
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if _PLAIN.fullmatch(chunk):
            return _WORD.findall(chunk.lower())
        normal = self.library.normalizer.normalize_str(chunk)
        return [bytes(self.back[c] for c in word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(v: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which symbols are left, after merging in place; ``word`` numbers the word of each symbol."""
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
    after[ends] = -1
    before[np.r_[0, ends[:-1] + 1]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Enters the pairs that start at these positions."""
        ranks = v.ranks(symbols[at], symbols[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, group in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(at, cuts), strict=False):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(group)

    add(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = v.left[rank], v.right[rank]
        # Positions that merged meanwhile no longer hold this pair.
        at = at[alive[at] & (symbols[at] == left) & (after[at] >= 0)]
        at = at[symbols[after[at]] == right]
        if v.one_by_one[rank] and len(at) > 1:
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(active, rank)
                at = at[first]
        elif left == right and len(at) > 1:
            # In a run of one symbol every second pair merges, from the left.
            linked = np.r_[False, after[at[:-1]] == at[1:]]
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(linked, 0, place))
            at = at[(place - run) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbols[at] = v.made[rank]
        alive[gone] = False
        follows = after[gone]
        after[at] = follows
        before[follows[follows >= 0]] = at[follows >= 0]
        add(np.unique(np.concatenate((at[follows >= 0], before[at][before[at] >= 0]))))
    return alive


def gather(offsets: np.ndarray, values: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a ragged array, the rows ``picked`` one after another: lengths and values."""
    lengths = (offsets[1:] - offsets[:-1])[picked]
    total = int(lengths.sum())
    shift = offsets[:-1][picked] - (np.cumsum(lengths) - lengths)
    return lengths, values[np.arange(total) + np.repeat(shift, lengths)]


def encode_words(v: Vocabulary, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of each word."""
    plain = np.array([isinstance(w, str) for w in words], bool)
    data = b"".join(w.encode() if isinstance(w, str) else b"x" for w in words)
    lengths = np.array([len(w.encode()) if isinstance(w, str) else 1 for w in words], np.int64)
    stops = np.cumsum(lengths)
    raw = np.frombuffer(data, np.uint8)
    symbols = v.inner[raw]
    symbols[stops - 1] = v.last[raw[stops - 1]]
    if not plain.all():
        symbols[stops[~plain] - 1] = [w for w in words if not isinstance(w, str)]
    word = np.repeat(np.arange(len(words)), lengths)
    alive = merge_all(v, symbols, word)
    counts = np.bincount(word[alive], minlength=len(words))
    return np.r_[0, np.cumsum(counts)], symbols[alive]


def encode_texts(v: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """Ids of each text of an Arrow column."""
    texts = texts.fill_null("")
    data, _ = T.as_bytes(texts)
    if ((data >= 0x1C) & (data <= 0x1F)).any():
        # Arrow would also cut at these four; the tokenizer does not.
        chunks = pa.array([[c for c in _SPACE.split(t) if c] for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        chunks = pc.utf8_split_whitespace(texts)
    bounds = chunks.offsets.to_numpy().astype(np.int64)
    flat = chunks.values.dictionary_encode()
    words: dict[str | int, int] = {}
    cuts, members = [0], []
    for chunk in flat.dictionary.to_pylist():
        if chunk:
            for word in v.cut(chunk):
                members.append(words.setdefault(word, len(words)))
        cuts.append(len(members))
    if not words:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
    word_offsets, word_ids = encode_words(v, list(words))
    cuts, members = np.array(cuts, np.int64), np.array(members, np.int64)
    lengths, ids = gather(word_offsets, word_ids, members)
    # Ids of each distinct run without white space.
    chunk_offsets = np.r_[0, np.cumsum(lengths)][cuts]
    lengths, ids = gather(chunk_offsets, ids, flat.indices.to_numpy().astype(np.int64))
    offsets = np.r_[0, np.cumsum(lengths)][bounds]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each whole text. ``path`` names the tokenizer's file on every executor."""

    def work(piece: pa.RecordBatch) -> dict:
        return {key: piece.column(0), "ids": encode_texts(vocabulary(path), piece.column(1))}

    return T.map_texts(docs, key, text, f"{key} {{key}}, ids array<int>", work, PIECE_BYTES)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the tokens of the ids with a space between neighbours. A null list has no tokens."""
    kind = encoded.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, ids array<int>, decoded string"
    out = T.arrow_schema(ddl)

    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            # Decoded texts are several times as large as their ids.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [" ".join([tokens[i] for i in row or ()]) for row in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=out)

    return encoded.select(key, ids).mapInArrow(run, ddl)
