"""Licence scan: identifier tags and notice phrases by Aho-Corasick, licence expressions by shunting yard.

A text is lower-cased (A-Z) and cut into words of ASCII digits and letters and of anything beyond
ASCII. Phrases are found where their words stand consecutively. Tags are found in the lower-cased
text itself, and the expression after a tag is evaluated.

Nulls and empty texts have no words and no labels. Each input row gives one output row, repeated
rows included; columns other than the key and the text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm import text as T

# Phrases and labels of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases of common licences.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "isc license": "isc",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ["spdx-license-identifier:", "license-expression:"]

# How sure a single find makes us that a text carries the licence it names.
TAG_WEIGHT, NOTICE_WEIGHT, BASE_WEIGHT = 0.9, 0.7, 0.5
# Obligations grow with the level; what is not listed counts as PERMISSIVE.
PERMISSIVE, WEAK, STRONG = 1, 2, 3
LEVELS = {"gpl": STRONG, "agpl": STRONG, "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "cc0": 0, "unlicense": 0}

_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+_-]*")
_RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, expressions array<string>, level int, score double"
)


def level_of(identifier: str) -> int:
    return LEVELS.get(identifier.split("-")[0], PERMISSIVE)


def parse_expression(source: str) -> list[str] | None:
    """A licence expression in postfix order, or None if it is not well formed. WITH binds
    tighter than AND, and AND tighter than OR."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand is due
    for token in _TOKEN.findall(source):
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def _written(node: str | tuple) -> str:
    """The text of an expression's tree with all brackets, without recursion."""
    out, due = [], [node]
    while due:
        x = due.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left, token, right = x
            due += [")", right, f" {token} ", left, "("]
    return "".join(out)


def evaluate(postfix: list[str]) -> tuple[str, set[str], int] | None:
    """The expression with all brackets written, the identifiers it names, and its level: a choice
    (or) has the least level of its sides, a combination (and) the greatest, and an exception
    (with) lowers strong obligations to weak ones. None if an exception is not a plain name."""
    stack: list[tuple[str | tuple, int]] = []
    named: Counter[str] = Counter()
    for token in postfix:
        if token not in _RANK:
            stack.append((token, level_of(token)))
            named[token] += 1
            continue
        (right, right_level), (left, left_level) = stack.pop(), stack.pop()
        if token == "with":
            if not isinstance(right, str):
                return None
            # The exception is not a licence.
            named[right] -= 1
            level = min(left_level, WEAK)
        else:
            level = min(left_level, right_level) if token == "or" else max(left_level, right_level)
        stack.append(((left, token, right), level))
    tree, level = stack[0]
    return _written(tree), set(+named), level


_PART = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+_-]*)")


def complete_prefix(tokens: list[str]) -> int:
    """How many of the tokens make the longest well-formed expression that starts them: one pass,
    which remembers the last place with an operand given and no bracket open."""
    best, operand = 0, True
    # Of the brackets' inside: whether it has an operator, whether an exception is due, whether its operand is a plain name.
    operator = due = plain = False
    outside: list[tuple[bool, bool]] = []
    for i, token in enumerate(tokens, 1):
        if (token in _RANK or token == ")") == operand:
            break
        if token == "(":
            outside.append((operator, due))
            operator = due = False
        elif token in _RANK:
            operator, due, operand = True, token == "with", True
        else:
            if token == ")":
                if not outside:
                    break
                plain = plain and not operator
                operator, due = outside.pop()
            else:
                plain, operand = True, False
            if due and not plain:
                break
            due = False
            if not outside:
                best = i
    return best


def leading_expression(line: str) -> tuple[str, set[str], int] | None:
    """The longest well-formed expression that the line starts with."""
    tokens, at = [], 0
    while m := _PART.match(line, at):
        tokens.append(m[1])
        at = m.end()
    postfix = parse_expression(" ".join(tokens[: complete_prefix(tokens)]))
    return evaluate(postfix) if postfix else None


@lru_cache(maxsize=1)
def _machines() -> tuple:
    """Automata for phrases (over words that single spaces part and surround) and for tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for group, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in group.items():
            phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, base))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def _scan(texts: pa.Array) -> dict[str, list]:
    phrases, tags = _machines()
    w = T.words_of(texts, T.ALNUM)
    rows = len(w.offsets) - 1
    n_words = np.diff(w.bounds)
    # The words of a row with one space before each and one after the last, then a line end.
    lengths = w.ends - w.starts
    at = np.cumsum(lengths + 1) - lengths + 2 * w.rows()
    ends = np.cumsum(np.concatenate(([0], lengths + 1)))[w.bounds[1:]] + 2 * np.arange(1, rows + 1)
    line = np.full(int(ends[-1]) if rows else 0, 0x20, np.uint8)
    line[ends - 1] = 0x0A
    held = np.cumsum(lengths) - lengths
    line[np.arange(int(lengths.sum())) + np.repeat(at - held, lengths)] = w.data[w.inside]

    found: list[list[tuple[int, str, bool]]] = [[] for _ in range(rows)]
    for end, (size, label, base) in phrases.iter(line.tobytes().decode("latin-1")):
        word = int(np.searchsorted(at, end - size + 2))
        row = int(np.searchsorted(w.bounds, word, "right")) - 1
        found[row].append((word - int(w.bounds[row]), label, base))
    named: list[list[tuple[str, set[str], int]]] = [[] for _ in range(rows)]
    raw = w.data.tobytes().decode("latin-1")
    for end, _ in tags.iter(raw):
        row = int(np.searchsorted(w.offsets, end, "right")) - 1
        stop = int(w.offsets[row + 1])
        to = raw.find("\n", end, stop)
        if result := leading_expression(raw[end + 1 : stop if to < 0 else to]):
            named[row].append(result)

    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for row in range(rows):
        base = [(k, label) for k, label, is_base in found[row] if is_base]
        labels = {label for _, label, _ in found[row]}
        doubt = 1.0
        for _, _, is_base in found[row]:
            doubt *= 1 - (BASE_WEIGHT if is_base else NOTICE_WEIGHT)
        for _, names, _ in named[row]:
            doubt *= 1 - TAG_WEIGHT
            labels |= names
        levels = [level for _, _, level in named[row]] + [level_of(label) for _, label, _ in found[row]]
        out["n_words"].append(int(n_words[row]))
        out["n_base"].append(len(base))
        out["first_word"].append(min(k for k, _ in base) if base else None)
        out["last_word"].append(max(k for k, _ in base) if base else None)
        out["base_labels"].append(sorted({label for _, label in base}))
        out["labels"].append(sorted(labels))
        out["expressions"].append(sorted({text for text, _, _ in named[row]}))
        out["level"].append(max(levels) if levels else None)
        out["score"].append(1 - doubt)
    return out


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence finds of each text: number of words, places of the base phrases, labels, normalised
    expressions, the strictest level named, and a score from 0 (no evidence) to 1."""
    return T.map_texts(docs, key, text, f"{key} {{key}}, {SCHEMA}", lambda piece: {key: piece.column(0), **_scan(piece.column(1))})
