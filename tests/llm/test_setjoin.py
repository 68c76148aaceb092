import random

import numpy as np
import pytest

from almanac.llm import setjoin as S
from almanac.llm.graph import components


def brute(rows, percent=S.PERCENT):
    """(key, n_shingles, component) of (key, text) rows, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\u0001").replace("\x1d", "\u0002")
        w = [x for x in __import__("re").split("[ \t-\r]+", w) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                at[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [k for j, (k, _) in enumerate(rows) if top(j) == top(i) and k is not None]
        out.append((key, len(sets[i]), min(keys) if keys else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(r, families, members, length, edits):
    vocabulary = ["w%d" % i for i in range(3000)]
    boilerplate = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randrange(*length))]
        if f % 3 == 0:
            base = boilerplate + base
        for _ in range(r.randrange(*members)):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w = w[: r.randrange(len(w) * 7 // 10, len(w) + 1)]
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(documents, seed):
    r = random.Random(seed)
    texts = near_copies(r, 30, (1, 12), (5, 160), 6) + ["short one", "Short  ONE", "a", "a", "b", None, "", " \n"]
    rows = list(enumerate(texts))
    assert result(S.link_classes(documents(texts))) == brute(rows)


def test_large_family_in_parts(documents):
    """Families cut into many parts, most members being linked only through others."""
    r = random.Random(5)
    texts = near_copies(r, 2, (70, 80), (60, 80), 9)
    assert result(S.link_classes(documents(texts), family_sets=9)) == brute(list(enumerate(texts)))


def test_chains_of_links(documents):
    """Each text is linked with the next one only."""
    w = ["x%d" % i for i in range(400)]
    texts = [" ".join(w[i * 8 : i * 8 + 100]) for i in range(30)]
    got = result(S.link_classes(documents(texts)))
    assert got == brute(list(enumerate(texts)))
    assert {c for *_, c in got} == {0}


def test_odd_texts(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert result(S.link_classes(odd_documents)) == brute(rows)


def test_empty_tables_and_only_empty_texts(documents):
    assert S.link_classes(documents([])).count() == 0
    assert result(S.link_classes(documents([None, ""]))) == [(0, 0, 0), (1, 0, 1)]


def test_first_of_class_keeps_rows_whole(odd_documents, spark):
    kept = S.first_of_class(odd_documents)
    assert kept.columns == odd_documents.columns
    # Texts 6 and 7 are equal and the row of 4 is repeated; the empty ones and the one without key stay.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.doc_id for r in odd_documents.collect()} - {None, 7})
    assert kept.where("doc_id is null").count() == 1


def test_derived_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(40)]
    for probe, both in zip(sets, S.derived_overlaps(sets[:15], sets), strict=True):
        assert both.tolist() == [len(np.intersect1d(probe, x)) for x in sets[:15]]


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a long, b long"), "a", "b").collect()}
    at = {}

    def top(i):
        while at.setdefault(i, i) != i:
            i = at[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        at[max(x, y)] = min(x, y)
    assert got == {i: top(i) for e in edges if e[0] != e[1] for i in e}


def test_first_of_class_under_clashing_keys(spark):
    """Rows that share a key are judged by their own texts; repeated rows leave one."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve thirteen"
    c = " ".join(f"w{i}" for i in range(60))
    near = c.replace("w59", "other")
    rows = [
        (1, a, "x"), (2, a, "x"), (2, b, "x"), (3, a, "x"), (3, a, "x"), (4, c, "q"), (4, c, "p"), (4, near, "p"), (5, near, "p"), (6, c, "p"),
        (7, None, "n"), (7, "", "n"), (7, a, "n"), (None, a, "k"), (None, a, "k"), (8, None, "m"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _first string").repartition(4)
    got = sorted((tuple(r) for r in S.first_of_class(df).collect()), key=str)
    four = [r for r in got if r[0] == 4]
    assert len(four) == 1 and (four[0][1] == near or four[0] == (4, c, "p"))
    rest = [(1, a, "x"), (2, b, "x"), (7, None, "n"), (7, "", "n"), (None, a, "k"), (None, a, "k"), (8, None, "m")]
    assert sorted((r for r in got if r[0] != 4), key=str) == sorted(rest, key=str)
