from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from almanac.llm import interaction as I

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = {
    "": "A",
    LONG: "",
    LONG + " #": "D",
    LONG.upper(): "C",
    " ".join(f"w{i % 95}" for i in range(120)): "B",
    "A a a a": "ABC",
    "ÄÖ é 100%": "AD",
    "Aé" * 10: "AC",
    "a\x0bb\x1cc d": "A",
}


def flags(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    failed = [
        len(words) < 100, 100 * len(set(words)) < 80 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text),
    ]
    return {"ABCD"[i] for i, f in enumerate(failed) if f}


def brute(rows, labels):
    """Every order run over the documents, one filter after the other."""
    large = float("inf")
    docs = []
    for k, t, part in rows:
        t = t or ""
        own = flags(t)
        if any((x or "") == t and (large if j is None else j) < (large if k is None else k) for j, x, _ in rows):
            own.add("E")
        mine = [x for x in labels if x[0] == k and k is not None]
        docs.append((part or "", own, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, ever = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                ever[part, f] = ever.get((part, f), 0) + len(now)
                alone = sum(d[0] == part and d[1] == {f} for d in docs)
                redundant = sum(f in d[1] for d in gone)
                out.append([part, "".join(order), step, len(left), len(now), redundant, alone, sum(d[2] for d in now), sum(d[3] for d in now)])
                gone += now
    return sorted((*r, ever[r[0], r[1][r[2] - 1]]) for r in out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return I.audit_filters(docs, known)


def test_flags_of_single_texts():
    masks = I.own_flags(pa.array([*TEXTS, None]))
    assert [sum(1 << "ABCD".index(c) for c in f) for f in [*TEXTS.values(), "A"]] == masks.tolist()
    assert all(flags(t) == set(f) for t, f in TEXTS.items())
    assert I.own_flags(pa.array([], pa.string())).tolist() == []


ROWS = [(i, t, "abc"[i % 3]) for i, t in enumerate([*TEXTS] * 3)]
ROWS += [(3, LONG, None), (3, LONG, None), (3, "other text", ""), (None, LONG, "a"), (None, "only here", "a"), (None, "only here", "a"), (50, None, "b")]
LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 27, 2)] + [(3, 0, None), (3, 1, 1), (None, 1, 1), (77, 1, 1)]


@pytest.mark.parametrize("most", [I.MOST_CELLS, 0])
def test_audit_equals_running_every_order(spark, monkeypatch, most):
    monkeypatch.setattr(I, "MOST_CELLS", most)
    got = run(spark, ROWS, LABELS)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, LABELS)


def test_odd_texts_and_empty_tables(spark, odd_documents):
    rows = [(r.doc_id, r.text, "x") for r in odd_documents.collect()]
    assert sorted(tuple(r) for r in run(spark, rows, []).collect()) == brute(rows, [])
    assert run(spark, [], LABELS).count() == 0


def test_batches_of_several_pieces(spark):
    """More text in a task than is worked on at once, repeats and unique texts mixed."""
    rows = [(i, f"{LONG} {i % 70} " * 120, "x") for i in range(100)]
    assert sum(len(t) for _, t, _ in rows) > 2 * I.T.PIECE_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {r.mask: r.n for r in I.flagged(docs).groupBy("mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    own = sum(1 << "ABCD".index(c) for c in flags(rows[0][1]))
    assert got == {own: 70, own | I.REPEATED: 30}


def test_the_sketch_clears_unique_texts_and_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(I, "HELD", 300)
    r = np.random.default_rng(3)
    hashes = r.integers(-(1 << 63), (1 << 63) - 1, 5000)
    again = r.choice(hashes, 500)
    df = spark.createDataFrame([(int(h),) for h in [*hashes, *again]], "tag long").repartition(7)
    cells = I.sketch_cells(5500)
    marked = I.may_repeat(I.repeat_sketch(df, cells), hashes, cells)
    repeats = np.isin(hashes, again)
    assert marked[repeats].all()
    assert marked[~repeats].mean() < 0.1


def test_a_sketch_has_a_greatest_size():
    assert I.sketch_cells(0) >= 1
    assert I.sketch_cells(1 << 20) == 1 << 23
    assert I.sketch_cells(1 << 30) == 0
