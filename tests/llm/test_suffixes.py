import hashlib
import random

import numpy as np
import pytest

from almanac.llm import suffixes as S
from almanac.llm.queries import QUERIES


def brute(rows):
    """(key, n_bytes, n_removed, n_spans, kept) by looking up every string of LENGTH bytes."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    docs = sorted(set(raw), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1]).hexdigest()))
    seen, out = set(), {}
    for k, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - S.LENGTH + 1):
            w = b[i : i + S.LENGTH]
            if w in seen:
                gone[i : i + S.LENGTH] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[k, b] = (k, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return sorted((out[x] for x in raw), key=str)


def result(df):
    return sorted(((*r[:4], bytes(r[4])) for r in S.remove_repeats(df).collect()), key=str)


def mixture(r, n):
    """Texts with shared passages, near copies, copies, periods and edits."""
    letters = "abcdé "
    passage = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [passage(k) for k in (60, 95, 99, 100, 101, 130, 300)]
    texts = []
    for i in range(n):
        t = "".join(r.choice(shared) if r.random() < 0.5 else passage(r.randrange(60)) for _ in range(r.randrange(1, 6)))
        if i % 7 == 0 and texts:
            t = r.choice(texts)
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(["", "x", "yy"]) + t[at + r.randrange(2) :]
        if i % 11 == 0:
            t = passage(r.randrange(1, 9)) * r.randrange(20, 60)
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(documents, seed):
    texts = mixture(random.Random(seed), 120)
    assert result(documents(texts)) == brute(list(enumerate(texts)))


def test_order_of_documents_and_not_of_rows(spark):
    r = random.Random(9)
    texts = mixture(r, 60)
    rows = [(r.randrange(-30, 30) if i % 9 else None, t) for i, t in enumerate(texts)]
    rows += rows[:5]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_texts(odd_documents):
    assert result(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_empty_table(documents):
    assert result(documents([])) == []


def test_sorted_suffixes_and_common_extensions():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    start = rng.integers(0, 380, 90)
    end = np.minimum(start + rng.integers(0, 40, 90), 400)
    group = np.sort(rng.integers(0, 6, 90))
    order, common = S._classes(data, start, end, group)
    strings = [bytes(data[a:z]) for a, z in zip(start, end)]
    assert order.tolist() == sorted(range(90), key=lambda i: (group[i], strings[i], i))
    for n, (x, y) in enumerate(zip(order, order[1:]), 1):
        k = 0
        while k < min(len(strings[x]), len(strings[y])) and strings[x][k] == strings[y][k]:
            k += 1
        assert common[n] == (k if group[x] == group[y] else -1)


def test_a_collision_is_noticed_and_sorted_anew(monkeypatch):
    data = np.frombuffer(b"abcabdabcabe", np.uint8)
    start, end, group = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]), np.zeros(4, int)
    right = S._classes(data, start, end, group)
    tried = []

    class Weak(S.PrefixHash):
        def __init__(self, data, seed=0):
            super().__init__(data, seed)
            tried.append(seed)
            if seed == 0:
                # Every hash collides.
                self.sums[:] = 0

    monkeypatch.setattr(S, "PrefixHash", Weak)
    order, common = S._classes(data, start, end, group)
    assert tried == [0, 1] and order.tolist() == right[0].tolist() and common.tolist() == right[1].tolist()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op6_suffix_array_dedup"](spark, folder).collect()), key=str)
    assert got == sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows)), key=str)
    assert any(r[2] for r in got)
