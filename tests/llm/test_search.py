import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from almanac.llm import search as S
from almanac.llm import text as T
from almanac.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    """Every document scored for every query."""
    words = [terms(t) for _, t in docs]
    n, average = len(docs), sum(map(len, words)) / max(len(docs), 1)
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in sorted(set(queries), key=str):
        asked = set(terms(text))
        scored = []
        for (key, _), w in zip(docs, words, strict=True):
            s = 0.0
            for t in asked & set(w):
                f = w.count(t)
                s += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (S.K1 + 1) / (f + S.K1 * (1 - S.B + S.B * len(w) / average))
            if s > 0:
                scored.append((-round(s, 9), key is None, key if key is not None else 0, s))
        out += [(q, i + 1, None if none else key, s) for i, (_, none, key, s) in enumerate(sorted(scored)[:k])]
    return out


def same(got, wanted):
    got = sorted(got, key=lambda r: (str(r[0]), r[1]))
    wanted = sorted(wanted, key=lambda r: (str(r[0]), r[1]))
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in wanted]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, wanted, strict=True))
    # Scores that differ by rounding alone may stand in either order.
    differ = [(a, b) for a, b in zip(got, wanted, strict=True) if a[2] != b[2]]
    assert len(differ) <= len(got) // 50


@pytest.mark.parametrize(("shard_bytes", "first"), [(1 << 20, S.FIRST_SLICE), (2000, 20)])
def test_results_equal_scoring_everything(spark, monkeypatch, shard_bytes, first):
    monkeypatch.setattr(S, "FIRST_SLICE", first)
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randrange(0, 60)))) for i in range(500)]
    docs += [(1000, docs[3][1]), (None, docs[4][1]), (1001, None)]
    queries = [(i, docs[i][1]) for i in range(0, 60, 3)] + [(3, docs[3][1]), (-1, "w0 unknown"), (-2, ""), (-3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = S.search(df, q, k=7, shard_bytes=shard_bytes, query_bytes=2500).collect()
    same([tuple(x) for x in got], brute(docs, [(a, b or "") for a, b in queries], 7))


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 50_000])
@pytest.mark.parametrize("top", [1 << 16, 1 << 64])
def test_places_of_words_equal_a_binary_search(n, top):
    """Hashes that are spread, and some whose first bits are all alike."""
    r = np.random.default_rng(n)
    draw = lambda k: r.integers(0, top, k, dtype=np.uint64, endpoint=top < 1 << 64)
    known = np.unique(draw(min(n, 200) if top < 1 << 64 else n))
    h = np.concatenate((known, draw(3000), np.array([0, (1 << 64) - 1], np.uint64)))
    assert (S.places_of(known, h) == np.searchsorted(known, h)).all()


def test_words_are_not_searched_one_by_one(monkeypatch):
    """Terms are found by the first bits of their hashes; a binary search of every word took much of the time."""
    texts = pa.array(["one two three two", None, "four two", ""])
    terms = np.unique(T.words_of(pa.array(["two four five"]), T.ALNUM).hashes())
    wanted = S.term_rows(texts, terms)
    searched, original = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: searched.append(a is terms) or original(a, v, *rest))
    got = S.term_rows(texts, terms)
    assert not any(searched)
    assert all((x == y).all() for x, y in zip(got, wanted, strict=True))
    rows = {(int(terms[t]), int(r)): int(f) for t, r, f in zip(*got[:3], strict=True)}
    two, four = (int(x) for x in T.words_of(pa.array(["two four"]), T.ALNUM).hashes())
    assert rows == {(two, 0): 2, (two, 2): 1, (four, 2): 1}
    assert got[3].tolist() == [4, 0, 2, 0]


def test_pruning_skips_blocks(spark):
    """A copy of a query leaves little to score."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 2 + str(r.randrange(90)) for _ in range(20)) for _ in range(2000)]
    q = S.read_queries([(0, texts[7])])
    shard = S.Shard([pa.array(texts)], q.terms, np.ones(len(q.terms)), 20.0)
    seen = []
    original, S.ranges = S.ranges, lambda a, b: seen.append(int((b - a).sum())) or original(a, b)
    try:
        places, scores = shard.search(q.members, 1, np.arange(2000))
    finally:
        S.ranges = original
    assert shard.order[places[0]] == 7
    assert sum(seen[1:]) < 0.5 * len(shard.score)


def common_words(n):
    """Texts of 40 words out of 80, and of two rarer ones."""
    r = random.Random(5)
    return [" ".join(r.sample([f"w{i}" for i in range(80)], 40) + [f"r{r.randrange(300)}", f"r{r.randrange(300)}"]) for _ in range(n)]


def test_frequent_terms_do_not_loosen_bounds(monkeypatch):
    """Words that every block holds say little by their maxima; nearly all blocks were looked at for them."""
    texts = common_words(2000)
    q = S.read_queries([(0, texts[7])])
    shard = S.Shard([pa.array(texts)], q.terms, np.log1p(2000 / np.arange(1, len(q.terms) + 1)), 42.0)
    place = np.empty(2000, np.int64)
    place[shard.order] = np.arange(2000)
    total = np.bincount(shard.row, shard.score, minlength=2000)
    best = np.lexsort((np.arange(2000), -total))[:3]
    seen, ranges = [], S.ranges
    monkeypatch.setattr(S, "ranges", lambda a, b: seen.append(int((b - a).sum())) or ranges(a, b))
    places, scores = shard.search(q.members, 3, np.arange(2000), total[best[-1]])
    assert places.tolist() == best.tolist() and places[0] == place[7]
    assert (scores == total[best]).all()
    assert sum(seen) < 0.25 * len(shard.score)


@pytest.mark.parametrize("cells", [1, 3000, 40_000, S.CELLS])
@pytest.mark.parametrize("frequent", [1, 4, 10_000])
def test_many_queries_at_once_equal_scoring_everything(monkeypatch, cells, frequent):
    """With a matrix of no, some and all terms, and queries one by one and together; from no bound, a low one and the k-th score."""
    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    texts = [*common_words(300), "", None, "w1", "alone", "r5 r5 r5"]
    q = S.read_queries([(i, texts[i] or "") for i in range(0, len(texts), 7)] + [(-1, ""), (-2, "unknown"), (-3, "r5 w1 w2")])
    r = np.random.default_rng(6)
    shard = S.Shard([pa.array(texts[:100]), pa.array(texts[100:])], q.terms, r.random(len(q.terms)) + 0.01, 42.0)
    rank = r.permutation(len(texts))
    every, wanted = np.repeat(np.arange(len(q.terms)), np.diff(shard.of_term)), []
    every = np.repeat(every, shard.after - shard.first)
    for a, b in zip(q.offsets, q.offsets[1:]):
        mine = np.isin(every, q.members[a:b])
        total = np.bincount(shard.row[mine], shard.score[mine], minlength=len(texts))
        hit = np.flatnonzero(total)
        hit = hit[np.lexsort((rank[hit], -total[hit]))][:5]
        wanted.append((hit.tolist(), total[hit].tolist()))
    for share in (-np.inf, 0.1, 1.0):
        floors = [share * w[1][-1] if w[1] else -np.inf for w in wanted]
        got = [(p.tolist(), s.tolist()) for p, s in shard.search_all(q.members, q.offsets, 5, rank, floors)]
        assert got == wanted


def test_queries_without_results_in_a_shard_are_left_out_together(monkeypatch):
    """Queries whose k-th score no document of a shard reaches were looked at one by one."""
    texts = common_words(600)
    q = S.read_queries([(i, texts[i]) for i in range(200)])
    shard = S.Shard([pa.array(texts)], q.terms, np.log1p(600 / np.arange(1, len(q.terms) + 1)), 42.0)
    rank, looked = np.arange(600), []
    top = [float(s[0]) for _, s in shard.search_all(q.members, q.offsets, 1, rank, [-np.inf] * 200)]
    for name in ("_best", "_among"):
        monkeypatch.setattr(S.Shard, name, lambda *a, f=getattr(S.Shard, name, None): looked.append(1) or f(*a))
    # Each query's best is its own text; every tenth may find it again, the others want more than it has.
    floors = [x if i % 10 == 0 else x * 1.01 for i, x in enumerate(top)]
    found = [p.tolist() for p, _ in shard.search_all(q.members, q.offsets, 1, rank, floors)]
    assert [len(p) for p in found] == [int(i % 10 == 0) for i in range(200)]
    assert all(shard.order[p[0]] == i for i, p in enumerate(found) if p)
    assert len(looked) == 20


def test_documents_are_indexed_once_for_many_queries(spark, monkeypatch):
    """Every 16 MB of queries had all documents cut into words and indexed anew, and their texts gathered on the driver."""
    blocks, gathered = [], S._gathered
    monkeypatch.setattr(S, "_gathered", lambda asked: blocks.append(gathered(asked)) or blocks[-1])
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta delta"), (3, "beta")], "doc_id long, text string")
    long = spark.range(10).selectExpr("id as query_id", "concat(repeat('alpha gamma ', 160000), 'w', id, ' beta') as text")
    got = S.search(df, long).collect()
    assert len(blocks) == 1
    assert sorted(blocks[0].keys) == list(range(10)) and len(blocks[0].terms) == 13 and blocks[0].offsets.tolist() == list(range(0, 41, 4))
    assert {x.query_id: x.doc_id for x in got if x.rank == 1} == dict.fromkeys(range(10), 1)
    assert len(got) == 30


def test_later_slices_hand_on_little(spark, monkeypatch):
    """Rows that tasks hand on follow the number of results, not that of shards."""
    monkeypatch.setattr(S, "FIRST_SLICE", 100)
    r = random.Random(7)
    docs = [(i, " ".join(f"w{int(r.random() ** 2 * 300)}" for _ in range(30))) for i in range(3200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    q = df.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "text")
    handed, stored = [], S.stored

    def counting(frame, purpose):
        out = stored(frame, purpose)
        handed.append(out.count())
        return out

    found = []
    searching = S._searching

    def watched(*a):
        run = searching(*a)
        found.append(a)
        return run

    monkeypatch.setattr(S, "stored", counting)
    monkeypatch.setattr(S, "_searching", watched)
    got = S.search(df, q, shard_bytes=2000).collect()
    assert handed == [320] * 4
    same([tuple(x) for x in got], brute(docs, [x for x in docs if x[0] % 100 == 0], S.K))
    # The last slice, three quarters of all documents, from the bounds of the others.
    held, idf, floors, *rest = found[-1]
    assert np.isfinite(floors.value).all()
    place = S.F.pmod(S.F.xxhash64("doc_id"), S.F.lit(S.HASHES))
    last = df.where(place >= int(S.HASHES * 1600 / 3200)).selectExpr("doc_id as key", "text")
    assert last.mapInArrow(searching(held, idf, floors, *rest), "number int, q long, key long, score double").count() < 3 * 320


def test_first_slice_hands_on_little(spark, monkeypatch):
    """Tasks that have no bounds to start from are few, however many hold the documents."""
    monkeypatch.setattr(S, "FIRST_SLICE", 1600)
    r = random.Random(8)
    docs = [(i, " ".join(f"w{int(r.random() ** 2 * 300)}" for _ in range(30))) for i in range(3200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    q = df.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "text")
    handed, searching = [], S._searching

    def watched(*a):
        run, rows = searching(*a), spark.sparkContext.accumulator(0)
        handed.append(rows)

        def counting(batches):
            for batch in run(batches):
                rows.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(S, "_searching", watched)
    got = S.search(df, q).collect()
    assert len(handed) == 2 and 320 <= handed[0].value <= 320 * S.FIRST_TASKS
    same([tuple(x) for x in got], brute(docs, [x for x in docs if x[0] % 100 == 0], S.K))


def test_odd_texts_and_empty_tables(odd_documents, documents, spark):
    q = odd_documents.selectExpr("doc_id as query_id", "text")
    assert S.search(odd_documents, q).where("query_id = 4 and rank = 1").count() == 1
    assert S.search(documents([]), q).count() == 0
    assert S.search(odd_documents, q.limit(0)).count() == 0


def test_query_against_scoring_everything(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op7_bm25_top_k"](spark, folder).collect()
    same([tuple(x) for x in got], brute(docs, [x for x in docs if x[0] % 100 == 0], S.K))
