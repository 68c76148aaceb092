import random

import numpy as np
import pyarrow as pa

from almanac.llm import quality as Q
from almanac.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    bad = rng.random(20_000) < 0.2
    right, speaks = np.array([0.95, 0.9, 0.8, 0.7]), np.array([1.0, 0.8, 0.9, 0.6])
    votes = np.where(rng.random((len(bad), 4)) < right, np.where(bad, 1, -1)[:, None], np.where(bad, -1, 1)[:, None])
    votes = np.where(rng.random(votes.shape) < speaks, votes, 0).astype(np.int8)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    model = Q.fit_labels(patterns, np.bincount(at.ravel()))
    assert abs(model.prior - 0.2) < 0.02
    assert np.abs(model.accuracies() - right).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == bad).mean() > 0.95


def test_no_opinion_leaves_the_prior():
    patterns = np.array([[1, 1], [-1, -1], [0, 0]], np.int8)
    model = Q.fit_labels(patterns, np.array([10, 90, 50]))
    assert np.isclose(model.posterior(patterns[2:])[0], model.prior)


def test_measures_against_plain_python():
    text = "The The cat!! IDIOT\nthe cat\nthe cat\n@@ é"
    m = Q.measure(pa.array([None, "", text])).measures
    assert m["n_words"].tolist() == [0, 0, 9]
    assert m["insults"].tolist() == [0, 0, 1]
    assert np.isclose(m["repeat_share"][2], 1 / 9) and np.isclose(m["line_repeat_share"][2], 1 / 4)
    assert np.isclose(m["known_share"][2], 1 - 4 / 9)


def corpus(r):
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    prose = lambda n: [r.choice(Q.FUNCTION_WORDS[:40] if r.random() < 0.4 else vocabulary) for _ in range(n)]
    out = []
    for i in range(400):
        w = prose(r.randrange(15, 200))
        kind = ["clean", "clean", "clean", "noisy", "repetitive", "toxic"][i % 6]
        if kind == "noisy":
            w = [x.upper() + r.choice(["&&&", "%%%", "***", " |"]) for x in w]
        if kind == "repetitive":
            w = [w[0]] * len(w)
        if kind == "toxic":
            w[3], w[9] = "idiot", "scum"
        out.append((kind, " ".join(w)))
    return out


def test_bad_documents_go_and_clean_ones_stay(documents):
    made = corpus(random.Random(1))
    docs = documents([t for _, t in made])
    model = Q.fit(docs, sample_rows=300)
    rows = {x.doc_id: x for x in Q.score_documents(docs, model).collect()}
    assert len(rows) == len(made)
    wrong = [k for i, (k, _) in enumerate(made) if rows[i].rejected == (k == "clean")]
    assert len(wrong) < 0.02 * len(made)
    kept = Q.keep_good(docs, model)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, x in rows.items() if not x.rejected)


def test_odd_texts_and_empty_tables(odd_documents, documents):
    model = Q.fit(odd_documents)
    assert Q.score_documents(odd_documents, model).count() == odd_documents.count()
    assert Q.keep_good(odd_documents, model).columns == odd_documents.columns
    empty = documents([])
    assert Q.fit(empty) is None
    assert Q.score_documents(empty, None).count() == 0 and Q.keep_good(empty, None).count() == 0
    assert Q.score_documents(documents(["a text of words"]), Q.fit(documents([None, None]))).count() == 1


def test_held_out_labels(spark):
    """Given labels, which nothing was fitted on: clean documents stay, most poor ones go."""
    rows = QUERIES["op8_quality_classifier"](spark, FOLDER)
    both = rows.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").toPandas()
    clean, poor, toxic = (both[(both.quality == 1) & (both.toxic == 0)], both[both.quality == 0], both[both.toxic == 1])
    assert rows.count() == 10_000
    assert clean.rejected.mean() < 0.005
    assert poor.rejected.mean() > 0.95
    # About a third of the toxic labels stand on texts without any insult.
    assert toxic.rejected.mean() > 0.6


def test_toxic_documents_of_every_language_go(spark):
    """Odd labels, which no word was learned from."""
    rows = QUERIES["op8_quality_classifier"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = rows.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").join(docs, "doc_id").toPandas()
    odd = both[(both.doc_id % 2 == 1) & (both.quality == 1)]
    share = odd[odd.toxic == 1].groupby("lang").rejected.mean()
    print(share.to_dict(), odd[odd.toxic == 1].groupby("lang").size().to_dict(), odd[odd.toxic == 0].rejected.sum(), (odd.toxic == 0).sum())
    assert share["en"] > 0.95 and share["de"] > 0.9 and share["fr"] > 0.9 and share["es"] > 0.25
    assert odd[odd.toxic == 0].rejected.mean() < 0.005


def test_marks_of_no_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(["a text of words"] * 3 + [None])
    marks = Q.learn_marks(docs, none)
    assert len(marks) == 0
    assert Q.score_documents(docs, Q.fit(docs, marks=marks)).count() == 4


def test_one_listed_word_does_not_reject_a_long_document(documents):
    made = corpus(random.Random(2))
    model = Q.fit(documents([t for _, t in made]))
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12_000)]
    for n in (1_500, 5_000, 20_000):
        texts = []
        for listed in (["garbage"], ["trash"], ["loser"], ["vermin"], ["idiot"], ["scum"], []):
            w = [r.choice(Q.FUNCTION_WORDS[:40] if r.random() < 0.4 else vocabulary) for _ in range(n)]
            w[n // 2 : n // 2 + 1] = listed or ["x"]
            texts.append(" ".join(w))
        _, rejected, posteriors = model.judge(Q.measure(pa.array(texts)))
        assert (posteriors["toxic"] < 0.1).all() and not rejected.any()
    short = Q.measure(pa.array(["you garbage trash loser " * 5]))
    assert model.judge(short)[1].all()
