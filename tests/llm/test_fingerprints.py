import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from almanac.llm import fingerprints as P
from almanac.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SIGN = 1 << 63


def signed(x):
    return x - (1 << 64) if x >= SIGN else x


def of_string(text, seed=42):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed))


def of_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed % (1 << 64))
    return signed(seed % (1 << 64))


def of_bits(term, number):
    """The hash of a long and then an integer."""
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", number), of_longs([term]) % (1 << 64)))


def terms(text):
    words = re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {of_string(w) for w in words if w}


def lexicon(texts):
    df = {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    return {w for w, n in df.items() if max(2, len(texts) * P.LEAST_SHARE) <= n <= len(texts) * P.MOST_SHARE}


def fingerprint(text, known):
    every = terms(text)
    own = every & known
    picked = sorted(own if len(own) >= P.MIN_TERMS else every or {of_string(text)})
    rows = [(t, of_bits(t, 0), of_bits(t, 1)) for t in picked]
    out = []

    def digest(kept):
        h = of_longs([x for row in kept for x in row])
        out.append(f"{h % (1 << 64) | SIGN:016X}"[-P.DIGITS :] if kept else P.EMPTY)

    digest(rows)
    for f in range(P.FAMILIES):
        half, place = divmod(f, P.FAMILIES // 2)
        for bits in P.STEPS:
            digest([r for r in rows if not (r[1 + half] >> P.FAMILY_BITS * place) & ((1 << bits) - 1)])
    return "".join(out)


def near(a, b):
    parts = [(a[i : i + P.DIGITS], b[i : i + P.DIGITS]) for i in range(0, len(a), P.DIGITS)]
    asked = [(x, y) for x, y in parts if x != P.EMPTY or y != P.EMPTY]
    return sum(x == y for x, y in asked) / len(asked)


def brute(rows):
    known = lexicon([t or "" for _, t in rows])
    order = sorted({(k is None, k or 0, of_string(t or ""), t or "") for k, t in rows})
    out = []
    for k, t in rows:
        t = t or ""
        at = order.index((k is None, k or 0, of_string(t), t))
        after = order[(at + 1) % len(order)][3]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following = (fingerprint(x, known) for x in (t, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((k, len(t), digest, own, changed, near(own, changed), near(own, following)))
    return out


def asked(frame):
    own = F.col("fingerprint")
    return frame.select(
        "doc_id", F.length("text"), F.sha2(F.col("edited").cast("binary"), 256), "fingerprint", "edited_fingerprint",
        P.likeness(own, F.col("edited_fingerprint")), P.likeness(own, F.col("next_fingerprint")),
    )


def listed(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_document_fingerprints"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert listed(got.collect()) == listed(brute(rows))


def test_odd_texts_clashing_keys_and_repeated_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert listed(asked(P.edited_documents(odd_documents)).collect()) == listed(brute(rows))
    clash = [(1, "a b c d e f"), (1, "g h i"), (1, "a b c d e f"), (None, "x"), (None, None), (2, "")]
    df = spark.createDataFrame(clash, "doc_id long, text string").repartition(3)
    assert listed(asked(P.edited_documents(df)).collect()) == listed(brute(clash))


@pytest.mark.parametrize("rows", [[], [(5, "only one text here")], [(5, None)]])
def test_none_and_one(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(asked(P.edited_documents(df)).collect()) == listed(brute(rows))
    assert P.fingerprint_documents(df).count() == len(rows)


def test_string_keys_in_many_ranges(spark):
    rows = [(f"k{i % 97:03d}-{i}", f"word{i} other{i * 7 % 13} third{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = {r.doc_id: r.edited for r in P.edited_documents(df).collect()}
    order = sorted(rows)
    for i, (k, t) in enumerate(order):
        assert got[k] == t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]


def test_few_changes_keep_most_hashes(spark):
    r = random.Random(5)
    vocabulary = [f"term{i}" for i in range(4000)]
    texts = [" ".join(r.sample(vocabulary, 120)) for _ in range(400)]
    changed = texts[0].split()
    changed[10] = changed[60] = "other"
    rows = [*enumerate(texts), (1000, " ".join(changed)), (1001, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.fingerprint for x in P.fingerprint_documents(df).collect()}
    assert found[1001] == found[0]
    assert near(found[0], found[1000]) > 0.6
    assert max(near(found[0], found[i]) for i in range(1, 400)) < 0.3


def test_the_lexicon_is_bounded(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, " ".join(f"t{int(r.random() ** 2 * 900)}" for _ in range(12))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    free = P.lexicon_of(df).count()
    monkeypatch.setattr(P, "LEXICON_MOST", 500)
    assert 0 < P.lexicon_of(df).count() < min(free, 500)
