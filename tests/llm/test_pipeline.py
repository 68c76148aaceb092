import random
import re

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from almanac.llm import decontaminate, pii, quality
from almanac.llm import text as T
from tests.llm.test_pii import brute as private_spans
from tests.llm.test_setjoin import brute as brute_classes

FOLDER = "/root/testdata/sf0.001"


def plain_redaction(text):
    """Base kinds and secrets replaced in plain Python, by first start and longest span."""
    spans = [(a, -z, k) for k, a, z in private_spans(text)]
    for m in re.finditer(pii.KINDS[-1].pattern, text):
        spans.append((m.start(), -m.end(), "secret"))
    out, at = "", 0
    for a, back, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, -back)
    return out + text[at:]


def brute(rows, items):
    """The stages, each over whole lists; only the classifier's fit is shared with the operator."""
    texts = pa.array([t for _, t in rows], pa.string())
    measured = quality.measure(texts)
    votes = quality.votes_of(measured.measures)
    labels = {}
    for trait in quality.TRAITS:
        own, n = __import__("numpy").unique(votes[:, quality.columns_of(trait)], axis=0, return_counts=True)
        labels[trait] = quality.fit_labels(own, n)
    target = quality.any_trait({t: m.posterior(votes[:, quality.columns_of(t)]) for t, m in labels.items()})
    rows = [r for r, bad in zip(rows, target > 0.5, strict=True) if not bad]
    classes = {k: c for k, _, c in brute_classes(rows)}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    words = lambda t: T.words_of(pa.array([t]), T.ALNUM).hashes()

    def share(text, item):
        w = words(item)
        least = min(len(w), decontaminate.MIN_MATCH)
        return sum(n for *_, n in decontaminate.tiles(words(text), w, least)) / len(w) if len(w) else 0

    # Every document of fewer than 2000 words against every item; longer ones hold an item if its text.
    clean = lambda t: all(share(t, i) < decontaminate.COVERAGE if len(t) < 6000 else i not in t for i in items)
    rows = [r for r in rows if clean(r[1] or "")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    return {k: tokenizer.encode(plain_redaction(t or ""), add_special_tokens=False).ids for k, t in rows}


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    wanted = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()], items)
    got = {r.doc_id: list(r.ids) for r in __spark_entry__.queries()["pipeline"](spark, FOLDER).collect()}
    # The linear scorer may differ from the posteriors it learned on a document at the threshold.
    assert len(set(got) ^ set(wanted)) <= 0.01 * docs.count()
    assert all(got[k] == wanted[k] for k in set(got) & set(wanted))


def test_stages_keep_columns_and_stand_odd_rows(spark, odd_documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "private_data", "tokens"]
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.count()
        assert corpus_pipeline.tokens(spark, docs, FOLDER).count() == docs.count()


def test_planted_cases(spark):
    """Copies, near copies, benchmark items, personal data and insults go; clean documents stay."""
    r = random.Random(6)
    vocabulary = [r.choice("bcdfgklmnprst") + "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 6))) for _ in range(900)]
    prose = lambda n: [r.choice(quality.FUNCTION_WORDS[:40] if r.random() < 0.4 else vocabulary) for _ in range(n)]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = {i: " ".join(prose(150)) for i in range(120)}
    changed = clean[3].split()
    changed[70] = "other"
    insulted = prose(150)
    insulted[20], insulted[90] = "idiot", "scum"
    planted = {
        200: clean[1], 201: " ".join(changed), 202: " ".join(prose(60)) + " " + item + " " + " ".join(prose(60)),
        203: " ".join(insulted), 204: " ".join(["same"] * 150), 205: " ".join(prose(80)) + " write to jo@x-y.org or +1 (275) 555-5927 now",
    }
    rows = [(k, t, "en", "s", len(t)) for k, t in (clean | planted).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test")
    out = {x.doc_id: x for x in docs.collect()}
    assert set(out) == set(clean) | {205}
    assert out[205].text.endswith(" write to [EMAIL] or [PHONE] now") and out[205].n_chars == len(out[205].text)
    assert all(out[k].text == t for k, t in clean.items())
