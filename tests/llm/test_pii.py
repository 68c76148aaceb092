import hashlib
import random
import re
import time

from almanac.llm import pii
from almanac.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
# The plain patterns of the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 13 <= len(n) <= 19 and luhn(n)
                or kind == "phone" and 9 <= len(n) <= 15
            ):
                out.append((kind, m.start(), m.end()))
    return out


def base(rows):
    return [(s.kind, s.start, s.end) for s in rows if s.kind in PLAIN]


def test_base_spans_equal_the_plain_patterns(documents):
    r = random.Random(5)
    bits = ["a", "b.", "%", "@", "@x", ".co", "-", "1", "22", "255", "256", ".", " ", "+", "+4", "(", ")", "4111111111111111", "4111 1111-1111 1111", "😀", "é", "\n", "007", "0000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(1500)]
    found = {x.doc_id: base(x.spans) for x in pii.find_private(documents(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_odd_texts(odd_documents):
    rows = pii.find_private(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert all(base(r.spans) == brute(texts[r.doc_id]) for r in rows if len(texts[r.doc_id] or "") < 45_000)
    clean = pii.redact(odd_documents)
    assert clean.columns == odd_documents.columns and clean.count() == len(rows)
    assert clean.filter("doc_id = 0 and text is null").count() == 1


def test_further_kinds_need_their_checks_or_context(documents):
    texts = [
        "pay to GB82 WEST 1234 5698 7654 32 now", "pay to GB82 WEST 1234 5698 7654 33 now",
        "my social security number is 123-45-6789", "part 123-45-6789 of the list",
        'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" end', "tokens are fine",
    ]
    kinds = {x.doc_id: [s.kind for s in x.spans] for x in pii.find_private(documents(texts)).collect()}
    assert [kinds[i] for i in range(6)] == [["iban"], [], ["ssn"], [], ["secret"], []]


def test_words_nearby_raise_the_score(documents):
    rows = pii.find_private(documents(["write a mail to x@y.org", "at x@y.org"])).orderBy("doc_id").collect()
    assert rows[0].spans[0].score > rows[1].spans[0].score


def test_redaction_replaces_overlaps_once(documents, spark):
    rows = spark.createDataFrame([(0, "card 4111 1111 1111 1111, +1 (275) 555-5927; a@b.co.", 50, 1), (1, None, None, 2), (2, "plain", 5, 3)], "doc_id long, text string, n_chars long, row int")
    out = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert out[0].text == "card [CARD], [PHONE]; [EMAIL]." and out[0].n_chars == len(out[0].text)
    assert out[1].text is None and out[2].text == "plain" and out[2].row == 3


def test_query_against_brute_force(spark):
    out = {r.doc_id: r for r in QUERIES["op2_private_data"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        spans = brute(d.text)
        assert out[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
        assert out[d.doc_id].n_card == sum(k == "card" for k, _, _ in spans)


def test_empty_table(documents):
    assert pii.find_private(documents([])).count() == 0 and pii.redact(documents([])).count() == 0


def test_account_numbers_end_where_their_country_says(documents):
    numbers = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"]
    after = [" BIC COBADEFF", " EUR 500", " I wait", " 3 days", " 12 A", " GB82 WEST 1234 5698 7654 32"]
    texts = [f"to {n}{a}" for n, a in zip(numbers, after)]
    found = {x.doc_id: [s.match for s in x.spans if s.kind == "iban"] for x in pii.find_private(documents(texts)).collect()}
    assert [found[i] for i in range(6)] == [[n] for n in numbers[:5]] + [[numbers[5]] * 2]
    wrong = ["DE89370400440532013001 EUR 500", "xDE89370400440532013000", "DE89370400440532013000X"]
    assert all(not x.spans or all(s.kind != "iban" for s in x.spans) for x in pii.find_private(documents(wrong)).collect())


def test_long_secrets_go_whole(documents):
    text = 'token = "' + "aB3/" * 150 + '" end'
    assert [x.text for x in pii.redact(documents([text])).collect()] == ['[SECRET]" end']


def test_many_finds_in_one_text(spark):
    """Tens of thousands of finds take seconds, and come out as those of short texts do."""
    n = 50_000
    text = "".join(f"é mail a{i}@b.co, " if i % 2 else f"ip 10.0.{i % 256}.7; " for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text[:2000])], "doc_id long, text string")
    started = time.monotonic()
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_private(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.monotonic() - started < 120
    assert sorted((k, a, z) for k, a, z, *_ in found[1]) == sorted(brute(text))
    assert len(found[1]) == n and {s[4] for s in found[1]} == {s[4] for s in found[2]}
    assert clean[1] == "".join("é mail [EMAIL], " if i % 2 else "ip [IP]; " for i in range(n))
