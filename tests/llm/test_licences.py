import random
import re
import time

import pytest

from almanac.llm import licences
from almanac.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted(
        (i, label)
        for phrase, label in licences.BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        sorted({label for _, label in places}),
    )


def found(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, list(row.base_labels)


def test_base_places(documents):
    texts = [
        "MIT License mit-license MIT\nLICENSE", "the GNU General Public License, version 3.", "Apache License cc by CC-BY cc-by-nc",
        "smit license mit licenses", "é mit license é", "mit", "license", "mit mit license license apache", "mit 中 license",
    ]
    rows = {r.doc_id: r for r in licences.scan_licences(documents(texts)).collect()}
    assert [found(rows[i]) for i in range(len(texts))] == [brute(t) for t in texts]


def test_words_do_not_run_across_texts(documents):
    rows = licences.scan_licences(documents(["apache", "license", "mit", "license apache", "license"]).coalesce(1)).collect()
    assert all(r.n_base == 0 for r in rows)


def test_odd_texts(odd_documents):
    rows = licences.scan_licences(odd_documents).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    assert all(found(r) == brute(texts[r.doc_id]) and 0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize(
    ("line", "text", "level"),
    [
        (" (MIT OR GPL-2.0-only) AND ISC", "((mit or gpl-2.0-only) and isc)", licences.PERMISSIVE),
        (" MIT AND GPL-3.0-or-later OR Apache-2.0", "((mit and gpl-3.0-or-later) or apache-2.0)", licences.PERMISSIVE),
        (" GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "((gpl-2.0-only with classpath-exception-2.0) and mit)", licences.WEAK),
        (" MIT some prose after it", "mit", licences.PERMISSIVE),
        (" MIT AND", "mit", licences.PERMISSIVE),
        (" ((MIT)", None, None),
        (" OR MIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(line, text, level):
    result = licences.leading_expression(line.lower())
    assert (result and (result[0], result[2])) == (text and (text, level))


def test_tags_add_labels(documents):
    row = licences.scan_licences(documents(["x\n// SPDX-License-Identifier: Apache-2.0 OR MIT\nMIT License"])).collect()[0]
    assert row.labels == ["apache-2.0", "mit"] and row.base_labels == ["mit"] and row.expressions == ["(apache-2.0 or mit)"]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op10_licence_scan"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r, wanted = out[d.doc_id], brute(d.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (*wanted[:4], ",".join(wanted[4]))


def test_empty_table(documents):
    assert licences.scan_licences(documents([])).count() == 0


def test_long_lines_take_one_pass(spark):
    """Hundreds of thousands of brackets and operators on a tag's line, within seconds."""
    n = 100_000
    lines = ["(" * 2 * n, "(" * n + "mit" + ")" * n, "mit or " * n + "(", "mit with x and " * n, "a with (" * n]
    wanted = [[], ["mit"], None, None, ["a"]]
    docs = spark.createDataFrame([(i, f"SPDX-License-Identifier: {x}\nend") for i, x in enumerate(lines)], "doc_id long, text string")
    started = time.monotonic()
    found = {r.doc_id: r.expressions for r in licences.scan_licences(docs).collect()}
    assert time.monotonic() - started < 60
    assert all(found[i] == w for i, w in enumerate(wanted) if w is not None)
    assert found[2][0].count(" or ") == n - 1 and found[3][0].endswith("(mit with x))")


@pytest.mark.parametrize("seed", range(3))
def test_longest_prefix_against_trying_all(seed):
    r = random.Random(seed)
    for _ in range(3000):
        tokens = [r.choice(["(", ")", "and", "or", "with", "mit", "gpl-2.0", "x"]) for _ in range(r.randrange(10))]
        wanted = None
        for n in range(len(tokens), 0, -1):
            postfix = licences.parse_expression(" ".join(tokens[:n]))
            if postfix and (wanted := licences.evaluate(postfix)):
                break
        assert licences.leading_expression(" ".join(tokens)) == wanted
