import random

import numpy as np
import pyarrow as pa

from almanac.llm import decontaminate as D
from almanac.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_tiles(a, b, least):
    """Greedy string tiling in its plain form: all common runs, longest first."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return out
        for j in range(len(b) - best + 1):
            for i in range(len(a) - best + 1):
                if all(a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k] for k in range(best)):
                    for k in range(best):
                        free_a[i + k] = free_b[j + k] = False
                    out.append((i, j, best))
                    break


def test_tiles_equal_plain_greedy_tiling():
    r = random.Random(2)
    for _ in range(150):
        a = np.array([r.randrange(1, 4) for _ in range(r.randrange(1, 24))], np.uint64)
        b = np.array([r.randrange(1, 4) for _ in range(r.randrange(1, 14))], np.uint64)
        assert sorted(D.tiles(a, b, 2)) == sorted(brute_tiles(a.tolist(), b.tolist(), 2))


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_exact_reordered_and_partial_passages(spark, documents):
    r = random.Random(4)
    item = words(r, 40)
    before, after = words(r, 300), words(r, 300)
    text = lambda middle: " ".join(before + middle + after)
    docs = documents(
        [text(item), text(item[20:] + words(r, 7) + item[:20]), text(item[:15]), text([]), " ".join(item).upper().replace(" ", ", "),
         text([w if i % 4 else "x" for i, w in enumerate(item)]), text(item) + text(item)]
    )
    benchmark = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (12, "zq zr")], "item_id long, text string")
    rows = {x.doc_id: x for x in D.find_contamination(docs, benchmark).collect()}
    assert sorted(rows) == [0, 1, 4, 6]
    assert rows[0].coverage == 1 and rows[0].n_tiles == 1 and (rows[0].first_word, rows[0].last_word) == (300, 339)
    assert rows[1].coverage == 1 and rows[1].n_tiles == 2
    assert sorted(x.doc_id for x in D.drop_contaminated(docs, benchmark).collect()) == [2, 3, 5]


def test_a_short_item_matches_as_a_whole(spark, documents):
    benchmark = spark.createDataFrame([(1, "Yes, indeed")], "item_id long, text string")
    rows = D.find_contamination(documents(["well yes indeed it is", "yes it is indeed", "yes", ""]), benchmark).collect()
    assert [(x.doc_id, x.coverage) for x in rows] == [(0, 1.0)]


def test_words_do_not_run_across_texts(spark, documents):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find_contamination(documents(["a b c", "d e f"]).coalesce(1), benchmark).count() == 0


def test_blocks_and_repeated_rows(spark, documents):
    r = random.Random(7)
    items = [words(r, 12) for _ in range(20)]
    benchmark = spark.createDataFrame([(i, " ".join(x), "extra") for i, x in enumerate(items + items[:1])], "item_id long, text string, doc_id string")
    docs = documents([" ".join(words(r, 30) + x + words(r, 30)) for x in items])
    whole = D.find_contamination(docs, benchmark)
    parts = D.find_contamination(docs, benchmark, block_bytes=300)
    assert len(D.blocks(benchmark, "item_id", "text", 300)) > 3
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 21
    assert D.drop_contaminated(docs, benchmark, block_bytes=300).count() == 0


def test_odd_texts_and_empty_tables(spark, odd_documents, documents):
    benchmark = spark.createDataFrame([(None, "a b c d e f g"), (2, None)], "item_id long, text string")
    assert sorted(x.doc_id for x in D.find_contamination(odd_documents, benchmark).collect()) == [5, 6, 7]
    assert D.drop_contaminated(odd_documents, benchmark).columns == odd_documents.columns
    assert D.find_contamination(documents([]), benchmark).count() == 0
    assert D.find_contamination(odd_documents, benchmark.limit(0)).count() == 0
    assert D.drop_contaminated(odd_documents, benchmark.limit(0)).count() == odd_documents.count()


def test_query_finds_what_plain_search_finds(spark):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    rows = QUERIES["op5_decontamination"](spark, FOLDER).collect()
    assert held and held <= {(r.doc_id, r.item_id) for r in rows}
    assert {(r.doc_id, r.item_id) for r in rows if r.coverage == 1} == held


def test_candidate_bound():
    assert D.covered(np.array([0, 2]), 3, 10) == 5
    assert D.match(pa.array([None, ""]), D.build_index([1], ["a b c d e"], 5), 5, 0.5) == []
