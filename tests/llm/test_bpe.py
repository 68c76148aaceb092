import random

import public_tokenizers
from tokenizers import Tokenizer

from almanac.llm import bpe
from almanac.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def compare(df):
    t = Tokenizer.from_file(PATH)
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    rows = sorted(((r.doc_id is None, r.doc_id, list(r.ids), r.decoded) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()), key=str)
    wanted = []
    for k, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        wanted.append((k is None, k, ids, t.decode(ids, skip_special_tokens=False)))
    assert rows == sorted(wanted, key=str)


def test_odd_texts_match_the_library(odd_documents):
    compare(odd_documents)


def test_mixed_letters_match_the_library(documents):
    r = random.Random(3)
    bits = ["a", "b", "the ", "ing", "'s", "'RE", "'", "\x1c", "\x85", "\xa0", "\n", "é", "ß", "Σ", "İ", "ǅ", "中", "😀", "é", "́", "1", "²", "٣", "!!", "<|endoftext|>", "<|endof", "</w>", "ﬁ", "K", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(600)]
    texts += ["a" + chr(c) + "b" + chr(c) for c in range(0x20, 0x3100, 3)]
    compare(documents(texts))


def test_products_taken_up_by_lower_ranks_go_first(tmp_path):
    """A file whose ranks are out of order, against merging one pair after another."""
    import json

    letters = bpe.byte_letters()
    tokens = letters + [c + "</w>" for c in letters] + ["ab", "abc", "abcab", "aa", "aaa"]
    merges = [["abc", "ab"], ["aa", "a"], ["ab", "c"], ["a", "b"], ["a", "a"]]
    path = tmp_path / "t.json"
    data = json.load(open(PATH))
    data["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    data["added_tokens"] = []
    path.write_text(json.dumps(data))
    v = bpe.Vocabulary(str(path))
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(400)]
    offsets, ids = bpe.encode_words(v, words)
    rank = {tuple(m): i for i, m in enumerate(merges)}
    for k, word in enumerate(words):
        parts = [*word[:-1], word[-1] + "</w>"]
        while found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [tokens[i] for i in ids[offsets[k] : offsets[k + 1]]] == parts


def test_query_matches_the_library(spark):
    import hashlib

    import numpy as np

    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(PATH)
    out = {r.doc_id: r for r in QUERIES["op4_bpe_round_trip"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        assert out[d.doc_id].n_tokens == len(ids)
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).count() == 0
