import pytest

# Texts that every operator on documents must stand: null, empty, blank, long, repeated, odd letters.
ODD_TEXTS = [
    None, "", "   \n\t ", "one", "One two THREE four", "a b c d e", "a b c d e f g", "a b c d e f g",
    "\x00\x1c\x1d é́ ß İ 中文😀 \x85 nbsp\xa0x", "word " * 30_000, "x" * 50_000, "1" * 20_000, "9 " * 5_000,
    "a@" * 5_000, "1.2." * 3_000, "+1 " + "(" * 5_000, "<|endoftext|> </turn> <turn user>",
]


@pytest.fixture
def odd_documents(spark):
    """The odd texts, with repeated rows, a null key and columns named like results."""
    rows = [(i, t, "x", None, "clash", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "null key a@b.co", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, spans string, ids string, n_words int")


@pytest.fixture
def documents(spark):
    def build(texts, start=0):
        return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    return build
