import hashlib

from almanac.llm import chat
from almanac.llm.queries import PROBE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def examples_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df, [r.asDict() for r in chat.prefix_targets(df).orderBy("conv_id", "example").collect()]


def test_each_reply_is_an_example_with_all_before_it(spark):
    _, out = examples_of(spark, [(1, 0, "system", "s"), (1, 1, "user", "u<1>"), (1, 2, "assistant", "a&1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (1, 5, "user", "u3")])
    assert [r["example"] for r in out] == [0, 1, 2]
    assert out[1]["formatted"].startswith(out[0]["formatted"])
    assert [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]] for r in out[:2]] == ["a&amp;1", "a2"]
    assert out[2]["loss_start"] is None and out[2]["formatted"].endswith("u3</turn>\n")


def test_nulls_ties_and_control_strings_come_back(spark):
    rows = [(None, None, None, None), (1, 0, "user", PROBE), (1, 0, "user", PROBE), (1, 0, "assistant", "&lt;&amp;lt; 😀<turn x>"), (2, 1, "assistant", None), (2, 0, "a>b<c&", "\n")]
    df, _ = examples_of(spark, rows)
    back = chat.prefix_targets(df).groupBy("conv_id").agg({"formatted": "max"}).toDF("conv_id", "f")
    got = {r[0]: [tuple(t) for t in r[1]] for r in back.select("conv_id", chat.read_turns(back["f"])).collect()}
    assert got[None] == [("", "")]
    assert got[1] == [("assistant", "&lt;&amp;lt; 😀<turn x>"), ("user", PROBE), ("user", PROBE)]
    assert got[2] == [("a>b<c&", "\n"), ("assistant", "")]


def test_empty_table(spark):
    df, out = examples_of(spark, [])
    assert out == []


def test_query_reads_back_every_conversation(spark):
    out = {r["conv_id"]: r for r in QUERIES["op1_chat_prefix_targets"](spark, FOLDER).collect()}
    said = {-7: [(0, "user", PROBE), (1, "assistant", PROBE)]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(out) == set(said)
    for k, turns in said.items():
        turns.sort()
        assert out[k].n_turns == len(turns)
        assert out[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert out[k].loss_sha256 == hashlib.sha256("".join(t for _, r, t in turns if r == "assistant").encode()).hexdigest()
