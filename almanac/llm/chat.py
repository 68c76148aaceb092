"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and its text
alone is trainable. What follows the last assistant turn is one more example without a trainable
part, so that every turn can be read back.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line end. Inside roles and texts ``&``, ``<``
and ``>`` are written as entities, so that no control string can stand in a text; ``unescape``
brings them back.

A null role or text is an empty one; null conversation ids form one conversation. Turns are
ordered by turn number (nulls first), then role and text, so ties and repeated rows have a defined
order and all stay. Other columns of the input stay behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for written, raw in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return c


def prefix_targets(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, example, formatted, loss_start, loss_length): examples numbered from 0, the
    trainable span in code points from 0; both null in an example without one."""
    rows = turns.select(
        turns[conversation].alias(conversation),
        F.struct(
            turns[turn].alias("turn"),
            F.coalesce(turns[role], F.lit("")).alias("role"),
            F.coalesce(turns[text], F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy(conversation).agg(F.sort_array(F.collect_list("said")).alias("said"))
    written = whole.select(
        conversation,
        F.transform(
            "said",
            lambda t: F.struct(
                (t["role"] == TRAINED_ROLE).alias("trained"),
                F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("said"),
    )
    # How many turns each example takes in.
    upto = F.filter(
        F.sequence(F.lit(1), F.size("said")),
        lambda n: F.element_at("said", n)["trained"] | (n == F.size("said")),
    )
    example = written.select(conversation, "said", F.posexplode(upto).alias("example", "upto")).select(
        conversation,
        "example",
        F.element_at("said", F.col("upto")).alias("last"),
        F.array_join(
            F.transform(
                F.slice("said", F.lit(1), F.col("upto")),
                lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)),
            ),
            "",
        ).alias("formatted"),
    )
    trained = F.col("last.trained")
    length = F.length("last.body")
    return example.select(
        conversation,
        "example",
        "formatted",
        F.when(trained, F.length("formatted") - length - len(CLOSE)).alias("loss_start"),
        F.when(trained, length).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted example holds."""
    parts = F.split(formatted, CLOSE, -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(7)), ">", 1)).alias("role"),
            unescape(F.substr(p, F.locate(">", p) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask; null without one."""
    return unescape(F.substr(formatted, start + 1, length))
