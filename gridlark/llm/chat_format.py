"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, then that reply, and only the
reply's text is under the loss mask. A conversation whose last turn isn't an assistant's also gives one example
without a target, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside roles and texts are escaped
reversibly: a backslash becomes ``\\b``, ``<|`` becomes ``<\\p``, and in roles a line end becomes ``\\n``; so ``<|``
stands in the output at the template's own marks only.

Defined results: a null role or text is empty; turns are ordered by turn, then role, then text (nulls first), and
repeated rows are turns of their own; a null conversation id is a conversation of its own; an empty table gives no
examples. Other columns of the input are ignored. A conversation is one row, since its last example holds all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")))


def expand(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start, loss_length.

    The loss mask is the span [loss_start, loss_start + loss_length) of ``formatted`` in code points; loss_start is
    null in an example without a target.
    """
    named = turns.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_order).alias("ts"))
    shown = convs.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == TARGET_ROLE).alias("is_target"),
                F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["is_target"] | (i == last))
    examples = shown.select("conv_id", "turns", F.posexplode(ends).alias("example", "at"))
    context = F.array_join(F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    final = F.get("turns", F.col("at"))
    return examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("at") + 1).cast("long").alias("n_turns"),
        F.concat(context, final["head"]).alias("before"),
        final["body"].alias("body"),
        final["is_target"].alias("is_target"),
    ).select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("is_target"), F.length("before").cast("long")).alias("loss_start"),
        F.when(F.col("is_target"), F.length("body").cast("long")).otherwise(0).alias("loss_length"),
    )


def _by_order(a: Column, b: Column) -> Column:
    def compare(name: str) -> Column:
        x, y = a[name], b[name]
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)

    by_turn, by_role = compare("turn"), compare("role")
    return F.when(by_turn != 0, by_turn).when(by_role != 0, by_role).otherwise(compare("text"))


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds, unescaped."""
    marks = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)
    return F.transform(
        marks,
        lambda s: F.struct(
            unescaped_role(F.substring(F.substring_index(s, "\n", 1), len(START) + 1, F.length(s))).alias("role"),
            unescaped(F.substring(s, F.instr(s, "\n") + 1, F.length(s))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; empty if there is no target."""
    return F.coalesce(unescaped(F.substring(formatted, (start + 1).cast("int"), length.cast("int"))), F.lit(""))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings alone: its turns and the text under the loss masks, in order."""
    one = examples.select(
        "conv_id",
        F.col("example"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        "formatted",
    )
    return one.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    ).select("conv_id", parse_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
