"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once as the prompt; what follows on
each side is its completion, with the spans that a loss should count: the assistant's
words and the end mark, not the frame around other turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Whose words are learned.
SPEAKER = "assistant"


def _safe(text: Column) -> Column:
    """A text can't forge the marks: each `<|` in it gets a backslash."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def turn_arrays(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array<struct<role,text>>) by turn; turns with equal numbers go by
    role and text, null numbers first. Null roles and texts are empty. Rows of a null
    conv_id belong to no known conversation, so each is one of its own turn and none are
    gathered. A conversation is one row, so its turns have to fit a task."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    item = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    known = conversations.filter(F.col(conv_col).isNotNull())
    grouped = known.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    alone = conversations.filter(F.col(conv_col).isNull()).select(F.col(conv_col).alias("conv_id"), F.array(item).alias("turns"))
    return grouped.union(alone).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.coalesce(F.get(differ, F.lit(0)), n)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """array<struct<start,end>> in code points of the rendered turns: the speaker's text
    with its end mark."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, t):
        start = acc["at"] + F.length(_safe(t["role"])) + len(BEGIN) + 1
        end = start + F.length(_safe(t["text"])) + len(END)
        spans = F.when(t["role"] == SPEAKER, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), spans.alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def format_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Replaces the two arrays of turns by prompt_turns, prompt, chosen, rejected,
    chosen_loss, rejected_loss and usable.

    A pair is usable if both sides have something to learn after the prompt; sides that
    are equal, or of which one only begins the other, have not. Null sides are empty. No
    shuffle, and no row depends on another.
    """
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    own = pairs.withColumns({"_a": F.coalesce(F.col(chosen_col), none), "_b": F.coalesce(F.col(rejected_col), none)})
    own = own.withColumn("_n", common_prefix(F.col("_a"), F.col("_b")))
    own = own.withColumns({"_ta": F.slice("_a", F.col("_n") + 1, F.size("_a")), "_tb": F.slice("_b", F.col("_n") + 1, F.size("_b"))})
    own = own.withColumns({"_la": loss_spans(F.col("_ta")), "_lb": loss_spans(F.col("_tb"))})
    new = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_loss", "rejected_loss", "usable")
    return own.select(
        *[c for c in pairs.columns if c not in (*new, chosen_col, rejected_col)],
        F.col("_n").alias("prompt_turns"),
        render(F.slice("_a", 1, F.col("_n"))).alias("prompt"),
        render(F.col("_ta")).alias("chosen"),
        render(F.col("_tb")).alias("rejected"),
        F.col("_la").alias("chosen_loss"),
        F.col("_lb").alias("rejected_loss"),
        ((F.size("_la") > 0) & (F.size("_lb") > 0)).alias("usable"),
    )


def echo_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) for each conversation with a reply: it up to its last
    reply is chosen; the same where that reply only repeats what was said before is
    rejected. A reply without a turn before it is set against silence."""
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get(F.col("turns"), i - 1)["role"] == SPEAKER)
    own = turns.withColumn("_last", F.array_max(places)).filter("_last is not null")
    before = F.coalesce(F.get(F.col("turns"), F.col("_last") - 2)["text"], F.lit(""))
    echo = F.struct(F.lit(SPEAKER).alias("role"), before.alias("text"))
    return own.select(
        "conv_id",
        F.slice("turns", 1, F.col("_last")).alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("_last") - 1), F.array(echo)).alias("rejected"),
    )


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
