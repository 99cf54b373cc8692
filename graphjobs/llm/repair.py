"""Structure repair of conversations by a cheapest sequence of edits.

Flags come from windows, turns are collected and sorted for each conversation, and one
native aggregate() folds over them. It carries, for each of four states (nothing yet, after
a system turn, after a user turn, after an assistant turn), the cheapest (cost, plan); each
step is a few least() expressions over structs, so ties go to the plan that sorts first.

Edits: keep a turn (0), change its role to user or assistant (3), delete it (4, and the
only choice for a blank or repeated turn), insert an empty turn (3). A truncated turn that
is not deleted costs 3 more. The result has the roles `(s?(ua)+)?`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of a plan: delete, insert a user or assistant turn, keep, change to user or
#: assistant. They sort as the letters of the audit do.
PLAN, AUDIT = "DIJKRS", "DIIKRR"
USER, ASSISTANT = "user", "assistant"
#: Turns that are folded before their part of a plan is put behind the rest, so that the
#: time for long conversations grows with their turns.
BLOCK = 256
#: More than any real cost: a state that can't be reached.
_NEVER = 1 << 50
_STATES = ("none", "system", "user", "assistant")
_WORD, _END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage that crc32 of `conv_id:turn` modulo 20
    decides: 0 drops the row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes
    it a user's. Nulls count as one space, but numbers stay null."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, USER).otherwise(F.col("role"))
    rows = rows.filter("_fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_fate")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def flagged(turns: DataFrame) -> DataFrame:
    """Adds initial (of the role), again (are role and text those of an earlier turn?), fault
    (blank, duplicate, truncated or null, the first that holds) and illegal (does this turn's
    initial not follow from the one before?). Turns go by number, nulls first, equal numbers
    by role and text. One exchange, by conversation, serves both windows."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    by_conv = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    own = turns.repartition("conv_id").withColumns({"initial": F.substring("role", 1, 1), "again": F.row_number().over(same) > 1})
    fault = F.when(~F.col("text").rlike(_WORD), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(_END), "truncated")
    legal = F.concat(F.lag("initial").over(by_conv), F.col("initial")).isin("su", "ua", "au")
    return own.select(*turns.columns, "initial", "again", fault.alias("fault"), F.coalesce(~legal, F.lit(False)).alias("illegal"))


def _state(cost: Column, start: Column, plan: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), start.cast("int").alias("start"), plan.alias("plan"))


def _edited(state: Column, cost: Column | int, letter: str) -> Column:
    return _state(state["cost"] + cost, state["start"], F.concat(state["plan"], F.lit(letter)))


def _step(acc: Column, turn: Column) -> Column:
    """One turn: what is cheapest for each state after it.

    Insertions come right before a kept turn or at the end, as one that precedes a deletion
    sorts after the same one behind it. Two in a row are never cheaper than what they save:
    from nothing or a system turn a user's turn follows directly, for nothing.
    """
    none, system, user, assistant = (acc[s] for s in _STATES)
    gone, more = turn["fault"].isin("blank", "duplicate"), F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def after(state: str, before: Column, letter: str | None) -> Column:
        dropped = _edited(acc[state], DELETE, "D")
        kept = F.when(turn["initial"] == state[0], _edited(before, more, "K"))
        if letter:
            kept = kept.otherwise(_edited(before, more + REROLE, letter))
        return F.when(F.coalesce(gone, F.lit(False)), dropped).otherwise(F.least(dropped, kept))

    to_user = F.least(none, system, assistant, _edited(user, INSERT, "J"))
    to_assistant = F.least(user, *(_edited(x, INSERT, "I") for x in (none, system, assistant)))
    return F.struct(
        _edited(none, DELETE, "D").alias("none"),
        after("system", none, None).alias("system"),
        after("user", to_user, "R").alias("user"),
        after("assistant", to_assistant, "S").alias("assistant"),
    )


def _block(acc: Column, turns: Column) -> Column:
    """Folds a block of turns. Inside it a plan is only its new letters and the rank of the
    plan that it goes on from; ranks decide between plans of different starts, as no plan
    that ends with a turn begins another of as many turns."""
    ranked = F.array_sort(F.array(*(acc[s]["plan"] for s in _STATES)))
    begin = F.struct(*(_state(acc[s]["cost"], F.array_position(ranked, acc[s]["plan"]), F.lit("")).alias(s) for s in _STATES))

    def joined(end: Column) -> Column:
        return F.struct(*(_state(end[s]["cost"], F.lit(0), F.concat(F.element_at(ranked, end[s]["start"]), end[s]["plan"])).alias(s) for s in _STATES))

    return F.aggregate(turns, begin, _step, joined)


def cheapest_plan(turns: Column, block: int = BLOCK) -> Column:
    """struct<cost,start,plan> of the cheapest edits of an array of turns with initial and
    fault; of equally cheap ones that whose audit sorts first."""
    none = F.struct(*(_state(F.lit(0 if s == "none" else _NEVER), F.lit(0), F.lit("")).alias(s) for s in _STATES))
    blocks = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(blocks, lambda k: F.slice(turns, k * block + 1, F.lit(block)))

    def ended(acc: Column) -> Column:
        twice = _edited(_edited(acc["system"], INSERT, "I"), INSERT, "J")
        return F.least(acc["none"], acc["assistant"], _edited(acc["user"], INSERT, "J"), twice)

    return F.aggregate(blocks, none, _block, ended)


def repaired_turns(turns: Column, plan: Column) -> Column:
    """`role:text` lines of the turns after a plan's edits."""
    steps = F.regexp_extract_all(plan, F.lit("[IJ]*[DKRS]"), F.lit(0))

    def inserted(letters: Column) -> Column:
        return F.replace(F.replace(letters, F.lit("I"), F.lit(USER + ":\n")), F.lit("J"), F.lit(ASSISTANT + ":\n"))

    def line(step: Column, turn: Column) -> Column:
        last = F.right(step, F.lit(1))
        role = F.when(last == "K", turn["role"]).when(last == "R", USER).when(last == "S", ASSISTANT)
        return F.concat(inserted(F.regexp_extract(step, "^[IJ]*", 0)), role, F.lit(":"), turn["text"])  # null for a deleted turn

    kept = F.filter(F.zip_with(steps, turns, line), lambda x: x.isNotNull())
    rest = F.rtrim(inserted(F.regexp_extract(plan, r"[IJ]*\z", 0)), F.lit("\n"))
    return F.array_join(F.concat(kept, F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))), "\n")


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each conv_id of turns (conv_id, turn, role, text): gaps (numbers missing between the
    least and the greatest turn), blank, duplicate, truncated (turns by their first fault),
    illegal (neighbours whose initials are not su, ua or au), cost, audit (D, I, K, R for each
    edit) and repaired (`role:text` lines).

    A null conv_id is a conversation like others, null roles and texts are one space, equal
    rows are repetitions, other columns are left out. One exchange, by conversation: the text
    of a conversation is the value of one row of the result, so it has to fit a task; its fold
    takes time in proportion to its turns.
    """
    known = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    item = F.struct("turn", "role", "text", "again", "initial", "fault")

    def many(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    ordered = F.array_sort(F.collect_list(item))
    numbers = F.array_distinct(F.transform(F.filter(F.col("_turns"), lambda t: t["turn"].isNotNull()), lambda t: t["turn"]))
    grouped = flagged(known).groupBy("conv_id").agg(ordered.alias("_turns"), *(many(f) for f in ("blank", "duplicate", "truncated")), F.count_if("illegal").alias("illegal"), F.max("turn").alias("_last"), F.min("turn").alias("_first"))
    gaps = F.coalesce(F.col("_last") - F.col("_first") + 1 - F.size(numbers), F.lit(0)).cast("long")
    planned = grouped.withColumn("_best", cheapest_plan(F.col("_turns"), block))
    return planned.select(
        "conv_id",
        gaps.alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        F.col("_best.cost").alias("cost"),
        F.translate("_best.plan", "JS", "IR").alias("audit"),
        repaired_turns(F.col("_turns"), F.col("_best.plan")).alias("repaired"),
    )


def digest(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations; those without turns have zeros and no edits."""
    ids = conversations.select("conv_id").distinct()
    own = repaired.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired").withColumnRenamed("conv_id", "_conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = ids.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
