"""Mixing sources to target weights by hash-threshold histograms.

A document takes part in a source's last, partial epoch if its hash lies below the
source's threshold. The threshold comes from histograms: words are summed by source
and leading hash bits, running sums show in which bucket the budget ends, and only
that bucket is summed again by the next bits. Documents are never sorted; a filter on
the hash applies the result. The thresholds of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: The ASCII white space that parts words; a fixed value.
_WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits in all and in each histogram.
HASH_BITS, STEP_BITS = 60, 12


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def hash60(key: F.Column) -> F.Column:
    """The leading 60 bits of the key's MD5; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh `weights` in turn and share `share` times
    all words by weight. A target stops at `cap` times its source's size and the excess
    goes to the others by weight until none is above: target = min(cap * size, level *
    weight), where the level follows from running sums over the sources by size /
    weight. The two windows without a key run over one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    # sources fill up in this order; level when all up to this one are full
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = totals.withColumns(
        {
            "all_size": F.sum("source_size").over(every),
            "full_size": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", (F.col("all_size") * share - F.col("full_size") * cap) / F.col("rest_weight"))
    stays = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    # the level falls once a source stays, so the first that stays has the highest
    level = F.max(F.when(stays, F.col("level"))).over(every)
    full = F.col("source_size") * F.lit(float(cap))
    return levels.withColumn("final", level).select(
        "source", "source_size", F.least(full, F.coalesce(F.col("final") * F.col("weight"), full)).alias("target")
    )


def source_key(source: F.Column) -> F.Column:
    """A key that is never null and keeps null apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source of `wanted` (source, source_size, target): whole epochs, the
    bounding hash of the partial one, the words left for rows at that very hash and
    those rows' size. sizes: (source, size, h)."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = (
        wanted.withColumn("epochs", ratio)
        .withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        # what rounds up to the whole source is one more epoch
        .withColumn("_whole", (F.col("source_size") > 0) & (F.col("left") >= F.col("source_size")))
        .withColumn("epochs", F.when(F.col("_whole"), F.col("epochs") + 1).otherwise(F.col("epochs")))
        .withColumn("left", F.when(F.col("_whole"), F.lit(0).cast("long")).otherwise(F.col("left")))
        .select(source_key(F.col("source")).alias("key"), "source_size", "target", "epochs", "left", F.lit(0).cast("long").alias("prefix"))
    )
    state = written(state, "mix-targets")
    rows = sizes.filter("size > 0").select(source_key(F.col("source")).alias("key"), "size", "h")
    for used in range(0, HASH_BITS, STEP_BITS):
        shift = HASH_BITS - used - STEP_BITS
        inside = rows.join(broadcast_if_small(state.select("key", "prefix")), "key").filter(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        bins = inside.groupBy("key", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("bin_size"))
        run = Window.partitionBy("key").orderBy("bin")
        ends = (
            bins.withColumn("upto", F.sum("bin_size").over(run))
            .join(broadcast_if_small(state.drop("bin_size")), "key")
            .filter("upto > left and upto - bin_size <= left")
            .select("key", "source_size", "target", "epochs", (F.col("left") - F.col("upto") + F.col("bin_size")).alias("left"), F.col("bin").alias("prefix"), "bin_size")
        )
        state = written(ends, "mix-bins")
    return state.select("key", "source_size", "target", "epochs", F.col("prefix").alias("bound"), F.col("left").alias("rest"), F.col("bin_size").alias("tie"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The documents with size, source_size, target and taken (words the mix takes,
    repeats counted); columns of these names are replaced.

    Every document is taken for the source's whole epochs, those below the bounding
    hash once more; the document at it gives the words that are left (rows that share
    its hash, as repeated ids do, give equal shares), so a source misses its target by
    less than a word for each of them. Null texts have size 0; a null source is a
    source. A source without words has target 0.
    """
    own = docs.withColumns({"_size": word_count(F.col(text_col)), "_h": hash60(F.col(id_col)), "_key": source_key(F.col(source_col))})
    sizes = written(own.select(F.col(source_col).alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h")), "mix-sizes")
    wanted = written(targets(sizes, weights, share, cap), "mix-sources")
    bounds = thresholds(sizes, wanted)
    per_source = wanted.select(source_key(F.col("source")).alias("key"), "source_size", "target").join(bounds.drop("source_size", "target"), "key", "left")
    # under names that the documents' own columns won't have
    per_source = written(per_source.select(*[F.col(c).alias(f"_{c}") for c in per_source.columns]), "mix-bounds")
    partial = (
        F.when(F.col("_h") < F.col("_bound"), F.col("_size"))
        .when(F.col("_h") == F.col("_bound"), F.expr("cast(_size as decimal(19,0)) * cast(_rest as decimal(19,0)) div cast(_tie as decimal(19,0))"))
        .otherwise(F.lit(0))
    )
    taken = F.when(F.col("_size") > 0, F.col("_size") * F.col("_epochs") + partial).otherwise(F.lit(0)).cast("long")
    new = {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "taken": taken}
    kept = [c for c in docs.columns if c not in new]
    return own.join(broadcast_if_small(per_source), "_key").select(*kept, *[v.alias(k) for k, v in new.items()])
