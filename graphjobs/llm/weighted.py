"""Fingerprints of weighted terms by consistent weighted sampling.

Each of SAMPLES samples draws, for each term, r and c from Gamma(2, 1) and b from U(0, 1),
all from the term's hash, so that a term gets the same draws in every text. With a weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the term with the least a is the
sample, as (term, t). Two texts have the same sample with a probability equal to the
generalised Jaccard similarity of their weights, sum(min) / sum(max).

Terms are words, weights are how often a text has them. Only DataFrame functions are used.
A sample and its ln a are one long, so the least is found by a plain min() in generated
code: 40 bits of ln a in steps of 2^-32 before 23 bits that name (term, t).

A draw depends on a term and its weight alone, so those of frequent words are drawn once for
the corpus and looked up; all others are drawn in place, with the same outcome.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Samples of a fingerprint; the similarity has a standard error of 0.0625 at most.
SAMPLES = 64
#: Hex digits of a sample in the fingerprint; two that differ look alike in 2^-16 of cases.
DIGITS = 4
SEPARATOR = r"[\x20\x09-\x0D]+"
#: Rows of a block of neighbouring ids, about, and the most blocks; rows of a partition, about,
#: and the most partitions, unless the session has more. Words are counted within partitions,
#: so small ones are counted in memory.
BLOCK_ROWS, BLOCKS = 256, 1 << 16
PARTITION_ROWS, PARTITIONS = 2_048, 20_000
#: Draws are looked up for words that make up one in FREQUENT or more of all that are found
#: RARE times at least, so for FREQUENT words at most: 540 bytes for each weight.
FREQUENT, RARE = 1 << 16, 8
#: Samples that a row draws at once; a term has a row for each such part, so that generated
#: code, which the driver compiles too, doesn't grow with the samples.
AT_ONCE = 16

_NAME_BITS, _STEP_BITS, _OFFSET = 23, 32, 128
#: Its multiples part the draws of a term.
_ODD = 0x9E3779B97F4A7C15


def _signed(x: int) -> int:
    """The lowest 64 bits as a long."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def sample(term: Column, log_weight: Column, seed: Column, known: Column | None = None, k: Column | None = None) -> Column:
    """The draw of a term by a sample's seed as one long; the least of a text's terms is its
    sample.

    term is a long (a hash), log_weight the natural logarithm of a weight of 1 or more, null
    with a null term. With `known`, an array that is null or holds the draws, the k-th one is
    taken where there is one; branches then keep the parts of others in local variables and
    skip what isn't needed: a weight of 1, the usual one, has t = 0.
    """
    first = F.xxhash64(term.bitwiseXOR(seed))
    second = F.xxhash64(first)

    def part(hash: Column, low: int, bits: int) -> Column:
        """Some bits of a hash as a number, in the middle of its step."""
        own = F.shiftrightunsigned(hash, low) if low else hash
        return own.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5

    # products of two uniform numbers in (0, 1)
    r = -F.log(part(first, 0, 21) * part(first, 21, 21) * 2.0**-42)
    b = part(first, 42, 22) * 2.0**-22
    log_c = F.log(-F.log(part(second, 0, 32) * part(second, 32, 32) * 2.0**-64))
    t = F.floor(log_weight / r + b)

    def packed(log_a: Column, named: Column) -> Column:
        name = named.bitwiseAND(F.lit((1 << _NAME_BITS) - 1))
        return F.shiftleft(((log_a + float(_OFFSET)) * float(1 << _STEP_BITS)).cast("long"), _NAME_BITS).bitwiseOR(name)

    once = packed(log_c - r * (1.0 - b), second)
    often = packed(log_c - r * (t - b + 1.0), second.bitwiseXOR(F.shiftleft(t, 7)))
    if known is None:
        return often
    return F.when(known.isNotNull(), F.get(known, k)).when(log_weight == 0.0, once).when(log_weight > 0.0, often)


def weighted_terms(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, term, weight): the words of a text and how often it has each."""
    words = texts.select(*key, F.explode(F.split(text_col, SEPARATOR)).alias("_word")).filter("_word <> ''")
    return words.groupBy(*key, F.xxhash64("_word").alias("term")).agg(F.count("*").alias("weight"))


def _pair(term: Column, weight: Column) -> Column:
    return F.xxhash64(term, weight.cast("long"))


def frequent_draws(texts: DataFrame, text_col: str, n: int = SAMPLES) -> DataFrame:
    """(pair, draws: array<long>): the n draws of frequent words, all texts counted, under the
    hash of (term, weight). A word that is twice as frequent as need be has the draws of
    weights 1 and 2, one four times as frequent those of 1 to 3, and so on."""
    words = texts.select(F.explode(F.split(text_col, SEPARATOR)).alias("_word")).filter("_word <> ''")
    often = written(words.groupBy(F.xxhash64("_word").alias("term")).agg(F.count("*").alias("often")).filter(F.col("often") >= RARE), "words-often")
    least = max(RARE, (often.agg(F.sum("often")).first()[0] or 0) / FREQUENT)
    weights = F.sequence(F.lit(1), (1 + F.floor(F.log2(F.col("often") / least))).cast("int"))
    pairs = often.filter(F.col("often") >= least).select("term", F.explode(weights).alias("weight"))
    drawn = samples(pairs.withColumn("pair", _pair(F.col("term"), F.col("weight"))), ["pair"], n=n)
    return written(drawn.withColumnRenamed("samples", "draws"), "words-draws")


def sampled_parts(terms: DataFrame, key: list[str], weight_col: str = "weight", n: int = SAMPLES, known: DataFrame | None = None) -> DataFrame:
    """(key, part, _0, _1, ...) of (key, term: long, weight): what the samples of each part,
    AT_ONCE of the n, take from the terms of a key; null beyond the n-th. Weights are one or
    more; a null term gives null draws, so a key that has no other keeps its rows. Draws in
    `known`, of frequent_draws, are looked up; weights are whole numbers then."""
    term, log, draws = F.col("term"), F.col("_log"), None
    own = terms.withColumn("_log", F.when(term.isNotNull(), F.log(F.col(weight_col).cast("double"))))
    if known is not None:
        own = own.withColumn("_pair", _pair(term, F.col(weight_col))).join(F.broadcast(known), F.col("_pair") == F.col("pair"), "left")
        draws = F.col("draws")
    seeds = [F.array(*(F.lit(_signed((k + 1) * _ODD)) for k in range(at, min(at + AT_ONCE, n)))) for at in range(0, n, AT_ONCE)]
    dealt = own.select("*", F.posexplode(F.array(*seeds)).alias("part", "_seeds"))
    least = (F.min(sample(term, log, F.get("_seeds", F.lit(i)), draws, F.col("part") * AT_ONCE + i)).alias(f"_{i}") for i in range(AT_ONCE))
    return dealt.groupBy(*key, "part").agg(*least)


def samples(terms: DataFrame, key: list[str], weight_col: str = "weight", n: int = SAMPLES, known: DataFrame | None = None) -> DataFrame:
    """(key, samples: array<long>): the parts of sampled_parts, joined."""
    part = F.struct("part", F.array(*(F.col(f"_{i}") for i in range(AT_ONCE))).alias("own"))
    parts = sampled_parts(terms, key, weight_col, n, known).groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    return parts.select(*key, F.slice(F.flatten("_parts.own"), 1, n).alias("samples"))


def fingerprint(samples_: Column) -> Column:
    """DIGITS hex digits for each sample; '' for null, as a text without words has none."""
    digits = F.transform(samples_, lambda s: F.lpad(F.hex(s.bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints: 1 if neither has any, 0 if one has none."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(DIGITS))
    same = F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(DIGITS)) == F.substr(b, i, F.lit(DIGITS)))) / F.size(places)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) for each row of docs. Null and empty texts have ''; rows that repeat
    and null ids stay; other columns are left out. The text itself is not shuffled, its
    samples are once, to give rows without words theirs."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = samples(weighted_terms(rows, ["_row", "id"], "_text"), ["_row", "id"], n=n)
    bare = rows.filter(~F.col("_text").rlike(r"[^\x20\x09-\x0D]")).select("id", F.lit("").alias("fingerprint"))
    return found.select("id", fingerprint(F.col("samples")).alias("fingerprint")).unionByName(bare)


def _boundaries(ids: DataFrame, rows: int) -> list[int]:
    """Ids that part the rows into blocks of about BLOCK_ROWS, as quantiles; one less than a
    power of two, at most BLOCKS - 1."""
    levels = max(0, min(math.ceil(math.log2(max(1, rows / BLOCK_ROWS))), int(math.log2(BLOCKS))))
    n = 1 << levels
    if n == 1:
        return []
    shares = [k / n for k in range(1, n)]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n))).first()[0]
    return found or []


def _block(id: Column, boundaries: list[int]) -> Column:
    """Number of boundaries up to an id, by halving; nulls come first."""
    if not boundaries:
        return F.lit(0)
    held = F.array(*(F.lit(b).cast("long") for b in boundaries)) if len(boundaries) < 512 else F.split(F.lit(",".join(map(str, boundaries))), ",").cast("array<long>")
    steps = [1 << k for k in reversed(range(len(boundaries).bit_length()))]
    found = F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= id, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(block, place, doc_id, text, next_text, last) of (doc_id, text): each text with that of
    the next id; behind the last comes the first. Equal ids go by text, null ids first.

    Blocks of neighbouring ids are parted by quantiles, so that none is large unless one id
    is. The first rows of each block also stand at the end of the block before (last is true
    there), which is how a window inside a block sees the next one. One exchange of the
    texts, by block.
    """
    n = docs.select("doc_id").count()
    boundaries = _boundaries(docs.select("doc_id"), n)
    own = docs.withColumn("block", _block(F.col("doc_id"), boundaries))
    heads = own.groupBy("block").agg(F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    rows = sorted(heads.collect(), key=lambda r: r["block"])  # BLOCKS at most
    before = {b["block"]: a["block"] for a, b in zip([rows[-1], *rows[:-1]], rows, strict=True)} if rows else {}
    schema = "head long, target int"
    targets = docs.sparkSession.createDataFrame([(None if r["nulls"] else r["head"], before[r["block"]]) for r in rows], schema)
    seams = own.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("target").alias("block"), F.lit(True).alias("last"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTITIONS, n // PARTITION_ROWS))
    all_rows = own.select("doc_id", "text", "block", F.lit(False).alias("last")).unionByName(seams).repartition(parts, "block")
    order = Window.partitionBy("block").orderBy("last", F.col("doc_id").asc_nulls_first(), "text")
    return all_rows.select("block", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "last")


def edited_text(text: Column, next_text: Column) -> Column:
    """The last quarter of a text's characters, rounded down, gives way to the beginning of
    the next text, of as many or all of its characters."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - n), F.left(next_text, n))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next for each row of docs. Null texts are empty, ids are cast to long, other columns
    are left out; rows that repeat stay.

    Text and edited text are counted together, and a word that both have equally often is
    sampled once for both. Counting, sampling and the look at the next fingerprint go on in
    the partitions of the exchange by block; only fingerprints move again.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = ["block", "place"]
    rows = with_next(docs).withColumn("edited", F.coalesce(edited_text(F.col("text"), F.col("next_text")), F.lit("")))
    words = F.filter(F.split("text", SEPARATOR), lambda w: w != "")
    new_words = F.filter(F.split("edited", SEPARATOR), lambda w: w != "")
    # a row without words has one null word, so that it stays in its place
    sides = F.array(F.struct(F.lit(1).alias("own"), F.lit(0).alias("new"), words.alias("words")), F.struct(F.lit(0).alias("own"), F.lit(1).alias("new"), new_words.alias("words")))
    met = rows.select(*key, F.explode(sides).alias("side")).select(*key, "side.own", "side.new", F.explode_outer("side.words").alias("word"))
    counted = met.groupBy(*key, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")).agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    own, new = F.col("own"), F.col("new")
    in_both, apart = F.array(F.struct(F.lit(0).alias("side"), own.alias("weight"))), F.array(F.struct(F.lit(1).alias("side"), own.alias("weight")), F.struct(F.lit(2).alias("side"), new.alias("weight")))
    parted = counted.select(*key, "term", F.explode(F.when(own == new, in_both).otherwise(apart)).alias("x")).select(*key, "x.side", "term", "x.weight").filter("weight > 0")
    sampled = sampled_parts(parted, [*key, "side"], n=n, known=frequent_draws(docs, "text", n))
    # what a text takes: the lesser of what its shared and its own words give
    names = [f"_{i}" for i in range(AT_ONCE)]
    sides = sampled.groupBy(*key, "part").agg(*(F.min(F.when(F.col("side") != other, F.col(c))).alias(f"{name}{c}") for name, other in (("own", 2), ("new", 1)) for c in names))
    part = F.struct("part", *(F.array(*(F.col(f"{name}{c}") for c in names)).alias(name) for name in ("own", "new")))
    texts = sides.groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("_parts"))

    def printed(name: str) -> Column:
        found = F.slice(F.flatten(f"_parts.{name}"), 1, n)
        return F.when(F.get(found, F.lit(0)).isNull(), "").otherwise(fingerprint(found))

    prints = texts.select(*key, printed("own").alias("fingerprint"), printed("new").alias("edited_fingerprint"))
    prints = prints.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place")))
    prints = prints.select(*key, "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
    told = rows.filter(~F.col("last")).select(*key, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return told.join(prints, key).drop(*key)
