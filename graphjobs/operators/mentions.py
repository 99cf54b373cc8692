"""Entity dictionaries and the mentions of their names in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..sources.scratch import written

#: Names that a dictionary may have to be matched name by name.
FEW_NAMES = 300
#: Characters of names in one automaton; larger dictionaries take several passes.
BLOCK_CHARS = 8_000_000


def build_entity_dictionary(responses: DataFrame, short_names=C.SHORT_DICTIONARY_NAMES) -> DataFrame:
    """(name, label) from (doc_pos, entities array<struct<name,label>>): names of one
    character only if listed, both filled; the label seen first wins."""
    rows = responses.select("doc_pos", F.posexplode("entities").alias("item", "e"))
    rows = rows.select(X.strip(F.coalesce("e.name", F.lit(""))).alias("name"), X.strip(F.coalesce("e.label", F.lit(""))).alias("label"), F.struct("doc_pos", "item").alias("pos"))
    kept = rows.filter((F.col("name") != "") & (F.col("label") != "") & ((F.length("name") >= 2) | F.col("name").isin(*short_names)))
    return kept.groupBy("name").agg(F.min_by("label", "pos").alias("label"))


def append_entities(existing: DataFrame, responses: DataFrame) -> DataFrame:
    """The rows (name, label) that responses add to an existing dictionary."""
    return build_entity_dictionary(responses).join(existing.select("name"), "name", "left_anti")


def load_entity_map(rows: DataFrame) -> DataFrame:
    """(name, label, pos) from (name, label, pos): names stripped and filled; the last
    label wins, at the place where the name came first. A null label makes no row."""
    own = rows.filter("label is not null").select(X.strip(F.coalesce("name", F.lit(""))).alias("name"), X.strip(F.col("label")).alias("label"), "pos")
    return own.filter("name != ''").groupBy("name").agg(F.max_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def load_lexicon(rows: DataFrame) -> DataFrame:
    """(name, label, pos): the first label wins, blank ones are Other. By length of name
    and pos this is the order in which questions are searched."""
    label = X.strip(F.coalesce("label", F.lit("")))
    own = rows.select(X.strip(F.coalesce("name", F.lit(""))).alias("name"), F.when(label == "", "Other").otherwise(label).alias("label"), "pos")
    return own.filter("name != ''").groupBy("name").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def relation_types(relations: DataFrame) -> DataFrame:
    """Distinct filled types, longest first."""
    types = relations.select(X.strip(F.coalesce("type", F.lit(""))).alias("type")).filter("type != ''").distinct()
    return types.orderBy(F.desc(F.length("type")), "type")


def _by_name(docs: DataFrame, names: list) -> DataFrame:
    """Each name is looked for in each text, all within the row."""
    listed = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.label).alias("label"), F.lit(r.pos).alias("pos")) for r in names])
    places = F.transform(listed, lambda n: F.struct(F.call_function("instr", F.col("context"), n["name"]).alias("start"), (-F.length(n["name"])).alias("short"), n["pos"].alias("pos"), n["name"].alias("name"), n["label"].alias("label")))
    return docs.withColumn("_found", F.filter(places, lambda p: p["start"] > 0))


_FOUND = "array<struct<start:int,short:int,pos:bigint,name:string,label:string>>"


class _Names:
    """Names on their way to the workers, each of which builds the automaton once."""

    def __init__(self, listed: list[tuple]):
        self.listed, self._automaton = listed, None

    def __getstate__(self):
        return {"listed": self.listed, "_automaton": None}

    def places(self, text: str | None) -> list[dict]:
        """Where each name first occurs."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for name, label, pos in self.listed:
                self._automaton.add_word(name, (len(name), pos, name, label))
            self._automaton.make_automaton()
        first: dict = {}
        for last, hit in self._automaton.iter(text or ""):
            first.setdefault(hit, last - hit[0] + 2)
        return [{"start": at, "short": -n, "pos": pos, "name": name, "label": label} for (n, pos, name, label), at in first.items()]


def _by_automaton(docs: DataFrame, names: list) -> DataFrame:
    """One Aho-Corasick pass over each text finds all names."""
    shared = docs.sparkSession.sparkContext.broadcast(_Names([(r.name, r.label, r.pos) for r in names]))

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.places(t) for t in texts], dtype=object)

    return docs.withColumn("_found", find("context"))


def with_names(docs: DataFrame, dictionary: DataFrame, method: str = "auto", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds _all, where each dictionary name (name, label, pos) first occurs in the
    context. method names looks for few names one by one with SQL functions, automaton
    for any number in one pass; auto decides by their number.

    Names come in blocks of a bounded size. With more than one, the texts are a table that
    each block reads, and what a block finds is kept by the row's number alone; the rows
    with hits get them by one join at the end.
    """
    size = dictionary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    few = method == "names" or (method == "auto" and size.n <= FEW_NAMES)
    blocks = 1 if few else max(1, -(-size.chars // block_chars))
    empty = F.expr(f"cast(array() as {_FOUND})")

    def names_of(b: int) -> list:
        return dictionary.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).select("name", "label", F.col("pos").cast("long").alias("pos")).collect()

    if blocks == 1:
        names = names_of(0)
        return (_by_name if few else _by_automaton)(docs, names).withColumnRenamed("_found", "_all") if names else docs.withColumn("_all", empty)
    own = written(docs.withColumn("_row", F.monotonically_increasing_id()), "named-texts")
    found = None
    for b in range(blocks):
        if names := names_of(b):
            hits = written(_by_automaton(own.select("_row", "context"), names).filter(F.size("_found") > 0).select("_row", "_found"), "named")
            found = hits if found is None else found.union(hits)
    merged = found.groupBy("_row").agg(F.flatten(F.collect_list("_found")).alias("_all"))
    return own.join(merged, "_row", "left").withColumn("_all", F.coalesce("_all", empty)).drop("_row")


def link_mentions(docs: DataFrame, dictionary: DataFrame, method: str = "auto", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, season, context, entities array<struct<name,label>>) of documents (id,
    season, context) that hold a dictionary name.

    Each name counts once, by where it first occurs; of names that start together the
    longer comes first, then the dictionary's order. Names within names stay. A null
    season is unknown. Documents are not shuffled by a dictionary of one block; see
    with_names.
    """
    own = docs.filter(F.col("context") != "").select("id", F.coalesce("season", F.lit(C.UNKNOWN_SEASON)).alias("season"), "context")
    out = with_names(own, dictionary, method, block_chars).filter(F.size("_all") > 0)
    ordered = F.transform(F.array_sort("_all"), lambda p: F.struct(p["name"].alias("name"), p["label"].alias("label")))
    return out.select("id", "season", "context", ordered.alias("entities"))
