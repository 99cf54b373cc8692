"""Requests to a model that extracts relations, and what its responses hold.

The model is a function of the user's; its answers are a column like any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..sources.scratch import scratch, written

MAX_CANDIDATES, MAX_CONTEXT, MIN_CONTEXT = 60, 1500, 5


def select_candidates(entities: Column, cap: int = MAX_CANDIDATES) -> Column:
    """All entities in their order, or of more than cap the longest names, of equal
    lengths the first; none if there are fewer than two."""
    keyed = F.transform(entities, lambda e, i: F.struct((-F.length(e["name"])).alias("short"), i.alias("i"), e.alias("e")))
    longest = F.transform(F.slice(F.array_sort(keyed), 1, cap), lambda k: k["e"])
    return F.when(F.size(entities) > cap, longest).when(F.size(entities) < 2, F.slice(entities, 1, 0)).otherwise(entities)


def promote_season_entity(entities: Column, season: Column) -> Column:
    """The first entity named like a known season moves to the front."""
    at = F.array_position(F.transform(entities, lambda e: e["name"]), season)
    moved = F.concat(
        F.slice(entities, F.greatest(at, F.lit(1)).cast("int"), 1), F.filter(entities, lambda e, i: i + 1 != at)
    )
    return F.when((season != C.UNKNOWN_SEASON) & (at > 0), moved).otherwise(entities)


def prepare_requests(mentions: DataFrame, cap: int = MAX_CANDIDATES) -> DataFrame:
    """(id, season, candidates, candidates_text, context) of mentions with two entities
    and five characters at least."""
    rows = mentions.filter((F.size("entities") >= 2) & (F.length("context") >= MIN_CONTEXT))
    rows = rows.withColumn("candidates", select_candidates(promote_season_entity(F.col("entities"), F.col("season")), cap))
    line = lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["label"], F.lit(")"))
    return rows.select("id", "season", "candidates", F.array_join(F.transform("candidates", line), "\n").alias("candidates_text"), F.substring("context", 1, MAX_CONTEXT).alias("context"))


def request_key() -> Column:
    """A request's hash: its answer is known by it in any later run."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce("candidates_text", F.lit("")), F.coalesce("context", F.lit(""))), 256)


_ANSWER = "key string, response string"


def known_answers(spark: SparkSession, log: str) -> DataFrame:
    """(key, response) that tasks have put into the folder `log`; a line that was cut off is
    none, and of several answers to one request the least stays."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return spark.read.schema(_ANSWER).json(log).filter("key is not null").groupBy("key").agg(F.min("response").alias("response"))


class _Log:
    """Answers on their way into a folder that all executors share, a file for each save."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = FileSystem.from_uri(folder)

    def save(self, answers: list[tuple[str, str | None]]) -> None:
        lines = "".join(json.dumps({"key": k, "response": r}, ensure_ascii=False) + "\n" for k, r in answers)
        with self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.json") as out:
            out.write(lines.encode())


def apply_extractor(
    requests: DataFrame, extractor: Callable[[pd.Series, pd.Series], pd.Series], log: str | None = None, save_every: int = 16, parallel: int | None = None, retries: int = 1
) -> DataFrame:
    """Adds response: extractor(candidates texts, contexts).

    Each different request is asked once. Requests go to the model `save_every` at a time,
    and what it answers is in the folder `log` before the next ones go: a run that was
    stopped, or a task that Spark runs again, asks only what has no answer there. A folder
    that every executor reaches serves later runs as well; without one a new one is made.
    At most `parallel` tasks ask at once, as a model's server may demand. Where several
    fail together, each is asked alone; one that fails alone is tried `retries` times more,
    then it has an empty response, no answer is kept and the job goes on.
    """
    spark = requests.sparkSession
    log = log or scratch(spark, "answers")
    asked = requests.withColumn("_key", request_key())
    missing = asked.groupBy(F.col("_key").alias("key")).agg(F.first("candidates_text").alias("candidates_text"), F.first("context").alias("context"))
    missing = missing.join(known_answers(spark, log).select("key"), "key", "left_anti")

    def tried(a: pd.Series, b: pd.Series) -> list:
        """(number, answer) of those that were answered."""
        for _ in range(1 if len(a) > 1 else 1 + retries):
            try:
                found = list(extractor(a, b))
                if len(found) == len(a):
                    return list(enumerate(found))
            except Exception:  # whatever a model's client raises
                pass
        return [(i, x) for i in range(len(a)) for _, x in tried(a.iloc[i : i + 1], b.iloc[i : i + 1])] if len(a) > 1 else []

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _Log(log)
        for batch in batches:
            for at in range(0, len(batch), save_every):
                part = batch.iloc[at : at + save_every].reset_index(drop=True)
                answers = [(part["key"][i], x) for i, x in tried(part["candidates_text"], part["context"])]
                if answers:
                    kept.save(answers)
                yield pd.DataFrame({"n": [len(answers)]})

    missing = missing.repartition(parallel) if parallel else missing
    missing.mapInPandas(ask, "n long").agg(F.sum("n")).collect()
    answers = known_answers(spark, log).withColumnRenamed("key", "_key")
    return written(asked.join(answers, "_key", "left").drop("_key"), "responses")


#: What a free extraction holds; relations keep each item as JSON, as they are lists or
#: strings.
EXTRACTION = "struct<entities:array<string>,relations:array<string>,attributes:array<struct<entity:string,attribute:string,value:string>>>"


def parse_response_object(response: Column) -> Column:
    """The JSON object of a response as text: the whole of it, else a fenced block, else
    from its first to its last brace; null if none is an object."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    is_object = lambda c: X.is_json(c) & c.rlike(r"(?s)\A\s*\{")
    return F.when(is_object(response), response).when(X.is_json(response), F.lit(None)).when(is_object(fenced), fenced).when(is_object(braced), braced)


def parse_response_list(response: Column) -> Column:
    """The JSON list of a response as text: inside its first fence, or all of it; `[]` if
    it isn't one."""
    fenced = F.split(response, "```json", 2)
    plain = F.split(response, "```", 3)
    body = (
        F.when(F.contains(response, F.lit("```json")), F.get(F.split(F.get(fenced, F.lit(1)), "```", 2), F.lit(0)))
        .when(F.contains(response, F.lit("```")), F.get(plain, F.lit(1)))
        .otherwise(response)
    )
    return F.when(X.is_json(body) & body.rlike(r"(?s)\A\s*\["), body).otherwise(F.lit("[]"))


def normalize_extraction(parsed: Column) -> Column:
    """struct<entities,relations array<array<string>>,attributes>: missing parts are
    empty. A relation of three items or more stays whole; one given as text is split at
    commas and hyphens and keeps its first, second and last part; others are dropped."""
    rec = F.from_json(parsed, EXTRACTION)
    as_list = lambda r: F.from_json(r, "array<string>")
    parts = lambda r: F.split(r, r"[,，-]\s*", -1)
    three = lambda p: F.array(F.trim(F.get(p, F.lit(0))), F.trim(F.get(p, F.lit(1))), F.trim(F.element_at(p, -1)))
    fixed = F.transform(
        F.coalesce(rec["relations"], F.array().cast("array<string>")),
        lambda r: F.when(r.startswith("["), F.when(F.size(as_list(r)) >= 3, as_list(r))).otherwise(F.when(F.size(parts(r)) >= 3, three(parts(r)))),
    )
    return F.struct(
        F.coalesce(rec["entities"], F.array().cast("array<string>")).alias("entities"),
        F.filter(fixed, lambda r: r.isNotNull()).alias("relations"),
        F.coalesce(rec["attributes"], F.expr("cast(array() as array<struct<entity:string,attribute:string,value:string>>)")).alias("attributes"),
    )


def _triples(text: str | None) -> list[list[str]]:
    try:
        items = json.loads(text or "[]")
    except ValueError:
        return []
    if not isinstance(items, list) or any(not hasattr(i, "__len__") for i in items):
        return []
    return [i for i in items if isinstance(i, list) and len(i) == 3 and all(isinstance(x, str) for x in i)]


def listed_relations(response_list: Column) -> Column:
    """Triples of a JSON list; a list with an item that has no length is void, as no
    reader got past it. Values that aren't text can't name an entity."""

    @F.pandas_udf("array<array<string>>")
    def read(responses: pd.Series) -> pd.Series:
        return pd.Series([_triples(t) for t in responses])

    return read(response_list)


def validate_relations(responses: DataFrame) -> DataFrame:
    """(id, season, head, type, tail, pos) of (id, season, candidates, relations): triples
    whose ends are two different candidates."""
    names = F.transform("candidates", lambda e: e["name"])
    rows = responses.withColumn("_names", names).select("id", "season", "_names", F.posexplode("relations").alias("pos", "r"))
    part = lambda i: F.get(F.col("r"), F.lit(i))
    rows = rows.filter(F.size("r") == 3).select("id", "season", "_names", part(0).alias("head"), part(1).alias("type"), part(2).alias("tail"), "pos")
    return rows.filter(F.array_contains("_names", F.col("head")) & F.array_contains("_names", F.col("tail")) & (F.col("head") != F.col("tail"))).drop("_names")


def drop_generic_relations(relations: DataFrame) -> DataFrame:
    generic = F.col("head").isin(*C.GENERIC_HEADS) & F.col("type").isin(*C.GENERIC_TYPES)
    empty = (F.col("type") == "属于") & (F.col("tail") == "养生")
    return relations.filter(~generic & ~empty)


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """(source, target, type, season, doc_pos, pos): distinct, with the place where each
    was first seen."""
    first = F.min(F.struct(F.col("id").alias("doc_pos"), "pos")).alias("first")
    found = relations.groupBy(F.col("head").alias("source"), F.col("tail").alias("target"), "type", "season").agg(first)
    return found.select("source", "target", "type", "season", "first.doc_pos", "first.pos")


def append_relations(existing: DataFrame, relations: DataFrame) -> DataFrame:
    """The distinct relations that existing ones don't have."""
    keys = ["source", "target", "type", "season"]
    return dedupe_relations(drop_generic_relations(relations)).join(existing.select(*keys).distinct(), keys, "left_anti")
