"""Readers and writers of the records that the jobs exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_json, strip
from . import splits
from .scratch import broadcast_if_small, written


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects, or else one record in each line; blank lines are left out.
    The form is told by the first character that isn't white space. Arrays are read in
    splits like lines, in whatever way they are laid out; what can't be parsed is a row of
    nulls."""
    start = F.ltrim(F.substring("value", 1, 256), F.lit("\ufeff \t\r\n"))
    first = spark.read.text(path, lineSep="}").select(start.alias("s")).filter("s != ''").limit(1).collect()
    if not first or not first[0].s.startswith("["):
        return spark.read.schema(schema).json(path)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    found = splits.whole_records(spark, path, splits.Brackets())
    found = found.filter(F.col("ended") | (F.trim("value", F.lit("] \t\r\n,")) != ""))
    return found.select(F.from_json("value", schema).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with line numbers from 1 that count blank lines.

    Files are read in splits of any number. A line's number is its place in its split and
    the lines of the file's splits before; only the splits' counts are gathered, one row
    for each of a file's splits.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    per_split = lines.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    per_split = written(per_split.select("file", "_split", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "splits")
    placed = lines.join(broadcast_if_small(per_split), ["file", "_split"])
    return placed.select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value")


def parse_lines(lines: DataFrame, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of rows (line_no, value): parsed records with their line_no, and
    the line numbers of what is no JSON object. Blank lines are neither."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(strip(F.col("value")) != "").withColumn("_r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("_r").isNotNull() & F.col("_r._bad").isNull() & is_json(F.col("value"))
    good = parsed.filter(whole).select("line_no", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.filter(~whole).select(F.lit("reject_node_json_error").alias("category"), "line_no")
    return good, bad


def read_jsonl_with_rejects(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(numbered_lines(spark, path), schema)


def _first_filled(*names: str, columns) -> F.Column:
    filled = [F.when(F.col(n) != "", F.col(n)) for n in names if n in columns]
    return F.coalesce(*filled, F.lit(""))


def entity_rows(rows: DataFrame) -> DataFrame:
    """(name, label, pos) with both stripped and filled, from rows with a pos."""
    out = rows.select(strip(F.col("name")).alias("name"), strip(F.col("label")).alias("label"), "pos")
    return out.filter("name != '' and label != ''")


def relation_rows(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(source, target, type, season, row_no): of alternative columns the first that is
    filled counts. Strict rows are stripped, and only those with source, target and
    type are kept; a blank season stays."""
    has = rows.columns
    if strict:
        named = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("source", "target", "type", "season")]
        return rows.select(*named, "row_no").filter("source != '' and target != '' and type != ''")
    return rows.select(
        _first_filled("source", "head", "subject", columns=has).alias("source"),
        _first_filled("target", "tail", "object", columns=has).alias("target"),
        _first_filled("type", "relation", columns=has).alias("type"),
        _first_filled("season", columns=has).alias("season"),
        "row_no",
    )


#: Fields are quoted as other CSV tools do it, and their spaces are kept.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with pos, their place in the table from 0 (files by name), and
    row_no, their place in their file from 2, as the header is the first. Fields may hold
    line breaks; blank lines are no rows. A file is read in splits of any number."""
    names = [c.removeprefix("\ufeff") for c in spark.read.csv(path, **_CSV).columns]
    found = splits.whole_records(spark, path, splits.Quotes(), with_header=True).filter("at > 0")
    fields = F.from_csv(F.rtrim("value", F.lit("\r")), ", ".join(f"`{c}` string" for c in names), {k: str(v) for k, v in _CSV.items() if k != "header"})
    return found.select(fields.alias("r"), (F.col("before") + F.col("at") - 1).alias("pos"), (F.col("at") + 1).alias("row_no")).select("r.*", "pos", "row_no")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return entity_rows(_csv(spark, path))


def read_relations(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Row numbers are those of the rows in their file, from 2 after the header."""
    return relation_rows(_csv(spark, path), strict)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.select("name", "label").orderBy("name").write.csv(path, **_CSV)


def write_relations(relations: DataFrame, path: str, order: tuple[str, ...] = ("source", "target", "type")) -> None:
    kept = [c for c in ("source", "target", "type", "season") if c in relations.columns]
    relations.orderBy(*order).select(*kept).write.csv(path, **_CSV)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """One folder for each category."""
    rejects.write.partitionBy("category").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Mentions and extractions, one record in each line, nested values kept."""
    df.write.json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Tables for a bulk load: nodes by label, edges by type. Ids are digits of hashes, which
    the default codec can't shorten."""
    nodes.write.option("compression", "zstd").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.option("compression", "zstd").partitionBy("rel_type").parquet(f"{path}/edges")
