"""Queries of readers and writers: tables go out to files in the shared folder and come
back through the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cleaning, graph
from ..sources import records
from ..sources.scratch import scratch
from ..streaming import append
from . import catalog as K
from . import sql as S
from .catalog import query
from .fixtures import cte, frame

_REL = cte("relations")


def _csv_of(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.csv(path, **records._CSV)
    return path


# --- readers -----------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations")
def read_records(spark, sf_dir):
    path = scratch(spark, "records")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows.write.json(path)
    return records.read_records(spark, path, rows.schema)


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of one file for each page of a hundred documents, in order: records, broken
    ones and blank ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    record = F.to_json(F.struct("doc_id", F.col("text"), "lang"))
    line = F.when(F.col("doc_id") % 7 == 3, F.concat(record, F.lit("}"))).when(F.col("doc_id") % 11 == 5, F.lit("  ")).otherwise(record)
    return docs.select("doc_id", line.alias("value"))


def _parsed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    path = scratch(spark, "lines")
    _lines(spark, sf_dir).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return records.read_jsonl_with_rejects(spark, path, "doc_id long, text string, lang string")


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5")
def read_jsonl_with_rejects(spark, sf_dir):
    return _parsed(spark, sf_dir)[0].select("doc_id", "text", "lang")


@query("SELECT category, line_no FROM (SELECT 'reject_node_json_error' AS category, doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents) WHERE doc_id % 7 = 3")
def read_jsonl_rejects(spark, sf_dir):
    """Of one file, so that lines have one numbering."""
    path = scratch(spark, "lines")
    _lines(spark, sf_dir).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return records.read_jsonl_with_rejects(spark, path, "doc_id long, text string, lang string")[1].select("category", "line_no")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id FROM documents")
def numbered_lines(spark, sf_dir):
    """Of one file, read in splits."""
    path = scratch(spark, "numbered")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value"), "doc_id").repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return records.numbered_lines(spark, path).select("line_no", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


#: The end of each text in the arrays.
_ODD = ' }],[{"\\"'


@query("SELECT conv_id, turn, role, text FROM conversations")
def read_records_of_arrays(spark, sf_dir):
    """Three files, each an array over many lines, with braces, brackets and quotes in texts."""
    path = scratch(spark, "arrays")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    record = F.to_json(F.struct("conv_id", "turn", "role", F.concat(F.col("text"), F.lit(_ODD)).alias("text")))
    ordered = rows.select(F.pmod("conv_id", F.lit(3)).alias("file"), "conv_id", "turn", record.alias("r"))
    last = F.lead("r").over(Window.partitionBy("file").orderBy("conv_id", "turn")).isNull()
    first = F.lag("r").over(Window.partitionBy("file").orderBy("conv_id", "turn")).isNull()
    lines = ordered.select("file", "conv_id", "turn", F.concat(F.when(first, "[\n").otherwise(""), "r", F.when(last, "\n]").otherwise(",")).alias("value"))
    lines.repartition(3, "file").sortWithinPartitions("file", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(path)
    found = records.read_records(spark, path, rows.schema)
    return found.select("conv_id", "turn", "role", F.expr(f"left(text, length(text) - {len(_ODD)})").alias("text"))


#: Some fields hold line breaks, quotes and commas.
_BROKEN = "CASE WHEN {0} IS NOT NULL AND {1} % 9 = 4 THEN {0} || chr(10) || '\"q\", ' || chr(10) || 'x' ELSE {0} END"


@query(f"""{cte('entity_rows')}, broken AS (SELECT {_BROKEN.format('name', 'pos')} AS name, label, pos FROM entity_rows)
    SELECT {S.strip('name')} AS name, {S.strip('label')} AS label, pos FROM broken WHERE {S.strip('name')} <> '' AND {S.strip('label')} <> ''""")
def read_entities(spark, sf_dir):
    """From four files, whose rows are numbered on from one to the next."""
    rows = frame(spark, sf_dir, "entity_rows").select(F.expr(_BROKEN.format("name", "pos")).alias("name"), "label", "pos")
    path = _csv_of(rows.repartitionByRange(4, "pos").sortWithinPartitions("pos").select("name", "label"), "entities")
    return records.read_entities(spark, path).select("name", "label", "pos")


def _in_one_file(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "relations").withColumn("target", F.expr(_BROKEN.format("target", "row_no")))
    return rows.repartitionByRange(1, "row_no").sortWithinPartitions("row_no")


_REL_BROKEN = f"{_REL}, broken AS (SELECT source, {_BROKEN.format('target', 'row_no')} AS target, type, season, row_no FROM relations)"


@query(f"""{_REL_BROKEN} SELECT {S.strip('source')} AS source, {S.strip('target')} AS target, {S.strip('type')} AS type, {S.strip('season')} AS season, row_no FROM broken
    WHERE {S.strip('source')} <> '' AND {S.strip('target')} <> '' AND {S.strip('type')} <> ''""")
def read_relations_strict(spark, sf_dir):
    path = _csv_of(_in_one_file(spark, sf_dir).select("source", "target", "type", "season"), "relations")
    return records.read_relations(spark, path, strict=True).select("source", "target", "type", "season", "row_no")


@query(f"""{_REL_BROKEN} SELECT coalesce(source, '') AS source, coalesce(target, '') AS target, coalesce(type, '') AS type, coalesce(season, '') AS season, row_no FROM broken""")
def read_relations(spark, sf_dir):
    """From a file with the other names of the columns."""
    odd = F.col("row_no") % 4 != 0
    path = _csv_of(_in_one_file(spark, sf_dir).select(F.when(odd, F.col("source")).alias("source"), F.when(~odd, F.col("source")).alias("head"), F.col("target").alias("object"), F.col("type").alias("relation"), "season"), "relations")
    return records.read_relations(spark, path).select("source", "target", "type", "season", "row_no")


# --- writers -----------------------------------------------------------------------


@query(f"{K._MENTIONS} SELECT name, label FROM clean")
def write_nodes(spark, sf_dir):
    path = scratch(spark, "nodes-csv")
    records.write_nodes(K.clean_nodes(spark, sf_dir), path)
    return spark.read.csv(path, **records._CSV)


@query(f"{_REL} SELECT source, target, type, season FROM relations WHERE source <> '' AND target <> '' AND type <> '' AND season <> ''")
def write_relations(spark, sf_dir):
    path = scratch(spark, "relations-csv")
    records.write_relations(frame(spark, sf_dir, "relations").filter("source != '' and target != '' and type != '' and season != ''"), path)
    return spark.read.csv(path, **records._CSV)


@query(f"{K._MENTIONS} SELECT 'reject_node_' || reason AS category, line_no, raw AS name FROM judged WHERE reason <> 'passed'")
def write_rejects(spark, sf_dir):
    path = scratch(spark, "rejects")
    records.write_rejects(cleaning.clean_nodes(K._mentions(spark, sf_dir))[1], path)
    return spark.read.json(path).select("category", "line_no", "name")


@query(f"{_REL} SELECT row_no AS line_no, 'ctx ' || source AS context, source || '|' || target AS names FROM relations")
def write_mentions(spark, sf_dir):
    rows, path = K._mentions(spark, sf_dir), scratch(spark, "mentions")
    records.write_json(rows, path)
    back = records.read_records(spark, path, rows.schema)
    return back.select("line_no", "context", F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("names"))


@query(f"{K._GRAPH} SELECT (SELECT count(*) FROM merged) AS nodes, (SELECT count(DISTINCT label) FROM merged) AS labels, (SELECT count(*) FROM linked) AS edges, (SELECT count(DISTINCT rel_type) FROM linked) AS rel_types")
def write_graph(spark, sf_dir):
    path = scratch(spark, "graph")
    nodes = graph.merge_nodes(frame(spark, sf_dir, "graph_entities"))
    records.write_graph(nodes, graph.merge_edges(frame(spark, sf_dir, "graph_relations"), nodes), path)
    n = spark.read.parquet(f"{path}/nodes").agg(F.count("*").alias("nodes"), F.count_distinct("label").alias("labels"))
    return n.join(F.broadcast(spark.read.parquet(f"{path}/edges").agg(F.count("*").alias("edges"), F.count_distinct("rel_type").alias("rel_types"))))


# --- stream ------------------------------------------------------------------------


@query(f"{_REL} SELECT source, target, type, season, min(row_no) AS row_no, 1 AS times FROM relations GROUP BY ALL")
def append_relations_stream(spark, sf_dir):
    """Records that arrive in three parts by their numbers, a batch each, and half of them once
    more; the number that each relation was appended with and how often it was."""
    source, table, checkpoint = (scratch(spark, n) for n in ("arriving", "appended", "stream"))
    rows = frame(spark, sf_dir, "relations")
    low, high = rows.agg(F.coalesce(F.min("row_no"), F.lit(0)), F.coalesce(F.max("row_no"), F.lit(0))).first()
    third = (high - low) // 3 + 1
    parts = [rows.filter((F.col("row_no") - low >= k * third) & (F.col("row_no") - low < (k + 1) * third)) for k in range(3)]
    for part in [*parts, rows.filter("row_no % 2 = 0")]:
        part.write.mode("append").json(source)
        append.append_relations_stream(spark, source, rows.schema.simpleString()[7:-1].replace(":", " "), lambda df: df, table, checkpoint, files_per_batch=1_000_000).awaitTermination()
    return spark.read.parquet(table).groupBy(*append.KEYS).agg(F.min("row_no").alias("row_no"), F.count("*").cast("int").alias("times"))
