"""Mentions, votes and relations to clean nodes and relations, with rejects.

Order matters in the rules (first seen, first vote), so rows carry explicit positions and
no result depends on how they are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..sources.scratch import broadcast_if_small


def resolve_labels(votes: DataFrame) -> DataFrame:
    """(name, label): the label with most votes, of equals the one seen first. Votes are
    (name, label, pos); they are counted by name and label before they are shuffled by
    name, so a name with a third of all votes costs no more than another."""
    counted = votes.groupBy("name", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = F.max_by("label", F.struct("n", F.struct(_negated("first", votes))))
    return counted.groupBy("name").agg(best.alias("label"))


def _negated(column: str, votes: DataFrame):
    """A position whose order is turned round; positions are numbers or structs of them."""
    kind = votes.schema["pos"].dataType
    if hasattr(kind, "fields"):
        return F.struct(*[(-F.col(f"{column}.{f.name}")).alias(f.name) for f in kind.fields]).alias("first")
    return (-F.col(column)).alias("first")


def votes_of_washed(washed: DataFrame, max_name_length: int = 32) -> DataFrame:
    """(name, label, pos) of each entity and of both ends of each whole relation in
    records (doc_pos, entities, relations), in the order in which they are read."""
    ents = washed.select("doc_pos", F.posexplode("entities").alias("item", "raw"))
    ents = ents.select(X.sanitize_name(F.col("raw")).alias("name"), F.struct("doc_pos", F.lit(0).alias("kind"), "item", F.lit(0).alias("side")).alias("pos"))
    ents = ents.filter((F.col("name") != "") & (F.length("name") <= max_name_length))
    ents = ents.select("name", X.infer_label(F.col("name"), F.lit(""), F.lit(False)).alias("label"), "pos")
    rels = _whole_relations(washed, max_name_length)
    side = lambda column, subject: rels.select(
        F.col(column).alias("name"),
        X.infer_label(F.col(column), F.col("type"), F.lit(subject)).alias("label"),
        F.struct("doc_pos", F.lit(1).alias("kind"), "item", F.lit(0 if subject else 1).alias("side")).alias("pos"),
    )
    return ents.union(side("source", True)).union(side("target", False))


def _whole_relations(washed: DataFrame, max_name_length: int) -> DataFrame:
    rels = washed.select("doc_pos", F.posexplode("relations").alias("item", "r")).filter(F.size("r") >= 3)
    part = lambda i: X.sanitize_name(F.get(F.col("r"), F.lit(i)))
    rels = rels.select("doc_pos", "item", part(0).alias("source"), part(2).alias("target"), part(1).alias("type"))
    filled = (F.col("source") != "") & (F.col("target") != "") & (F.col("type") != "")
    short = (F.length("source") <= max_name_length) & (F.length("target") <= max_name_length)
    return rels.filter(filled & short)


def collect_graph(washed: DataFrame, max_name_length: int = 32) -> tuple[DataFrame, DataFrame]:
    """(votes, relations): the votes for labels and the distinct relations."""
    relations = _whole_relations(washed, max_name_length).select("source", "target", "type").distinct()
    return votes_of_washed(washed, max_name_length), relations


def judged_mentions(mentions: DataFrame) -> DataFrame:
    """A row for each mention of records (line_no, context, entities) with its cleaned
    name, label and reason."""
    rows = mentions.select("line_no", X._or_empty(F.col("context")).alias("context"), F.posexplode("entities").alias("item", "e"))
    label = F.coalesce(F.when(F.col("e.label") != "", F.col("e.label")), F.lit("Entity"))
    return rows.select("line_no", "item", F.col("e.name").alias("raw_name"), X.clean_string(F.col("e.name")).alias("name"), label.alias("label"), F.substring("context", 1, 100).alias("context")).withColumn(
        "reason", X.validate_entity(F.col("name"))
    )


def clean_nodes(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejects): a label for each valid name by votes, and the mentions that
    fail with their category."""
    rows = judged_mentions(mentions)
    votes = rows.filter("reason = 'passed'").select("name", "label", F.struct("line_no", "item").alias("pos"))
    bad = rows.filter("reason != 'passed'")
    rejects = bad.select(F.concat(F.lit("reject_node_"), "reason").alias("category"), "line_no", F.col("raw_name").alias("name"), "label", "context")
    return resolve_labels(votes), rejects


def judged_relations(relations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Relations (source, target, type, season, row_no) with cleaned values, category
    (null if they stand) and reason. nodes: the names that may occur; none of them known
    means that all may."""
    rows = relations.select(
        "row_no",
        X.clean_string(F.col("source")).alias("source"),
        X.clean_string(F.col("target")).alias("target"),
        X.clean_string(F.col("type")).alias("type"),
        X.clean_string(F.col("season")).alias("season"),
    )
    rows = rows.withColumns({"head": X.validate_entity(F.col("source")), "tail": X.validate_entity(F.col("target"))})
    missing = F.lit(False)
    if nodes is not None and not nodes.isEmpty():
        names = broadcast_if_small(nodes.select("name").distinct(), 500_000)
        rows = rows.join(names.withColumnRenamed("name", "_s"), F.col("source") == F.col("_s"), "left")
        rows = rows.join(names.withColumnRenamed("name", "_t"), F.col("target") == F.col("_t"), "left")
        missing = F.col("_s").isNull() | F.col("_t").isNull()
    bad = (F.col("head") != "passed") | (F.col("tail") != "passed")
    category = (
        F.when(F.col("type") == "", "reject_relation_format_error")
        .when(bad, "reject_relation_bad_entity")
        .when(F.col("source") == F.col("target"), "reject_relation_self_loop")
        .when(missing, "reject_relation_missing_node")
    )
    reason = F.concat(F.lit("Head:"), "head", F.lit(", Tail:"), "tail")
    rows = rows.withColumn("category", category)
    return rows.withColumn("reason", F.when(F.col("category") == "reject_relation_bad_entity", reason)).drop("_s", "_t", "head", "tail")


def clean_relations(relations: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations, rejects): distinct whole relations with an inferred season and the
    row where each was first seen, and what fails by category."""
    rows = judged_relations(relations, nodes)
    season = X.infer_season(F.col("season"), F.col("source"), F.col("target"))
    good = rows.filter("category is null").withColumn("season", season)
    kept = good.groupBy("source", "target", "type", "season").agg(F.min("row_no").alias("row_no"))
    rejects = rows.filter("category is not null").select("category", "row_no", "source", "target", "type", "season", "reason")
    return kept, rejects


def reject_report(rejects: DataFrame) -> DataFrame:
    reason = F.coalesce("reason", F.lit("")) if "reason" in rejects.columns else F.lit("")
    return rejects.groupBy("category", reason.alias("reason")).agg(F.count("*").alias("n"))
