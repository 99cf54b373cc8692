"""Nodes and edges from entities and relations, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import broadcast_if_small, written


def merge_nodes(entities: DataFrame) -> DataFrame:
    """(node_id, label, name): one node for each distinct (label, name). The id is the
    SHA-256 of both, so it is the same in every run and needs no global count."""
    node_id = F.sha2(F.concat_ws("\x1f", "label", "name"), 256)
    return entities.select("label", "name").distinct().select(node_id.alias("node_id"), "label", "name")


def merge_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, src_id, dst_id, rel_type, type, season) from relations (source, target,
    type, season, row_no).

    Ends match by name only, so a name with several labels fans out; relations with an
    unknown end fall away. Relations of an edge (ends and safe type) are applied in the
    order of their raw types' first rows and then of rows; the last one's type and
    season stay.
    """
    # written once, as the turns need all of them before the first edge is known
    relations = written(relations.select("source", "target", "type", "season", "row_no"), "relations", "zstd")
    turns = written(relations.groupBy("type").agg(F.min("row_no").alias("turn")), "turns")
    rows = relations.join(broadcast_if_small(turns, 10_000), "type")
    # what is written last wins, so one row for each edge name before the ends fan out
    last = F.max(F.struct("turn", "row_no", "season", "type"))
    rows = rows.groupBy("source", "target", X.safe_type(F.col("type")).alias("rel_type")).agg(last.alias("last")).select("source", "target", "last.type", "last.season")
    names = nodes.select("node_id", "name")
    ends = rows.join(names.select(F.col("node_id").alias("src_id"), F.col("name").alias("source")), "source")
    ends = ends.join(names.select(F.col("node_id").alias("dst_id"), F.col("name").alias("target")), "target")
    ends = ends.withColumn("rel_type", X.safe_type(F.col("type")))
    edge_id = F.sha2(F.concat_ws("\x1f", "src_id", "rel_type", "dst_id"), 256)
    return ends.select(edge_id.alias("edge_id"), "src_id", "dst_id", "rel_type", "type", "season")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    return n.join(edges.agg(F.count("*").alias("edges")))


def top_labels(nodes: DataFrame, k: int = 5) -> DataFrame:
    label = F.explode("labels") if "labels" in nodes.columns else F.col("label")
    return nodes.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "label").limit(k)


def top_rel_types(edges: DataFrame, k: int = 5) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "rel_type").limit(k)


def with_label_arrays(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, name, labels) as the checks take them."""
    return nodes.select("node_id", "name", F.array("label").alias("labels")) if "label" in nodes.columns else nodes
