"""Checks of a graph for conflicts, and their fixes.

Nodes are (node_id, name, labels array), edges (edge_id, src_id, dst_id, rel_type, type,
season). Every check and fix is one or two shuffles over all groups; limits are limits of
a report only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C

KEEP_ISOLATED = ("SolarTerm", "Person", "Source")


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select("node_id", "name")
    out = edges.join(names.select(F.col("node_id").alias("src_id"), F.col("name").alias("source")), "src_id")
    return out.join(names.select(F.col("node_id").alias("dst_id"), F.col("name").alias("target")), "dst_id")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """(name, label_sets, ids, count) of names with more than one distinct label set."""
    found = nodes.groupBy("name").agg(F.collect_set(F.array_sort("labels")).alias("sets"), F.array_sort(F.collect_list("node_id")).alias("ids"), F.count("*").alias("count"))
    return found.filter(F.size("sets") > 1).select("name", F.array_sort("sets").alias("label_sets"), "ids", "count")


def self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    loops = edges.filter("src_id = dst_id")
    return loops.join(nodes, loops["src_id"] == nodes["node_id"]).select("name", "rel_type", "edge_id", "season")


def duplicate_relations(nodes: DataFrame, edges: DataFrame, limit: int | None = 100) -> DataFrame:
    groups = edges.groupBy("src_id", "dst_id", "rel_type").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("edge_id")).alias("edge_ids")).filter("count > 1")
    out = _named(groups, nodes).select("source", "target", "rel_type", "count", "edge_ids")
    return out.orderBy(F.desc("count"), "source", "target", "rel_type", "edge_ids").limit(limit) if limit else out


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()


def isolated_nodes(nodes: DataFrame, edges: DataFrame, label: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes that no edge touches; a self loop touches its node."""
    out = nodes.join(_ends(edges), "node_id", "left_anti").select("name", "labels", "node_id")
    if label:
        out = out.filter(F.array_contains("labels", label))
    return out.orderBy("name", "node_id").limit(limit) if limit else out


def normalized_name(name) -> F.Column:
    return F.translate(name, " 　", "")


def naming_conflicts(nodes: DataFrame, limit: int | None = 50, same_name_only: bool = False) -> DataFrame:
    """(normalized, variants, label_sets, count) of names that differ in spaces only.
    same_name_only groups by the name as well, and so finds repeated equal names."""
    keyed = nodes.withColumn("normalized", normalized_name("name"))
    keys = ["normalized", "name"] if same_name_only else ["normalized"]
    found = keyed.groupBy(*keys).agg(
        F.array_sort(F.collect_set("name")).alias("variants"), F.array_sort(F.collect_set(F.array_sort("labels"))).alias("label_sets"), F.count("*").alias("count")
    )
    out = found.filter("count > 1").select("normalized", "variants", "label_sets", "count")
    return out.orderBy(F.desc("count"), "normalized", "variants").limit(limit) if limit else out


def inconsistent_seasons(nodes: DataFrame, edges: DataFrame, limit: int | None = 50) -> DataFrame:
    """(source, target, rel_type, seasons) with more than one distinct season."""
    rows = _named(edges, nodes).filter("season is not null")
    found = rows.groupBy("source", "target", "rel_type").agg(F.array_sort(F.collect_set("season")).alias("seasons")).filter(F.size("seasons") > 1)
    return found.orderBy(F.desc(F.size("seasons")), "source", "target", "rel_type").limit(limit) if limit else found


def check_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): how many cases each of the six checks finds."""
    checks = {
        "duplicate_nodes": duplicate_nodes(nodes),
        "self_loops": self_loops(nodes, edges),
        "duplicate_relations": duplicate_relations(nodes, edges, None),
        "isolated_nodes": isolated_nodes(nodes, edges),
        "naming_conflicts": naming_conflicts(nodes, None),
        "inconsistent_seasons": inconsistent_seasons(nodes, edges, None),
    }
    out = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.union(row)
    return out


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src_id != dst_id")


def merge_duplicate_relations(edges: DataFrame) -> DataFrame:
    """The edge with the least id of each (src_id, dst_id, rel_type)."""
    rest = [c for c in edges.columns if c not in ("src_id", "dst_id", "rel_type")]
    kept = edges.groupBy("src_id", "dst_id", "rel_type").agg(F.min_by(F.struct(*rest), "edge_id").alias("e"))
    return kept.select("e.*", "src_id", "dst_id", "rel_type").select(*edges.columns)


def unify_seasons(edges: DataFrame) -> DataFrame:
    """Gives all edges of a (src_id, dst_id, rel_type) the season of the least edge_id
    among those with a known one, or else of the least edge_id."""
    unknown = F.coalesce(F.col("season").isin("", C.UNKNOWN_SEASON), F.lit(True))
    keys = ["src_id", "dst_id", "rel_type"]
    best = edges.groupBy(*keys).agg(F.min_by(F.struct("season"), F.struct(unknown, "edge_id")).alias("b")).select(*keys, F.col("b.season").alias("_season"))
    return edges.join(best, keys).withColumn("season", F.col("_season")).select(*edges.columns)


def normalize_node_names(nodes: DataFrame) -> DataFrame:
    """All variants that differ in spaces only get the shortest one's name, of equals
    the first by code points."""
    keyed = nodes.withColumn("_key", normalized_name("name"))
    best = keyed.groupBy("_key").agg(F.min(F.struct(F.length("name"), "name")).alias("_best"))
    return keyed.join(best, "_key").withColumn("name", F.col("_best.name")).select(*nodes.columns)


def merge_duplicate_nodes(nodes: DataFrame, edges: DataFrame, mode: str = "drop") -> tuple[DataFrame, DataFrame]:
    """One node for each name, that with the least id. mode drop deletes the others with
    their edges; rewire gives their edges and labels to the node that stays."""
    keepers = nodes.groupBy("name").agg(F.min("node_id").alias("_keeper"))
    mapped = nodes.join(keepers, "name")
    if mode == "drop":
        kept = mapped.filter("node_id = _keeper").select(*nodes.columns)
        ids = kept.select("node_id")
        edges = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi")
        return kept, edges.join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    if mode != "rewire":
        raise ValueError(f"mode is drop or rewire, not {mode}")
    labels = mapped.select("_keeper", "name", F.explode_outer("labels").alias("l")).groupBy("_keeper", "name").agg(F.array_sort(F.collect_set("l")).alias("labels"))
    kept = labels.select(F.col("_keeper").alias("node_id"), "name", "labels")
    moved = mapped.select("node_id", "_keeper")
    out = edges.join(moved.select(F.col("node_id").alias("src_id"), F.col("_keeper").alias("_s")), "src_id")
    out = out.join(moved.select(F.col("node_id").alias("dst_id"), F.col("_keeper").alias("_d")), "dst_id")
    out = out.withColumns({"src_id": F.col("_s"), "dst_id": F.col("_d")}).select(*edges.columns)
    return kept, merge_duplicate_relations(out)


def remove_isolated(nodes: DataFrame, edges: DataFrame, keep_labels=KEEP_ISOLATED, limit: int | None = None) -> DataFrame:
    """Nodes without those that no edge touches, unless they have one of keep_labels. A
    limit removes the first ones by id only."""
    kept = F.array(*[F.lit(x) for x in keep_labels]).cast("array<string>")
    gone = isolated_nodes(nodes, edges).filter(~F.arrays_overlap("labels", kept)).select("node_id")
    if limit is not None:
        gone = gone.orderBy("node_id").limit(limit)
    return nodes.join(gone, "node_id", "left_anti").select(*nodes.columns)


def resolve_conflicts(nodes: DataFrame, edges: DataFrame, dry_run: bool = True, mode: str = "drop") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): self loops, repeated relations, seasons, names and repeated
    nodes are fixed in this order. The report (step, planned) counts what each check finds
    at the start; a dry run changes nothing else."""
    report = check_conflicts(nodes, edges).filter("check != 'isolated_nodes'").select(F.col("check").alias("step"), F.col("n").alias("planned"))
    if dry_run:
        return nodes, edges, report
    edges = unify_seasons(merge_duplicate_relations(remove_self_loops(edges)))
    nodes, edges = merge_duplicate_nodes(normalize_node_names(nodes), edges, mode)
    return nodes, edges, report

