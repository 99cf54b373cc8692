"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..operators import analytics, cleaning, conflicts, graph
from . import sql as S
from .fixtures import cte, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL if there is any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return add


def flat(column: str) -> F.Column:
    """An array of strings as one string."""
    return F.array_join(column, "|").alias(column)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, n) for n in names]


# --- names and votes ---------------------------------------------------------------


@query(f"""{cte('relations')} SELECT row_no, {S.clean_string('source')} AS name, {S.validate_entity(S.clean_string('source'))} AS reason FROM relations""")
def validate_entity(spark, sf_dir):
    rows = frame(spark, sf_dir, "relations")
    name = X.clean_string(F.col("source"))
    return rows.select("row_no", name.alias("name"), X.validate_entity(name).alias("reason"))


@query(f"""{cte('relations')} SELECT row_no, {S.sanitize_name('source')} AS name, {S.infer_label('source', 'type', 'true')} AS head_label, {S.infer_label('target', 'type', 'false')} AS tail_label FROM relations""")
def infer_label(spark, sf_dir):
    rows = frame(spark, sf_dir, "relations")
    head = X.infer_label(F.col("source"), F.col("type"), F.lit(True))
    tail = X.infer_label(F.col("target"), F.col("type"), F.lit(False))
    return rows.select("row_no", X.sanitize_name(F.col("source")).alias("name"), head.alias("head_label"), tail.alias("tail_label"))


@query(f"""{cte('relations')} SELECT row_no, {S.infer_season('season', 'source', 'target')} AS season, {S.safe_type('type')} AS rel_type FROM relations""")
def infer_season(spark, sf_dir):
    rows = frame(spark, sf_dir, "relations")
    return rows.select("row_no", X.infer_season(F.col("season"), F.col("source"), F.col("target")).alias("season"), X.safe_type(F.col("type")).alias("rel_type"))


@query(f"""{cte('votes')}, counted AS (SELECT name, label, count(*) AS n, min(pos) AS first FROM votes GROUP BY name, label)
    SELECT name, arg_max(label, n * 1000000000 - first) AS label FROM counted GROUP BY name""")
def resolve_labels(spark, sf_dir):
    return cleaning.resolve_labels(frame(spark, sf_dir, "votes"))


def _washed(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "relations")
    rel = F.when(F.col("row_no") % 11 == 0, F.array("source", "type")).otherwise(F.array("source", "type", "target"))
    return rows.select(F.col("row_no").alias("doc_pos"), F.array("source", "target").alias("entities"), F.array(rel).alias("relations"))


_WASHED = f"""{cte('relations')}, rels AS (
        SELECT row_no, {S.sanitize_name('source')} AS s, {S.sanitize_name('type')} AS p, {S.sanitize_name('target')} AS o FROM relations WHERE row_no % 11 <> 0
    ), whole AS (SELECT * FROM rels WHERE s <> '' AND o <> '' AND p <> '' AND length(s) <= 32 AND length(o) <= 32)"""


@query(f"""{_WASHED}, votes AS (
        SELECT {S.sanitize_name('source')} AS name, row_no * 10 AS pos, '' AS p, false AS head FROM relations
        UNION ALL SELECT {S.sanitize_name('target')}, row_no * 10 + 1, '', false FROM relations
        UNION ALL SELECT s, row_no * 10 + 2, p, true FROM whole UNION ALL SELECT o, row_no * 10 + 3, p, false FROM whole
    ), labelled AS (SELECT name, pos, {S.infer_label('name', 'p', 'head')} AS label FROM votes WHERE name <> '' AND length(name) <= 32),
    counted AS (SELECT name, label, count(*) AS n, min(pos) AS first FROM labelled GROUP BY name, label)
    SELECT name, arg_max(label, n * 10000000000 - first) AS label FROM counted GROUP BY name""")
def collect_graph_labels(spark, sf_dir):
    votes, _ = cleaning.collect_graph(_washed(spark, sf_dir))
    return cleaning.resolve_labels(votes)


@query(f"""{_WASHED} SELECT DISTINCT s AS source, o AS target, p AS type FROM whole""")
def collect_graph_relations(spark, sf_dir):
    return cleaning.collect_graph(_washed(spark, sf_dir))[1]


def _mentions(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "relations")
    label = F.when(F.col("row_no") % 5 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ("FoodHerb", "Concept", ""))), (F.col("row_no") % 3 + 1).cast("int")))
    both = F.array(F.struct(F.col("source").alias("name"), label.alias("label")), F.struct(F.col("target").alias("name"), F.lit("Other").alias("label")))
    return rows.select(F.col("row_no").alias("line_no"), F.concat(F.lit("ctx "), "source").alias("context"), both.alias("entities"))


_MENTIONS = f"""{cte('relations')}, mentions AS (
        SELECT row_no AS line_no, 0 AS item, source AS raw, coalesce(CASE WHEN row_no % 5 = 0 THEN NULL WHEN row_no % 3 = 0 THEN 'FoodHerb' WHEN row_no % 3 = 1 THEN 'Concept' END, 'Entity') AS label, 'ctx ' || source AS context FROM relations
        UNION ALL SELECT row_no, 1, target, 'Other', 'ctx ' || source FROM relations
    ), judged AS (SELECT *, {S.clean_string('raw')} AS name, {S.validate_entity(S.clean_string('raw'))} AS reason FROM mentions),
    counted AS (SELECT name, label, count(*) AS n, min(line_no * 2 + item) AS first FROM judged WHERE reason = 'passed' GROUP BY name, label),
    clean AS (SELECT name, arg_max(label, n * 10000000000 - first) AS label FROM counted GROUP BY name)"""


@query(f"{_MENTIONS} SELECT name, label FROM clean")
def clean_nodes(spark, sf_dir):
    return cleaning.clean_nodes(_mentions(spark, sf_dir))[0]


@query(f"{_MENTIONS} SELECT 'reject_node_' || reason AS category, line_no, raw AS name, label, substr(context, 1, 100) AS context FROM judged WHERE reason <> 'passed'")
def clean_nodes_rejects(spark, sf_dir):
    return cleaning.clean_nodes(_mentions(spark, sf_dir))[1]


_JUDGED = f"""{_MENTIONS}, cleaned AS (
        SELECT row_no, {S.clean_string('source')} AS source, {S.clean_string('target')} AS target, {S.clean_string('type')} AS type, {S.clean_string('season')} AS season FROM relations
    ), reasons AS (SELECT *, {S.validate_entity('source')} AS h, {S.validate_entity('target')} AS t FROM cleaned),
    decided AS (SELECT *, CASE WHEN type = '' THEN 'reject_relation_format_error' WHEN h <> 'passed' OR t <> 'passed' THEN 'reject_relation_bad_entity'
        WHEN source = target THEN 'reject_relation_self_loop'
        WHEN source NOT IN (SELECT name FROM clean WHERE length(name) % 4 <> 3) OR target NOT IN (SELECT name FROM clean WHERE length(name) % 4 <> 3) THEN 'reject_relation_missing_node' END AS category FROM reasons)"""


def _known(spark, sf_dir) -> DataFrame:
    return clean_nodes(spark, sf_dir).filter(F.length("name") % 4 != 3)


@query(f"""{_JUDGED} SELECT source, target, type, season, min(row_no) AS row_no FROM (SELECT source, target, type, {S.infer_season('season', 'source', 'target')} AS season, row_no FROM decided WHERE category IS NULL) GROUP BY ALL""")
def clean_relations(spark, sf_dir):
    return cleaning.clean_relations(frame(spark, sf_dir, "relations"), _known(spark, sf_dir))[0]


@query(f"""{_JUDGED} SELECT category, CASE WHEN category = 'reject_relation_bad_entity' THEN 'Head:' || h || ', Tail:' || t ELSE '' END AS reason, count(*) AS n FROM decided WHERE category IS NOT NULL GROUP BY ALL""")
def reject_report(spark, sf_dir):
    return cleaning.reject_report(cleaning.clean_relations(frame(spark, sf_dir, "relations"), _known(spark, sf_dir))[1])


# --- graph -------------------------------------------------------------------------

_ID = "sha256(label || chr(31) || name)"
_GRAPH = f"""{cte('graph_entities', 'graph_relations')}, merged AS (SELECT DISTINCT {_ID} AS node_id, label, name FROM graph_entities),
    turns AS (SELECT type, min(row_no) AS turn FROM graph_relations GROUP BY type),
    ordered AS (SELECT source, target, {S.safe_type('type')} AS rel_type, type, season, row_number() OVER (PARTITION BY source, target, {S.safe_type('type')} ORDER BY turn DESC, row_no DESC, season DESC) AS n
        FROM graph_relations JOIN turns USING (type)),
    linked AS (SELECT sha256(a.node_id || chr(31) || rel_type || chr(31) || b.node_id) AS edge_id, a.node_id AS src_id, b.node_id AS dst_id, rel_type, type, season
        FROM ordered JOIN merged a ON a.name = source JOIN merged b ON b.name = target WHERE n = 1)"""


def _merged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes = graph.merge_nodes(frame(spark, sf_dir, "graph_entities"))
    return nodes, graph.merge_edges(frame(spark, sf_dir, "graph_relations"), nodes)


@query(f"{_GRAPH} SELECT node_id, label, name FROM merged")
def merge_nodes(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@query(f"{_GRAPH} SELECT edge_id, src_id, dst_id, rel_type, type, season FROM linked")
def merge_edges(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query(f"{_GRAPH} SELECT (SELECT count(*) FROM merged) AS nodes, (SELECT count(*) FROM linked) AS edges")
def graph_counts(spark, sf_dir):
    return graph.graph_counts(*_merged(spark, sf_dir))


@query(f"{cte('nodes')} SELECT label, count(*) AS c FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label ORDER BY c DESC, label LIMIT 5")
def top_labels(spark, sf_dir):
    return graph.top_labels(frame(spark, sf_dir, "nodes"))


@query(f"{cte('edges')} SELECT rel_type, count(*) AS c FROM edges GROUP BY rel_type ORDER BY c DESC, rel_type LIMIT 5")
def top_rel_types(spark, sf_dir):
    return graph.top_rel_types(frame(spark, sf_dir, "edges"))


# --- conflicts ---------------------------------------------------------------------

_NODES, _BOTH = cte("nodes"), cte("nodes", "edges")
_FLAT = "array_to_string({}, '|')"
_SETS = "list_sort(list(DISTINCT array_to_string(list_sort(labels), '+')))"


def _sets(column: str) -> F.Column:
    return F.array_join(F.array_sort(F.transform(column, lambda s: F.array_join(s, "+"))), "|").alias(column)


@query(f"""{_NODES} SELECT name, {_FLAT.format(_SETS)} AS label_sets, {_FLAT.format('list_sort(list(node_id))')} AS ids, count(*) AS count FROM nodes
    GROUP BY name HAVING len({_SETS}) > 1""")
def duplicate_nodes(spark, sf_dir):
    return conflicts.duplicate_nodes(frame(spark, sf_dir, "nodes")).select("name", _sets("label_sets"), flat("ids"), "count")


@query(f"{_BOTH} SELECT name, rel_type, edge_id, season FROM edges JOIN nodes ON src_id = node_id WHERE src_id = dst_id")
def self_loops(spark, sf_dir):
    return conflicts.self_loops(*tables(spark, sf_dir, "nodes", "edges"))


_NAMED = "named AS (SELECT e.*, a.name AS source, b.name AS target FROM edges e JOIN nodes a ON src_id = a.node_id JOIN nodes b ON dst_id = b.node_id)"


@query(f"""{_BOTH}, {_NAMED} SELECT source, target, rel_type, count(*) AS count, {_FLAT.format('list_sort(list(edge_id))')} AS edge_ids FROM named
    GROUP BY src_id, dst_id, source, target, rel_type HAVING count(*) > 1""")
def duplicate_relations(spark, sf_dir):
    return conflicts.duplicate_relations(*tables(spark, sf_dir, "nodes", "edges"), limit=None).select("source", "target", "rel_type", "count", flat("edge_ids"))


@query(f"{_BOTH} SELECT name, {_FLAT.format('labels')} AS labels, node_id FROM nodes WHERE node_id NOT IN (SELECT src_id FROM edges UNION ALL SELECT dst_id FROM edges)")
def isolated_nodes(spark, sf_dir):
    return conflicts.isolated_nodes(*tables(spark, sf_dir, "nodes", "edges")).select("name", flat("labels"), "node_id")


_KEY = "translate(name, ' ' || chr(12288), '')"


@query(f"""{_NODES} SELECT {_KEY} AS normalized, {_FLAT.format('list_sort(list(DISTINCT name))')} AS variants, {_FLAT.format(_SETS)} AS label_sets, count(*) AS count FROM nodes
    GROUP BY {_KEY} HAVING count(*) > 1""")
def naming_conflicts(spark, sf_dir):
    return conflicts.naming_conflicts(frame(spark, sf_dir, "nodes"), None).select("normalized", flat("variants"), _sets("label_sets"), "count")


@query(f"""{_NODES} SELECT {_KEY} AS normalized, name AS variants, {_FLAT.format(_SETS)} AS label_sets, count(*) AS count FROM nodes GROUP BY {_KEY}, name HAVING count(*) > 1""")
def naming_conflicts_same_name(spark, sf_dir):
    return conflicts.naming_conflicts(frame(spark, sf_dir, "nodes"), None, same_name_only=True).select("normalized", flat("variants"), _sets("label_sets"), "count")


@query(f"""{_BOTH}, {_NAMED} SELECT source, target, rel_type, {_FLAT.format('list_sort(list(DISTINCT season))')} AS seasons FROM named WHERE season IS NOT NULL
    GROUP BY source, target, rel_type HAVING count(DISTINCT season) > 1""")
def inconsistent_seasons(spark, sf_dir):
    return conflicts.inconsistent_seasons(*tables(spark, sf_dir, "nodes", "edges"), limit=None).select("source", "target", "rel_type", flat("seasons"))


# The reports as they are printed, with their limits.


@query(f"""{_BOTH}, {_NAMED} SELECT source, target, rel_type, count(*) AS count, {_FLAT.format('list_sort(list(edge_id))')} AS edge_ids FROM named
    GROUP BY src_id, dst_id, source, target, rel_type HAVING count(*) > 1 ORDER BY count DESC, source, target, rel_type, list_sort(list(edge_id)) LIMIT 100""")
def duplicate_relations_report(spark, sf_dir):
    return conflicts.duplicate_relations(*tables(spark, sf_dir, "nodes", "edges")).select("source", "target", "rel_type", "count", flat("edge_ids"))


@query(f"""{_NODES} SELECT {_KEY} AS normalized, {_FLAT.format('list_sort(list(DISTINCT name))')} AS variants, {_FLAT.format(_SETS)} AS label_sets, count(*) AS count FROM nodes
    GROUP BY {_KEY} HAVING count(*) > 1 ORDER BY count DESC, normalized LIMIT 50""")
def naming_conflicts_report(spark, sf_dir):
    return conflicts.naming_conflicts(frame(spark, sf_dir, "nodes")).select("normalized", flat("variants"), _sets("label_sets"), "count")


@query(f"""{_BOTH}, {_NAMED} SELECT source, target, rel_type, {_FLAT.format('list_sort(list(DISTINCT season))')} AS seasons FROM named WHERE season IS NOT NULL
    GROUP BY source, target, rel_type HAVING count(DISTINCT season) > 1 ORDER BY count(DISTINCT season) DESC, source, target, rel_type LIMIT 50""")
def inconsistent_seasons_report(spark, sf_dir):
    return conflicts.inconsistent_seasons(*tables(spark, sf_dir, "nodes", "edges")).select("source", "target", "rel_type", flat("seasons"))


@query(f"""{_BOTH} SELECT name, {_FLAT.format('labels')} AS labels, node_id FROM nodes WHERE node_id NOT IN (SELECT src_id FROM edges UNION ALL SELECT dst_id FROM edges)
    AND list_contains(labels, 'Organization') ORDER BY name, node_id LIMIT 100""")
def isolated_nodes_report(spark, sf_dir):
    return conflicts.isolated_nodes(*tables(spark, sf_dir, "nodes", "edges"), label="Organization", limit=100).select("name", flat("labels"), "node_id")


_CHECKS = f"""{_BOTH}, {_NAMED}, checks AS (
    SELECT 'duplicate_nodes' AS "check", count(*) AS n FROM (SELECT name FROM nodes GROUP BY name HAVING len({_SETS}) > 1)
    UNION ALL SELECT 'self_loops', count(*) FROM edges WHERE src_id = dst_id
    UNION ALL SELECT 'duplicate_relations', count(*) FROM (SELECT 1 FROM named GROUP BY src_id, dst_id, rel_type HAVING count(*) > 1)
    UNION ALL SELECT 'isolated_nodes', count(*) FROM nodes WHERE node_id NOT IN (SELECT src_id FROM edges UNION ALL SELECT dst_id FROM edges)
    UNION ALL SELECT 'naming_conflicts', count(*) FROM (SELECT 1 FROM nodes GROUP BY {_KEY} HAVING count(*) > 1)
    UNION ALL SELECT 'inconsistent_seasons', count(*) FROM (SELECT 1 FROM named WHERE season IS NOT NULL GROUP BY source, target, rel_type HAVING count(DISTINCT season) > 1))"""


@query(f'{_CHECKS} SELECT "check", n FROM checks')
def check_conflicts(spark, sf_dir):
    return conflicts.check_conflicts(*tables(spark, sf_dir, "nodes", "edges"))


@query(f"{cte('edges')} SELECT edge_id, src_id, dst_id, rel_type, type, season FROM edges WHERE src_id <> dst_id")
def remove_self_loops(spark, sf_dir):
    return conflicts.remove_self_loops(frame(spark, sf_dir, "edges"))


_DEDUPED = "deduped AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY edge_id) AS n FROM {}) WHERE n = 1)"


@query(f"{cte('edges')}, {_DEDUPED.format('edges')} SELECT edge_id, src_id, dst_id, rel_type, type, season FROM deduped")
def merge_duplicate_relations(spark, sf_dir):
    return conflicts.merge_duplicate_relations(frame(spark, sf_dir, "edges"))


_UNKNOWN = "coalesce(season IN ('', '未知'), true)"


@query(f"""{cte('edges')} SELECT edge_id, src_id, dst_id, rel_type, type, first_value(season) OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY {_UNKNOWN}, edge_id) AS season FROM edges""")
def unify_seasons(spark, sf_dir):
    return conflicts.unify_seasons(frame(spark, sf_dir, "edges"))


@query(f"""{_NODES} SELECT node_id, first_value(name) OVER (PARTITION BY {_KEY} ORDER BY length(name), name) AS name, {_FLAT.format('labels')} AS labels FROM nodes""")
def normalize_node_names(spark, sf_dir):
    return conflicts.normalize_node_names(frame(spark, sf_dir, "nodes")).select("node_id", "name", flat("labels"))


_KEEPERS = "keepers AS (SELECT name, min(node_id) AS keeper FROM nodes GROUP BY name)"


@query(f"""{_BOTH}, {_KEEPERS}, ids AS (SELECT keeper FROM keepers) SELECT edge_id, src_id, dst_id, rel_type, type, season FROM edges
    WHERE src_id IN (SELECT keeper FROM ids) AND dst_id IN (SELECT keeper FROM ids)""")
def merge_duplicate_nodes_drop(spark, sf_dir):
    return conflicts.merge_duplicate_nodes(*tables(spark, sf_dir, "nodes", "edges"))[1]


@query(f"""{_BOTH}, {_KEEPERS}, map AS (SELECT node_id, keeper FROM nodes JOIN keepers USING (name)),
    moved AS (SELECT edge_id, a.keeper AS src_id, b.keeper AS dst_id, rel_type, type, season FROM edges JOIN map a ON src_id = a.node_id JOIN map b ON dst_id = b.node_id),
    {_DEDUPED.format('moved')} SELECT edge_id, src_id, dst_id, rel_type, type, season FROM deduped""")
def merge_duplicate_nodes_rewire(spark, sf_dir):
    return conflicts.merge_duplicate_nodes(*tables(spark, sf_dir, "nodes", "edges"), mode="rewire")[1]


@query(f"""{_BOTH}, {_KEEPERS} SELECT keeper AS node_id, name, array_to_string(list_sort(list_distinct(flatten(list(labels)))), '|') AS labels FROM nodes JOIN keepers USING (name) GROUP BY keeper, name""")
def merge_duplicate_nodes_labels(spark, sf_dir):
    return conflicts.merge_duplicate_nodes(*tables(spark, sf_dir, "nodes", "edges"), mode="rewire")[0].select("node_id", "name", flat("labels"))


@query(f"""{_BOTH} SELECT node_id, name, {_FLAT.format('labels')} AS labels FROM nodes WHERE node_id IN (SELECT src_id FROM edges UNION ALL SELECT dst_id FROM edges)
    OR list_has_any(labels, ['SolarTerm', 'Person', 'Source'])""")
def remove_isolated(spark, sf_dir):
    return conflicts.remove_isolated(*tables(spark, sf_dir, "nodes", "edges")).select("node_id", "name", flat("labels"))


@query(f"""{_CHECKS} SELECT "check" AS step, n AS planned FROM checks WHERE "check" <> 'isolated_nodes'""")
def resolve_conflicts_report(spark, sf_dir):
    return conflicts.resolve_conflicts(*tables(spark, sf_dir, "nodes", "edges"))[2]


@query(f"""{_BOTH}, loopless AS (SELECT * FROM edges WHERE src_id <> dst_id), {_DEDUPED.format('loopless')},
    renamed AS (SELECT node_id, first_value(name) OVER (PARTITION BY {_KEY} ORDER BY length(name), name) AS name FROM nodes),
    ids AS (SELECT min(node_id) AS keeper FROM renamed GROUP BY name)
    SELECT edge_id, src_id, dst_id, rel_type, type, season FROM deduped WHERE src_id IN (SELECT keeper FROM ids) AND dst_id IN (SELECT keeper FROM ids)""")
def resolve_conflicts(spark, sf_dir):
    return conflicts.resolve_conflicts(*tables(spark, sf_dir, "nodes", "edges"), dry_run=False)[1]


# --- analytics ---------------------------------------------------------------------

_DEGREE = "degree AS (SELECT node_id, count(*) AS deg FROM (SELECT src_id AS node_id FROM edges UNION ALL SELECT dst_id FROM edges WHERE dst_id <> src_id) GROUP BY node_id)"


@query(f"""{_BOTH}, {_DEGREE}, terms AS (SELECT unnest([{S.listed(C.TERMS)}]) AS term)
    SELECT term, count(n.node_id) > 0 AS present, CAST(coalesce(sum(deg), 0) AS BIGINT) AS degree, coalesce(sum(deg), 0) > 0 AS connected
    FROM terms LEFT JOIN nodes n ON n.name = term LEFT JOIN degree USING (node_id) GROUP BY term""")
def term_coverage(spark, sf_dir):
    return analytics.term_coverage(*tables(spark, sf_dir, "nodes", "edges"))


@query(f"""{_BOTH}, {_DEGREE} SELECT name, {_FLAT.format('labels')} AS labels, coalesce(deg, 0) AS deg FROM nodes LEFT JOIN degree USING (node_id) ORDER BY deg DESC, name, node_id LIMIT 10""")
def top_degree(spark, sf_dir):
    return analytics.top_degree(*tables(spark, sf_dir, "nodes", "edges")).select("name", flat("labels"), "deg")


@query(f"""{_BOTH}, {_DEGREE} SELECT name, {_FLAT.format('labels')} AS labels, coalesce(deg, 0) AS deg FROM nodes LEFT JOIN degree USING (node_id) WHERE list_contains(labels, 'FoodHerb') ORDER BY deg DESC, name, node_id LIMIT 20""")
def top_degree_of_label(spark, sf_dir):
    return analytics.top_degree(*tables(spark, sf_dir, "nodes", "edges"), k=20, label="FoodHerb").select("name", flat("labels"), "deg")


@query(f"""{_BOTH}, sides AS (
        SELECT a.name, 'out' AS direction, rel_type, b.name AS other, b.labels, edge_id FROM edges JOIN nodes a ON src_id = a.node_id JOIN nodes b ON dst_id = b.node_id
        UNION ALL SELECT b.name, 'in', rel_type, a.name, a.labels, edge_id FROM edges JOIN nodes a ON src_id = a.node_id JOIN nodes b ON dst_id = b.node_id
    ), numbered AS (SELECT *, row_number() OVER (PARTITION BY name, direction ORDER BY rel_type, other, edge_id) AS n FROM sides WHERE name IN (SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation))
    SELECT name, direction, rel_type, other, {_FLAT.format('labels')} AS labels FROM numbered WHERE n <= 20""")
def entity_neighbors(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name")).union(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name"))
    return analytics.entity_neighbors(*tables(spark, sf_dir, "nodes", "edges"), names).select("name", "direction", "rel_type", "other", flat("labels"))


def _pairs(spark, sf_dir) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = F.concat(F.lit("Customer#"), F.lpad(((F.col("c_custkey") * 7 + 6) % F.lit(customers.count())).cast("string"), 9, "0"))
    return customers.select(F.col("c_custkey").alias("pair_id"), F.col("c_name").alias("src"), other.alias("dst"))


#: Customers hang on nations only, and nations on regions, so each path is the only one of
#: its length: over the nation of both, or over both nations and their region.
_HOMES = f"""{_BOTH}, pairs AS (SELECT c_custkey AS pair_id, c_name AS src, 'Customer#' || lpad(CAST((c_custkey * 7 + 6) % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0') AS dst FROM customer),
    home AS (SELECT c_name, dst_id AS n, type, season FROM edges JOIN customer ON src_id = 'C' || CAST(c_custkey AS VARCHAR) WHERE rel_type = 'located_in'),
    region_of AS (SELECT src_id AS n, dst_id AS r, type, season FROM edges WHERE rel_type = 'part_of'),
    met AS (SELECT pair_id, src, dst, a.n AS na, b.n AS nb, p.r AS r, a.n = b.n AS near, a.type AS ta, a.season AS sa, b.type AS tb, b.season AS sb, p.type AS tp, p.season AS sp, q.type AS tq, q.season AS sq
        FROM pairs JOIN home a ON a.c_name = src JOIN home b ON b.c_name = dst JOIN region_of p ON p.n = a.n JOIN region_of q ON q.n = b.n WHERE src <> dst AND (a.n = b.n OR p.r = q.r))"""


@query(f"""{_HOMES} SELECT pair_id, CAST(CASE WHEN near THEN 2 ELSE 4 END AS INTEGER) AS hops FROM met""")
def shortest_path_lengths(spark, sf_dir):
    found = shortest_path(spark, sf_dir)
    return found.groupBy("pair_id").agg(F.max("hop").alias("hops"))


@query(f"""{_HOMES}, names AS (SELECT node_id, name FROM nodes),
    hops AS (SELECT pair_id, 1 AS hop, src AS source, ta AS relation, x.name AS target, sa AS season FROM met JOIN names x ON x.node_id = na
        UNION ALL SELECT pair_id, CASE WHEN near THEN 2 ELSE 4 END, y.name, tb, dst, sb FROM met JOIN names y ON y.node_id = nb
        UNION ALL SELECT pair_id, 2, x.name, tp, z.name, sp FROM met JOIN names x ON x.node_id = na JOIN names z ON z.node_id = r WHERE NOT near
        UNION ALL SELECT pair_id, 3, z.name, tq, y.name, sq FROM met JOIN names y ON y.node_id = nb JOIN names z ON z.node_id = r WHERE NOT near)
    SELECT pair_id, CAST(hop AS INTEGER) AS hop, source, relation, target, coalesce(season, '') AS season FROM hops""")
def shortest_path(spark, sf_dir):
    return analytics.shortest_path(*tables(spark, sf_dir, "nodes", "edges"), _pairs(spark, sf_dir))
