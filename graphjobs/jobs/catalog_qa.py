"""Queries of evidence and question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..operators import analytics, cleaning, mentions, qa
from . import catalog as K
from . import sql as S
from .catalog import flat, query
from .fixtures import cte, frame

# --- the graph of the cleaned event relations --------------------------------------


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes = K.clean_nodes(spark, sf_dir).select(F.col("name").alias("node_id"), "name", F.array("label").alias("labels"))
    rels = cleaning.clean_relations(frame(spark, sf_dir, "relations"), nodes)[0]
    edge_id = F.concat_ws("/", "source", "type", "target", "season")
    return nodes, rels.select(edge_id.alias("edge_id"), F.col("source").alias("src_id"), F.col("target").alias("dst_id"), F.col("type").alias("rel_type"), "type", "season")


_KG = f"""{K._MENTIONS}, cleaned AS (
        SELECT row_no, {S.clean_string('source')} AS source, {S.clean_string('target')} AS target, {S.clean_string('type')} AS type, {S.clean_string('season')} AS season FROM relations
    ), edges AS (SELECT DISTINCT source, target, type AS relation, {S.infer_season('season', 'source', 'target')} AS season FROM cleaned
        WHERE type <> '' AND source <> target AND source IN (SELECT name FROM clean) AND target IN (SELECT name FROM clean)
            AND {S.validate_entity('source')} = 'passed' AND {S.validate_entity('target')} = 'passed'),
    sides AS (SELECT *, source AS n, target AS m FROM edges UNION ALL SELECT *, target, source FROM edges)"""


def _requests(spark, sf_dir) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    focus = F.element_at(F.array(*map(F.lit, ("立春", "养生", "羊肉", "导引", "无人", "秋分时节"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    season = F.when(F.col("c_custkey") % 4 == 0, "立春").when(F.col("c_custkey") % 4 == 1, "冬至")
    words = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("宜"), F.lit("茶"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("导"), F.lit("肉"), F.lit("预防"))).otherwise(F.array().cast("array<string>"))
    return names.select(F.col("c_custkey").alias("request_id"), focus.alias("focus"), season.alias("season"), words.alias("keywords"))


_REQUESTS = """requests AS (SELECT c_custkey AS request_id, (['立春', '养生', '羊肉', '导引', '无人', '秋分时节'])[CAST(c_custkey % 6 + 1 AS INT)] AS focus,
        CASE c_custkey % 4 WHEN 0 THEN '立春' WHEN 1 THEN '冬至' END AS asked, CASE c_custkey % 3 WHEN 0 THEN ['宜', '茶'] WHEN 1 THEN ['导', '肉', '预防'] ELSE [] END AS words FROM customer)"""
_FITS = """(asked IS NULL OR e.season = asked OR contains(m, asked) OR contains(n, asked))
        AND (len(words) = 0 OR len(list_filter(words, lambda w: contains(relation, w) OR contains(m, w))) > 0)"""
_RANKED = "row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN asked IS NOT NULL AND season = asked THEN 0 ELSE 1 END, relation, target, source, season) AS rank"


@query(
    f"""{_KG}, {_REQUESTS}, found AS (SELECT DISTINCT request_id, asked, source, relation, target, e.season FROM requests JOIN sides e ON n = focus WHERE {_FITS}),
    ranked AS (SELECT *, {_RANKED} FROM found) SELECT request_id, source, relation, target, season, rank FROM ranked WHERE rank <= 30"""
)
def neighbor_query(spark, sf_dir):
    return analytics.neighbor_query(*_graph(spark, sf_dir), _requests(spark, sf_dir))


@query(
    f"""{_KG}, {_REQUESTS}, found AS (SELECT request_id, asked, source, relation, target, e.season FROM requests, (SELECT *, source AS n, target AS m FROM edges) e WHERE {_FITS}),
    ranked AS (SELECT *, {_RANKED} FROM found) SELECT request_id, source, relation, target, season, rank FROM ranked WHERE rank <= 30"""
)
def general_query(spark, sf_dir):
    return analytics.general_query(*_graph(spark, sf_dir), _requests(spark, sf_dir).drop("focus"))


# --- questions ---------------------------------------------------------------------

_CORE = "regexp_replace(coalesce(question, ''), '[^0-9A-Za-z一-鿿]+', '', 'g')"


@query(
    f"""{cte('questions')} SELECT question_id, length({_CORE}) <= 1 OR (len(list_distinct(string_split({_CORE}, ''))) = 1 AND length({_CORE}) <= 5)
    OR NOT regexp_matches({_CORE}, '[A-Za-z一-鿿]') AS nonsense FROM questions"""
)
def is_nonsense(spark, sf_dir):
    return frame(spark, sf_dir, "questions").select("question_id", X.is_nonsense(F.col("question")).alias("nonsense"))


def _lexicon(spark, sf_dir) -> DataFrame:
    return mentions.load_lexicon(frame(spark, sf_dir, "entity_rows"))


_FIXED = [(t, "SolarTerm") for t in C.TERMS] + [(w, g) for g, words in C.QUESTION_GROUPS for w in words]
_LINKED = f"""{cte('questions', 'entity_rows')},
    lexicon AS (SELECT {S.strip('name')} AS name, coalesce(nullif(arg_min({S.strip('label')}, pos), ''), 'Other') AS label, min(pos) AS pos FROM entity_rows WHERE {S.strip('name')} <> '' GROUP BY 1),
    asked AS (SELECT question_id, {S.strip('question')} AS question FROM questions),
    fixed AS (SELECT unnest(range(1, {len(_FIXED)} + 1)) AS i, unnest([{S.listed(w for w, _ in _FIXED)}]) AS name, unnest([{S.listed(g for _, g in _FIXED)}]) AS label),
    hits AS (SELECT question_id, name, label, row_number() OVER (PARTITION BY question_id ORDER BY length(name) DESC, pos) AS place FROM asked JOIN lexicon ON contains(question, name)),
    every AS (SELECT * FROM hits WHERE place <= 12 UNION ALL SELECT question_id, name, label, 100 + i FROM asked JOIN fixed ON contains(question, name)),
    once AS (SELECT question_id, name, arg_min(label, place) AS label, min(place) AS place FROM every GROUP BY question_id, name),
    linked AS (SELECT a.question_id, a.question, coalesce(list(name ORDER BY place) FILTER (WHERE name IS NOT NULL), []) AS matched, coalesce(list(label ORDER BY place) FILTER (WHERE name IS NOT NULL), []) AS labels
        FROM asked a LEFT JOIN once USING (question_id) GROUP BY a.question_id, a.question)"""


@query(f"{_LINKED} SELECT question_id, array_to_string(matched, '|') AS matched, array_to_string(labels, '|') AS labels FROM linked")
def link_question(spark, sf_dir):
    linked = qa.link_question(frame(spark, sf_dir, "questions"), _lexicon(spark, sf_dir))
    label = lambda n: F.get(F.map_keys(F.map_filter("entities", lambda k, v: F.array_contains(v, n))), F.lit(0))
    return linked.select("question_id", flat("matched"), F.array_join(F.transform("matched", label), "|").alias("labels"))


def _intent_sql() -> str:
    has = lambda *labels: "(" + " OR ".join(f"list_contains(labels, '{x}')" for x in labels) + ")"
    asks = lambda words: S.any_of("question", words)

    def topics(n: int) -> str:
        rules = (
            (("FoodHerb", "饮食"), C.ASKS_FOOD, "饮食养生"), (("SleepDisorder", "作息"), C.ASKS_REST[n], "起居作息"), (("Emotion", "情志"), C.ASKS_EMOTION, "情志调理"),
            (("Exercise", "运动"), C.ASKS_EXERCISE, "运动调理"), (("DiseaseSymptom", "疾病"), C.ASKS_DISEASE[n], "疾病调理"),
        )
        return " ".join(f"WHEN {has(*labels)} OR {asks(words)} THEN '{name}'" for labels, words, name in rules)

    return f"""CASE WHEN {asks(C.RELATION_ASKED)} AND len(matched) >= 2 THEN '关系路径'
        WHEN {has('SolarTerm', '节气')} THEN CASE {topics(0)} ELSE '节气养生' END
        ELSE CASE {topics(1)} WHEN len(matched) >= 2 THEN '关系路径' WHEN {asks(C.ASKS_HEALTH)} THEN '节气养生' ELSE '通用查询' END END"""


_PLANNED = f"""{_LINKED}, intents AS (SELECT *, {_intent_sql()} AS intent,
        coalesce(matched[list_position(labels, 'SolarTerm')], matched[list_position(labels, '节气')]) AS season FROM linked),
    planned AS (SELECT *, CASE WHEN intent = '关系路径' AND len(matched) >= 2 THEN 'path' WHEN len(matched) > 0 THEN 'neighbour' ELSE 'general' END AS kind FROM intents)"""


@query(f"""{_PLANNED} SELECT question_id, intent, season, kind, CASE WHEN kind = 'neighbour' THEN coalesce(season, matched[1]) END AS focus,
    CASE kind WHEN 'path' THEN '查询【' || matched[1] || '】与【' || matched[2] || '】之间的关联路径'
        WHEN 'neighbour' THEN '查询【' || coalesce(season, matched[1]) || '】的关联知识'
        ELSE CASE WHEN season IS NULL THEN '查询常见养生知识' ELSE '查询与【' || season || '】相关的养生知识' END END AS description FROM planned""")
def plan_query(spark, sf_dir):
    planned = qa.plan_query(qa.link_question(frame(spark, sf_dir, "questions"), _lexicon(spark, sf_dir)))
    return planned.select("question_id", "intent", "season", "kind", "focus", "description")


def _evidence(spark, sf_dir) -> DataFrame:
    rels = frame(spark, sf_dir, "relations")
    return rels.select((F.col("row_no") % 50).alias("question_id"), "source", F.col("type").alias("relation"), "target", "season", F.col("row_no").alias("rank"))


@query(
    f"""{cte('relations')}, e AS (SELECT row_no % 50 AS question_id, {S.strip('type')} AS rel, {S.strip('target')} AS tgt, row_no AS rank FROM relations),
    b AS (SELECT *, CASE WHEN {S.any_of('rel', C.GOOD_RELATIONS)} THEN 'positives' WHEN {S.any_of('rel', C.BAD_RELATIONS)} THEN 'negatives' WHEN {S.any_of('rel', C.EFFECT_RELATIONS)} THEN 'effects'
        WHEN {S.any_of('rel', C.METHOD_HINTS)} THEN 'methods' WHEN {S.any_of('tgt', C.FOOD_HINTS)} THEN 'positives' WHEN {S.any_of('tgt', C.METHOD_HINTS)} THEN 'methods'
        WHEN {S.any_of('rel', C.CAUSE_RELATIONS)} THEN 'effects' ELSE 'others' END AS bucket FROM e),
    v AS (SELECT question_id, bucket, CASE WHEN tgt = '' AND (bucket = 'others' OR bucket = 'methods') THEN rel ELSE tgt END AS value, rank FROM b)
    SELECT question_id, bucket, value, min(rank) AS rank FROM v WHERE value <> '' GROUP BY ALL"""
)
def bucket_evidence(spark, sf_dir):
    return qa.bucket_evidence(_evidence(spark, sf_dir))


def _template_sql(template: str) -> str:
    """DuckDB: the template with a question's label and prefix put in."""
    return "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{S}", "' || label || '").replace("{P}", "' || prefix || '") + "'"


def _form_sql(intent: str) -> str:
    """DuckDB: the answer to a question of an intent from its lists of values."""
    (with_season, without), parts, sample, sorry = qa.ANSWERS[intent]
    part = lambda bucket, before, cap, after: f"CASE WHEN len({bucket}) > 0 THEN {_template_sql(before)} || array_to_string({bucket}[1:{cap}], '、') || {_template_sql(after)} END"
    body = f"array_to_string(list_filter([{', '.join(part(*p) for p in parts)}], lambda x: x IS NOT NULL), chr(10))"
    rest = f"coalesce({part(*sample)}, {_template_sql(sorry)})" if sample else _template_sql(sorry)
    return f"CASE WHEN {body} <> '' THEN CASE WHEN label <> '' THEN {_template_sql(with_season)} ELSE {_template_sql(without)} END || chr(10) || {body} ELSE {rest} END"


def answers_sql(plans: str, evidence: str) -> str:
    """DuckDB clauses that end in answers (question_id, evidence_count, answer_raw) of plans
    (question_id, intent, matched, season) and evidence (question_id, source, relation,
    target, season, rank)."""
    lists = ", ".join(f"coalesce(list(value ORDER BY rank) FILTER (WHERE bucket = '{b}'), []) AS {b}" for b in qa.BUCKETS)
    forms = " ".join(f"WHEN intent = '{i}' THEN {_form_sql(i)}" for i in qa.ANSWERS)
    return f"""told AS (SELECT question_id, {S.strip('relation')} AS rel, {S.strip('target')} AS tgt, rank FROM {evidence}),
    put AS (SELECT *, CASE WHEN {S.any_of('rel', C.GOOD_RELATIONS)} THEN 'positives' WHEN {S.any_of('rel', C.BAD_RELATIONS)} THEN 'negatives' WHEN {S.any_of('rel', C.EFFECT_RELATIONS)} THEN 'effects'
        WHEN {S.any_of('rel', C.METHOD_HINTS)} THEN 'methods' WHEN {S.any_of('tgt', C.FOOD_HINTS)} THEN 'positives' WHEN {S.any_of('tgt', C.METHOD_HINTS)} THEN 'methods'
        WHEN {S.any_of('rel', C.CAUSE_RELATIONS)} THEN 'effects' ELSE 'others' END AS bucket,
        {S.any_of('rel', C.METHOD_HINTS)} AND NOT {S.any_of('rel', (*C.GOOD_RELATIONS, *C.BAD_RELATIONS, *C.EFFECT_RELATIONS))} AS by_rel FROM told),
    worth AS (SELECT question_id, bucket, CASE WHEN tgt = '' AND (bucket = 'others' OR by_rel) THEN rel ELSE tgt END AS value, rank FROM put),
    valued AS (SELECT question_id, bucket, value, min(rank) AS rank FROM worth WHERE value <> '' GROUP BY ALL),
    listed AS (SELECT question_id, {lists} FROM valued GROUP BY question_id),
    kept AS (SELECT question_id, count(*) AS n, list({{'source': source, 'relation': relation, 'target': target, 'season': season}} ORDER BY rank) AS records FROM {evidence} GROUP BY question_id),
    met AS (SELECT p.question_id, p.intent, p.matched, coalesce(n, 0) AS n, coalesce(records, []) AS records, {', '.join(f'coalesce({b}, []) AS {b}' for b in qa.BUCKETS)},
            coalesce(nullif(p.season, ''), records[1].season, '') AS label
        FROM {plans} p LEFT JOIN kept USING (question_id) LEFT JOIN listed USING (question_id)),
    labelled AS (SELECT *, CASE WHEN label <> '' THEN label || '时节' ELSE '该时节' END AS prefix,
            list_transform(records[1:8], lambda r: '- ' || r.source || ' ' || r.relation || ' ' || r.target) AS lines FROM met),
    answers AS (SELECT question_id, CAST(n AS INTEGER) AS evidence_count, CASE WHEN n = 0 THEN '{qa.APOLOGY}' {forms}
        WHEN intent = '{qa.PATH}' AND len(matched) >= 2 THEN matched[1] || ' 与 ' || matched[2] || ' 的关联路径：' || chr(10) || array_to_string(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i:
            i || '. ' || records[i].source || ' --' || records[i].relation || '--> ' || records[i].target || CASE WHEN records[i].season <> '' THEN '（节气：' || records[i].season || '）' ELSE '' END), chr(10))
        ELSE '关联知识要点：' || chr(10) || array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), chr(10))
            || CASE WHEN n > 8 THEN chr(10) || '… 还有 ' || (n - 8) || ' 条关联可继续查看。' ELSE '' END END AS answer_raw FROM labelled)"""


#: Every fortieth relation begins a new question; intents and seasons take turns, and every
#: eleventh question has no evidence.
_FORMS = (*qa.ANSWERS, qa.PATH, "通用查询")
_FORMED = f"""{cte('relations')}, e AS (SELECT CAST(floor(row_no / 40) AS BIGINT) AS question_id, source, type AS relation, target, season, row_no AS rank FROM relations),
    plans AS (SELECT question_id, ([{S.listed(_FORMS)}])[CAST(question_id % {len(_FORMS)} + 1 AS INT)] AS intent, ['甲', '乙'] AS matched, (['冬至', '', NULL])[CAST(question_id % 3 + 1 AS INT)] AS season FROM (SELECT DISTINCT question_id FROM e)),
    known AS (SELECT * FROM e WHERE question_id % 11 <> 5), {answers_sql('plans', 'known')}"""


@query(f"{_FORMED} SELECT question_id, evidence_count, answer_raw FROM answers")
def format_answer(spark, sf_dir):
    """All forms of answers."""
    rows = frame(spark, sf_dir, "relations")
    evidence = rows.select(F.floor(F.col("row_no") / 40).alias("question_id"), "source", F.col("type").alias("relation"), "target", "season", F.col("row_no").alias("rank"))
    turn = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("question_id") % len(values)).cast("int"))
    plans = evidence.select("question_id").distinct().select("question_id", turn(_FORMS).alias("intent"), F.array(F.lit("甲"), F.lit("乙")).alias("matched"), turn(("冬至", "", None)).alias("season"))
    return qa.format_answer(plans, evidence.filter("question_id % 11 <> 5"))


_ANSWERED = f"""{_KG}, {_PLANNED.removeprefix('WITH ')},
    judged_q AS (SELECT *, length({_CORE}) <= 1 OR (len(list_distinct(string_split({_CORE}, ''))) = 1 AND length({_CORE}) <= 5) OR NOT regexp_matches({_CORE}, '[A-Za-z一-鿿]') AS bad FROM planned),
    good AS (SELECT *, NOT bad AND len(matched) > 0 AS good FROM judged_q),
    wishes AS (SELECT question_id AS request_id, season AS asked, coalesce(season, matched[1]) AS focus,
        CASE {' '.join(f"WHEN intent = '{i}' THEN [{S.listed(w)}]" for i, w in C.INTENT_WORDS.items())} ELSE [{S.listed(C.OTHER_INTENT_WORDS)}] END AS words FROM good WHERE good AND kind = 'neighbour'),
    found_q AS (SELECT DISTINCT request_id, asked, source, relation, target, e.season FROM wishes JOIN sides e ON n = focus WHERE {_FITS}),
    ranked_q AS (SELECT *, {_RANKED} FROM found_q),
    seen AS (SELECT request_id AS question_id, source, relation, target, season, rank FROM ranked_q WHERE rank <= 30),
    near_q AS (SELECT * FROM good WHERE good AND kind = 'neighbour'), {answers_sql('near_q', 'seen')}"""


@query(
    f"""{_ANSWERED} SELECT question_id, question, CASE WHEN question = '' THEN 'error' ELSE 'ok' END AS status, CASE WHEN good THEN intent WHEN question <> '' THEN '{qa.INVALID}' END AS intent,
    CASE WHEN good THEN array_to_string(matched, '|') ELSE '' END AS matched, CASE WHEN good THEN season END AS season,
    CASE WHEN good THEN '查询【' || coalesce(season, matched[1]) || '】的关联知识' WHEN question = '' THEN '问题不能为空' WHEN bad THEN '无效提问，未执行查询' ELSE '未匹配到有效实体，未执行查询' END AS description,
    coalesce(evidence_count, 0) AS evidence_count, CASE WHEN good THEN answer_raw WHEN question <> '' THEN '{qa.APOLOGY}' END AS answer_raw
    FROM good LEFT JOIN answers USING (question_id) WHERE NOT good OR kind = 'neighbour'"""
)
def answer_questions_near(spark, sf_dir):
    """The answers that come from an entity's neighbours, and all refusals: all but paths, of
    which several may be equally short."""
    return answer_questions(spark, sf_dir).filter(F.coalesce(F.col("intent") != qa.PATH, F.lit(True)))


@query()
def answer_questions(spark, sf_dir):
    out = qa.answer_questions(frame(spark, sf_dir, "questions"), _lexicon(spark, sf_dir), *_graph(spark, sf_dir))
    return out.drop("entities").withColumn("matched", F.array_join("matched", "|"))
