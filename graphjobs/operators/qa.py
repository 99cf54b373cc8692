"""Questions about the graph, answered in batch by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..sources.scratch import written
from . import analytics
from .mentions import with_names

MAX_MATCHED, MAX_PATH_ROWS = 12, 40
PATH, INVALID = "关系路径", "无效提问"
APOLOGY = "抱歉，请正确说明您的问题。"

#: Answers by intent, fixed texts: the lead with a season and without one, the parts as
#: (bucket, text before, how many values, text after) and what is said without any part.
#: S is the season's name and P the season as a time.
ANSWERS = {
    "节气养生": (
        ("{S}养生要点：", "养生要点："),
        (
            ("positives", "{P}适宜：", 15, "。\n食材注意点：注重清淡、应季，{P}可优先考虑上述食材搭配。"),
            ("negatives", "{P}不宜：", 15, "。"),
            ("methods", "建议注重：", 10, "，以修养身心。"),
            ("effects", "需注意：可能与", 10, "相关，出现不适应及时就医或调理。"),
        ),
        ("others", "{P}相关建议：", 8, "。"),
        "抱歉，未能找到明确的{P}养生建议。",
    ),
    "饮食养生": (
        ("关于{S}的饮食建议：", "饮食建议："),
        (("positives", "宜食：", 20, "。"), ("negatives", "忌食：", 20, "。"), ("methods", "搭配建议：", 8, "。")),
        ("others", "建议：", 10, "。"),
        "抱歉，未找到明确的饮食建议。",
    ),
    "起居作息": (
        ("{P}作息调养提示：", "作息调养提示："),
        (
            ("methods", "作息调整建议：", 10, "。"),
            ("effects", "需要关注的风险/症状：", 8, "，出现不适建议及时休息或就医。"),
            ("positives", "可辅助的食疗/用物：", 10, "。"),
            ("negatives", "不宜：", 8, "。"),
        ),
        None,
        "抱歉，未找到明确的作息调养建议。",
    ),
    "情志调理": (
        ("{P}情志调理建议：", "情志调理建议："),
        (("methods", "舒缓情绪的方法：", 10, "。"), ("effects", "需留意的情绪关联/风险：", 8, "。"), ("positives", "可辅助安神的食材/方式：", 10, "。")),
        None,
        "抱歉，未找到明确的情志调理建议。",
    ),
    "运动调理": (
        ("{P}运动调理要点：", "运动调理要点："),
        (
            ("methods", "推荐的运动/功法：", 10, "。"),
            ("effects", "运动时需留意：", 8, "，循序渐进避免过量。"),
            ("positives", "可配合的食疗/补充：", 10, "。"),
            ("negatives", "不建议的搭配或动作：", 8, "。"),
        ),
        None,
        "抱歉，未找到明确的运动调理建议。",
    ),
    "疾病调理": (
        ("{S}疾病预防与调理建议：", "疾病预防与调理建议："),
        (
            ("effects", "在{S}，可能相关的症状/风险有：", 10, "。"),
            ("methods", "建议采取的调理方法包括：", 8, "。"),
            ("positives", "可能的病症原因：", 12, "。"),
        ),
        None,
        "抱歉，未找到明确的疾病调理建议。",
    ),
}
BUCKETS = ("positives", "negatives", "effects", "methods", "others")


def _pairs(rows) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("label")) for n, x in rows])


def link_question(questions: DataFrame, lexicon: DataFrame, cap: int = MAX_MATCHED) -> DataFrame:
    """Adds matched (array of names) and entities (map of label to names) to (question_id,
    question): the first `cap` names of the lexicon (name, label, pos), longest first,
    then the terms in calendar order and the words of the fixed groups, each once."""
    names = lexicon.select("name", "label", F.col("pos").cast("long").alias("pos"))
    rows = questions.withColumn("context", X.strip(F.coalesce("question", F.lit(""))))
    rows = with_names(rows, names)
    by_length = F.array_sort(F.transform("_all", lambda p: F.struct(p["short"].alias("short"), p["pos"].alias("pos"), p["name"].alias("name"), p["label"].alias("label"))))
    listed = F.transform(F.slice(by_length, 1, cap), lambda p: F.struct(p["name"].alias("name"), p["label"].alias("label")))
    fixed = [(t, "SolarTerm") for t in C.TERMS] + [(w, g) for g, words in C.QUESTION_GROUPS for w in words]
    more = F.filter(_pairs(fixed), lambda p: F.contains(F.col("context"), p["name"]))
    rows = rows.withColumn("_hits", F.concat(listed, more))
    rows = rows.withColumn("_names", F.transform("_hits", lambda p: p["name"]))
    rows = rows.withColumn("_hits", F.filter("_hits", lambda p, i: F.array_position(F.col("_names"), p["name"]) == i + 1))
    labels = F.array_distinct(F.transform("_hits", lambda p: p["label"]))
    of_label = lambda x: F.transform(F.filter("_hits", lambda p: p["label"] == x), lambda p: p["name"])
    entities = F.map_from_entries(F.transform(labels, lambda x: F.struct(x, of_label(x))))
    return rows.select(*questions.columns, F.transform("_hits", lambda p: p["name"]).alias("matched"), entities.alias("entities"))


def _has(entities: Column, *labels: str) -> Column:
    out = F.lit(False)
    for x in labels:
        out = out | F.map_contains_key(entities, x)
    return out


def classify_intent(question: Column, entities: Column, n_matched: Column) -> Column:
    """The first rule that fits: relations between two names; then food, rest, emotion,
    exercise and illness by labels or words, with other words where the question has a
    season."""
    season = _has(entities, "SolarTerm", "节气")
    asks = lambda words: X.contains_any(question, words)

    def topics(seasonal: bool) -> Column:
        n = 0 if seasonal else 1
        return (
            F.when(_has(entities, "FoodHerb", "饮食") | asks(C.ASKS_FOOD), "饮食养生")
            .when(_has(entities, "SleepDisorder", "作息") | asks(C.ASKS_REST[n]), "起居作息")
            .when(_has(entities, "Emotion", "情志") | asks(C.ASKS_EMOTION), "情志调理")
            .when(_has(entities, "Exercise", "运动") | asks(C.ASKS_EXERCISE), "运动调理")
            .when(_has(entities, "DiseaseSymptom", "疾病") | asks(C.ASKS_DISEASE[n]), "疾病调理")
        )

    without = topics(False).when(n_matched >= 2, PATH).when(asks(C.ASKS_HEALTH), "节气养生").otherwise("通用查询")
    return F.when(asks(C.RELATION_ASKED) & (n_matched >= 2), PATH).when(season, topics(True).otherwise("节气养生")).otherwise(without)


def intent_keywords(intent: Column) -> Column:
    out = F
    for name, words in C.INTENT_WORDS.items():
        out = out.when(intent == name, F.array(*map(F.lit, words)))
    return out.otherwise(F.array(*map(F.lit, C.OTHER_INTENT_WORDS)))


def pick_season(entities: Column) -> Column:
    return F.coalesce(F.get(F.try_element_at(entities, F.lit("SolarTerm")), F.lit(0)), F.get(F.try_element_at(entities, F.lit("节气")), F.lit(0)))


def plan_query(linked: DataFrame) -> DataFrame:
    """Adds intent, season, keywords, kind (path, neighbour, general), focus and
    description to linked questions."""
    size = F.size("matched")
    rows = linked.withColumn("intent", classify_intent(X.strip(F.coalesce("question", F.lit(""))), F.col("entities"), size))
    rows = rows.withColumn("season", pick_season(F.col("entities"))).withColumn("keywords", intent_keywords(F.col("intent")))
    first, second = F.get("matched", F.lit(0)), F.get("matched", F.lit(1))
    path = (F.col("intent") == PATH) & (size >= 2)
    rows = rows.withColumn("kind", F.when(path, "path").when(size > 0, "neighbour").otherwise("general"))
    rows = rows.withColumn("focus", F.when(F.col("kind") == "neighbour", F.coalesce("season", first)))
    aside = F.when(F.col("season").isNotNull() & ~F.contains("focus", "season"), F.concat(F.lit(" (优先节气 "), "season", F.lit(")"))).otherwise("")
    said = (
        F.when(F.col("kind") == "path", F.concat(F.lit("查询【"), first, F.lit("】与【"), second, F.lit("】之间的关联路径")))
        .when(F.col("kind") == "neighbour", F.concat(F.lit("查询【"), "focus", F.lit("】的关联知识"), aside))
        .when(F.col("season").isNotNull(), F.concat(F.lit("查询与【"), "season", F.lit("】相关的养生知识")))
        .otherwise("查询常见养生知识")
    )
    return rows.withColumn("description", said)


def bucket_evidence(evidence: DataFrame) -> DataFrame:
    """(question_id, bucket, value, rank): each record's value under the first rule that
    fits, relations before targets; values once for a question, by first rank. As
    不宜 holds 宜, it counts among what is good, as the rules' order has it."""
    rel, tgt = X.strip(F.coalesce("relation", F.lit(""))), X.strip(F.coalesce("target", F.lit("")))
    rows = evidence.select("question_id", "rank", rel.alias("rel"), tgt.alias("tgt"))
    held = lambda column, words: X.contains_any(F.col(column), words)
    either = F.when(F.col("tgt") != "", F.col("tgt")).otherwise(F.col("rel"))
    put = lambda bucket, value: F.struct(F.lit(bucket).alias("bucket"), value.alias("value"))
    where = (
        F.when(held("rel", C.GOOD_RELATIONS), put("positives", F.col("tgt")))
        .when(held("rel", C.BAD_RELATIONS), put("negatives", F.col("tgt")))
        .when(held("rel", C.EFFECT_RELATIONS), put("effects", F.col("tgt")))
        .when(held("rel", C.METHOD_HINTS), put("methods", either))
        .when(held("tgt", C.FOOD_HINTS), put("positives", F.col("tgt")))
        .when(held("tgt", C.METHOD_HINTS), put("methods", F.col("tgt")))
        .when(held("rel", C.CAUSE_RELATIONS), put("effects", F.col("tgt")))
        .otherwise(put("others", either))
    )
    rows = rows.withColumn("_b", where).select("question_id", "_b.bucket", "_b.value", "rank").filter("value != ''")
    return rows.groupBy("question_id", "bucket", "value").agg(F.min("rank").alias("rank"))


def _filled(template: str) -> Column:
    """The template with the columns season_label and season_prefix put in."""
    parts = []
    for piece in template.replace("{S}", "\x00S\x00").replace("{P}", "\x00P\x00").split("\x00"):
        parts.append({"S": F.col("season_label"), "P": F.col("season_prefix")}.get(piece, F.lit(piece)))
    return F.concat(*parts)


def _part(bucket: str, before: str, cap: int, after: str) -> Column:
    values = F.array_join(F.slice(bucket, 1, cap), "、")
    return F.when(F.size(bucket) > 0, F.concat(_filled(before), values, _filled(after)))


def _by_intent(intent: str) -> Column:
    (with_season, without), parts, sample, sorry = ANSWERS[intent]
    body = F.concat_ws("\n", *[_part(*p) for p in parts])
    lead = F.when(F.col("season_label") != "", _filled(with_season)).otherwise(F.lit(without))
    rest = F.coalesce(_part(*sample), _filled(sorry)) if sample else _filled(sorry)
    return F.when(body != "", F.concat(lead, F.lit("\n"), body)).otherwise(rest)


def format_answer(plans: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, evidence_count, answer_raw) for plans (question_id, intent, matched,
    season) and their evidence (question_id, source, relation, target, season, rank)."""
    buckets = bucket_evidence(evidence).groupBy("question_id").pivot("bucket", list(BUCKETS)).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))))
    buckets = buckets.select("question_id", *[F.transform(b, lambda x: x["value"]).alias(b) for b in BUCKETS])
    record = F.struct("rank", "source", "relation", "target", "season")
    records = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    rows = plans.select("question_id", "intent", "matched", "season").join(records, "question_id", "left").join(buckets, "question_id", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({b: F.coalesce(b, empty) for b in BUCKETS}).withColumn("evidence_count", F.coalesce(F.array_size("records"), F.lit(0)))
    label = F.coalesce(F.when(F.col("season") != "", F.col("season")), F.get("records", F.lit(0))["season"], F.lit(""))
    rows = rows.withColumn("season_label", label)
    rows = rows.withColumn("season_prefix", F.when(F.col("season_label") != "", F.concat("season_label", F.lit("时节"))).otherwise("该时节"))
    when = lambda r: F.when(r["season"] != "", F.concat(F.lit("（节气："), r["season"], F.lit("）"))).otherwise("")
    steps = F.transform("records", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["source"], F.lit(" --"), r["relation"], F.lit("--> "), r["target"], when(r)))
    path = F.concat(F.get("matched", F.lit(0)), F.lit(" 与 "), F.get("matched", F.lit(1)), F.lit(" 的关联路径：\n"), F.array_join(steps, "\n"))
    lines = F.array_distinct(F.transform(F.slice("records", 1, 8), lambda r: F.concat(F.lit("- "), r["source"], F.lit(" "), r["relation"], F.lit(" "), r["target"])))
    more = F.when(F.col("evidence_count") > 8, F.concat(F.lit("\n… 还有 "), (F.col("evidence_count") - 8).cast("string"), F.lit(" 条关联可继续查看。"))).otherwise("")
    general = F.concat(F.lit("关联知识要点：\n"), F.array_join(lines, "\n"), more)
    answer = F.when(F.col("evidence_count") == 0, APOLOGY)
    for intent in ANSWERS:
        answer = answer.when(F.col("intent") == intent, _by_intent(intent))
    answer = answer.when((F.col("intent") == PATH) & (F.size("matched") >= 2), path).otherwise(general)
    return rows.select("question_id", "evidence_count", answer.alias("answer_raw"))


def gather_evidence(plans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, source, relation, target, season, rank) for planned questions. Equal
    pairs and equal requests are looked up once."""
    near = plans.filter("kind = 'neighbour'").select(F.col("question_id").alias("request_id"), "focus", "season", "keywords")
    found = analytics.neighbor_query(nodes, edges, near).withColumnRenamed("request_id", "question_id")
    ends = plans.filter("kind = 'path'").select("question_id", F.get("matched", F.lit(0)).alias("src"), F.get("matched", F.lit(1)).alias("dst"))
    ends = ends.withColumn("pair_id", F.sha2(F.concat_ws("\x1f", "src", "dst"), 256))
    paths = analytics.shortest_path(nodes, edges, ends.select("pair_id", "src", "dst").distinct())
    paths = paths.filter(F.col("hop") <= MAX_PATH_ROWS).join(ends.select("question_id", "pair_id"), "pair_id")
    return found.unionByName(paths.select("question_id", "source", "relation", "target", "season", F.col("hop").alias("rank")))


def answer_questions(questions: DataFrame, lexicon: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(question_id, question, status, intent, entities, matched, season, description,
    evidence_count, answer_raw), a row for each question. Empty questions are errors;
    nonsense and questions without any known name are invalid and get an apology."""
    rows = questions.select("question_id", X.strip(F.coalesce("question", F.lit(""))).alias("question"))
    rows = rows.withColumn("_bad", X.is_nonsense(F.col("question")))
    planned = written(plan_query(link_question(rows, lexicon)), "questions")
    good = ~F.col("_bad") & (F.size("matched") > 0)
    asked = planned.filter(good)
    answers = format_answer(asked, gather_evidence(asked, nodes, edges))
    none = F.lit(None).cast("string")
    out = planned.join(answers, "question_id", "left").select(
        "question_id",
        "question",
        F.when(F.col("question") == "", "error").otherwise("ok").alias("status"),
        F.when(good, F.col("intent")).when(F.col("question") != "", INVALID).alias("intent"),
        F.when(good, F.col("entities")).otherwise(F.expr("cast(map() as map<string,array<string>>)")).alias("entities"),
        F.when(good, F.col("matched")).otherwise(F.array().cast("array<string>")).alias("matched"),
        F.when(good, F.col("season")).otherwise(none).alias("season"),
        F.when(good, F.col("description")).when(F.col("question") == "", "问题不能为空").when(F.col("_bad"), "无效提问，未执行查询").otherwise("未匹配到有效实体，未执行查询").alias("description"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.when(good, F.col("answer_raw")).when(F.col("question") != "", APOLOGY).alias("answer_raw"),
    )
    return out
