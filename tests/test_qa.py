from pyspark.sql import functions as F

from graphjobs.operators import qa

LEXICON = [("羊肉", "FoodHerb", 1), ("养肝", "Concept", 2), ("中暑", "DiseaseSymptom", 3), ("春", "TimeSeason", 4)]
NODES = "node_id string, name string, labels array<string>"
EDGES = "edge_id string, src_id string, dst_id string, rel_type string, type string, season string"


def parts(spark):
    lexicon = spark.createDataFrame(LEXICON, "name string, label string, pos long")
    names = ["立春", "冬至", "夏至", "羊肉", "养肝", "中暑", "韭菜", "肝", "枸杞", "秋分", "散步"]
    nodes = spark.createDataFrame([(n, n, ["X"]) for n in names], NODES)
    rels = [("立春", "宜食", "韭菜", "立春"), ("立春", "忌食", "羊肉", ""), ("立春", "养生重点", "养肝", "立春"), ("夏至", "预防", "中暑", "夏至"), ("养肝", "对应", "肝", None), ("冬至", "宜食", "羊肉", "冬至"), ("秋分", "导引", "散步", "秋分")]
    edges = spark.createDataFrame([(f"e{i}", a, b, r, r, s) for i, (a, r, b, s) in enumerate(rels)], EDGES)
    return lexicon, nodes, edges


def test_answers(spark):
    questions = ["立春适合吃什么?", "冬至如何养生?", "夏至预防中暑", "秋分养生注意事项", "羊肉和养肝有什么关系", "", "???", "hello world", "枸杞肝", None]
    df = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string").repartition(3)
    got = {r.question_id: r for r in qa.answer_questions(df, *parts(spark)).collect()}
    assert len(got) == len(questions)
    r = got[0]
    assert (r.intent, r.season, r.description, r.evidence_count) == ("饮食养生", "立春", "查询【立春】的关联知识", 2)
    assert r.answer_raw == "关于立春的饮食建议：\n宜食：韭菜。\n忌食：羊肉。"
    assert got[1].intent == "饮食养生" or got[1].intent == "节气养生"
    assert got[2].intent == "疾病调理" and got[2].answer_raw == "夏至疾病预防与调理建议：\n在夏至，可能相关的症状/风险有：中暑。"
    assert got[3].answer_raw.startswith("秋分养生要点：\n建议注重：散步，以修养身心。")
    path = got[4]
    assert path.intent == "关系路径" and path.evidence_count == 2
    assert path.answer_raw == "羊肉 与 养肝 的关联路径：\n1. 羊肉 --忌食--> 立春\n2. 立春 --养生重点--> 养肝（节气：立春）"
    assert got[5].status == got[9].status == "error" and got[5].answer_raw is None
    assert {got[i].intent for i in (6, 7)} == {"无效提问"} and got[6].answer_raw == qa.APOLOGY
    assert got[8].matched == ["肝"] and got[8].intent == "通用查询" and got[8].answer_raw == qa.APOLOGY


def test_linking_caps_the_lexicon_only(spark):
    names = [f"词{chr(0x4e00 + i)}" for i in range(15)]
    lexicon = spark.createDataFrame([(n, "L", i) for i, n in enumerate(names)], "name string, label string, pos long")
    df = spark.createDataFrame([(1, "".join(names) + "冬至立春粥失眠")], "question_id long, question string")
    r = qa.link_question(df, lexicon).first()
    assert r.matched == names[:12] + ["立春", "冬至", "粥", "失眠"]
    assert r.entities == {"L": names[:12], "SolarTerm": ["立春", "冬至"], "饮食": ["粥"], "疾病": ["失眠"]}


def test_buckets_keep_their_order_of_rules(spark):
    rows = [(1, "", "不宜", "酒", "", 1), (1, "", "忌", "辣", "", 2), (1, "", "关联", "羊肉汤", "", 3), (1, "", "导引", "", "", 4), (1, "", "引起", "咳嗽", "", 5), (1, "", "x", "y", "", 6), (1, "", "忌", "辣", "", 7), (1, "", "", "", "", 8)]
    df = spark.createDataFrame(rows, "question_id long, source string, relation string, target string, season string, rank int")
    got = {(r.bucket, r.value, r["rank"]) for r in qa.bucket_evidence(df).collect()}
    assert got == {("positives", "酒", 1), ("negatives", "辣", 2), ("positives", "羊肉汤", 3), ("methods", "导引", 4), ("effects", "咳嗽", 5), ("others", "y", 6)}


def test_general_answer_lists_eight(spark):
    plans = spark.createDataFrame([(1, "通用查询", ["a"], None)], "question_id long, intent string, matched array<string>, season string")
    rows = [(1, "s", "r", f"t{i % 7}", "", i) for i in range(1, 12)]
    ev = spark.createDataFrame(rows, "question_id long, source string, relation string, target string, season string, rank int")
    r = qa.format_answer(plans, ev).first()
    lines = r.answer_raw.split("\n")
    assert r.evidence_count == 11 and lines[0] == "关联知识要点：" and len(lines) == 9 and lines[-1] == "… 还有 3 条关联可继续查看。"
    assert plans.filter(F.col("season").isNull()).count() == 1
