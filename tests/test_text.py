import re

import pytest
from pyspark.sql import functions as F

from graphjobs.functions import config as C
from graphjobs.functions import text as X


def values(spark, rows, *exprs):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)])
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.orderBy("_1").select(*exprs).collect()]


def test_validate_entity_goldens(spark):
    cases = {
        "℃": "entity_too_short", "顾": "entity_too_short", "托": "entity_too_short", "闻": "entity_too_short", "我国": "entity_blacklist", "中医": "entity_blacklist",
        "春": "passed", "3.14": "entity_numeric", "12": "entity_numeric", "http://x": "entity_url", "www.a": "entity_url", "": "empty", "立春": "passed", "五四三二一零九八七六五四三二一零九": "passed",
    }
    assert values(spark, list(cases), X.validate_entity(F.col("_2"))) == list(cases.values())


def test_clean_string_and_names(spark):
    rows = ["  “《本草》” ", "　《黄帝内经》。，", "'quoted'", "a　", "。，"]
    rows = [r or "" for r in rows]
    want = [re.sub(r"""^["'《“‘]+|["'》”’。，]+$""", "", r.strip()) for r in rows]
    assert values(spark, rows, X.clean_string(F.col("_2"))) == want
    assert values(spark, ["《a》b ", "　x"], X.sanitize_name(F.col("_2"))) == ["ab", "x"]


def test_infer_label_order(spark):
    cases = [
        ("", "作者", True, "Entity"), ("太极", "创编", True, "Technique"), ("张三丰", "创编", False, "Person"), ("李时珍", "作者", True, "Person"), ("某刊", "发表期刊", False, "Source"),
        ("立春时节", "", False, "SolarTerm"), ("春季", "", False, "Season"), ("八段锦", "", False, "Technique"), ("感冒", "", False, "Disease"), ("肝脏", "", False, "BodyPart"),
        ("羊肉汤", "", False, "Food"), ("中医杂志", "", False, "Source"), ("北京大学", "", False, "Organization"), ("黑龙江", "", False, "Location"), ("王伟", "", False, "Person"), ("其他", "", False, "Entity"),
    ]
    assert values(spark, [c[:3] for c in cases], X.infer_label(F.col("_2"), F.col("_3"), F.col("_4"))) == [c[3] for c in cases]


def test_infer_season_and_safe_type(spark):
    rows = [("立春", "x", "y"), ("未知", "冬至立春", "夏至"), ("", "无", "夏至"), (" “秋分” ", "立春", ""), ("未知", "无", "无")]
    assert values(spark, rows, X.infer_season(F.col("_2"), F.col("_3"), F.col("_4"))) == ["立春", "立春", "夏至", "秋分", "未知"]
    assert values(spark, ["宜 食-a_½Ⅷ!"], X.safe_type(F.col("_2"))) == ["宜_食_a_½Ⅷ_"]


def test_paragraph_cleaning(spark):
    rows = ['引[12]文【3，4】~A1（b）"" x', "a\tb  c", "　全角Ａ１\x07"]
    assert values(spark, rows, X.clean_paragraph_text(F.col("_2"))) == ["引文", "", "全角"]
    assert values(spark, ["a\tb  c "], X.clean_paragraph_text(F.col("_2"), raw=True)) == ["a b c"]
    assert values(spark, ["a,,b　\n c--d"], X.clean_extract_text(F.col("_2"))) == ["a b c d"]


def test_skip_line(spark):
    cases = {"短": True, "作者简介：某某": True, "··2023··": True, "第 12 卷某某某": True, "2023 年 5 月发表": True, "DOI: 10.1/中文": True, "only latin letters": True, "立春时节宜养肝护肝": False}
    assert values(spark, list(cases), X.skip_line(F.col("_2"))) == list(cases.values())


@pytest.mark.parametrize("chars,cjk,want", [(30, 20, True), (29, 20, False), (30, 19, False)])
def test_valid_paragraph_limits(spark, chars, cjk, want):
    assert values(spark, ["养" * cjk + "a" * (chars - cjk)], X.valid_paragraph(F.col("_2"))) == [want]


def test_detect_season(spark):
    full = "立夏\n" + "很长的一行" * 30 + "谷雨\n这里是段落的开头内容"
    rows = [("夏至和立春", full), ("这里是段落的开头内容", full), ("找不到", full), ("立夏" * 0 + "无", "无")]
    assert values(spark, rows, X.detect_season(F.col("_2"), F.col("_3"))) == ["立春", "立夏", "未知", "未知"]


def test_nonsense_and_titles(spark):
    cases = {"": True, "???": True, "啊": True, "啊啊啊": True, "啊啊啊啊啊啊": False, "12345": True, "ab": False, "立春吃什么": False}
    assert values(spark, list(cases), X.is_nonsense(F.col("_2"))) == list(cases.values())
    assert values(spark, ["书名_作者.pdf", "a.pdf.pdf", "x"], X.normalize_title(F.col("_2"))) == ["书名", "a", "x"]


def test_lists_are_whole():
    assert len(C.TERMS) == 24 and len(C.RELEVANT_WORDS) == 27 and len(C.SKIP_WORDS) == 16 and len(C.BLACKLIST) == 34 and len(set(C.SHORT_NAMES)) == len(C.SHORT_NAMES)


def test_surnames_of_persons(spark):
    names = {"贲志明": True, "甄妮": True, "姜尚": True, "欧阳修": False, "肖邦": False, "龙应台": False, "李血": False, "王": False, "赵钱孙李周": False}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.p for r in df.select("name", X.is_probable_person(F.col("name")).alias("p")).collect()}
    assert got == names
