import html as html_entities
import json
import random
import re
import uuid

import pytest

from graphjobs.functions import config as C
from graphjobs.jobs import catalog_more, catalog_text, fixtures, pipelines
from graphjobs.operators import extraction, layout, mentions, pages, segment
from pyspark.sql import functions as F

SENTENCE = "立春时节养生应当顺应自然调养肝气多吃辛甘发散的食物少吃酸味"


def kept(p):
    return len(p) >= 30 and len(re.findall("[一-鿿]", p)) >= 20 and any(w in p for w in C.RELEVANT_WORDS + C.RELAXED_WORDS)


def chunks(text):
    out, now = [], ""
    for s in re.split("[。！？]", text):
        now += s.strip()
        if len(now) >= 80:
            if kept(now):
                out.append(now)
            now = ""
    return out + ([now] if kept(now) else [])


def test_chunks_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice([SENTENCE, "短句", "无关的一句话而已", "冬至"]) + rng.choice("。！？，") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "。。。"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, text string")
    got = {r.id: r.c for r in df.select("id", segment.chunk_sentences(F.col("text")).alias("c")).collect()}
    assert got == {**{i: chunks(t) for i, t in enumerate(texts)}, 999: []}


def test_sections(spark):
    text = "立春时节宜养肝护肝\n摘要：这是一段摘要文字\n摘要继续的一行文字\n\n雨水节气要注意祛湿\nKey Words: 养生养生养生\n\n惊蛰养生的方法有很多\nReferences\n谷雨这一行不要出现"
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(segment.filter_sections(F.col("text"))).collect()]
    assert got == ["立春时节宜养肝护肝\n雨水节气要注意祛湿\n惊蛰养生的方法有很多", "", ""]


def test_texts_of_very_many_lines(spark):
    lines = ["立春时节宜养肝护肝", "摘要"] + ["摘要继续的一行文字"] * 100_000 + ["", "惊蛰养生的方法有很多"] + ["  "] * 50_000
    df = spark.createDataFrame([("\n".join(lines),), ("立春宜养肝。" * 200_000,)], "text string").repartition(2)
    rows = df.select(segment.filter_sections(F.col("text")).alias("t"), F.size(segment.split_paragraphs(F.col("text"))).alias("n")).collect()
    by_size = sorted(rows, key=lambda r: len(r.t))
    assert by_size[0].t == "立春时节宜养肝护肝\n惊蛰养生的方法有很多"
    # sixteen sentences of five characters reach eighty
    assert by_size[1].n == 200_000 // 16


def test_blocks(spark):
    long = SENTENCE * 4
    text = f"{long}。\n\n{long}，\n\n{long}。\n\n短块\n\n{long}！\n\n{long}？"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(segment.split_paragraphs(F.col("text"))).first()[0]
    assert got == [f"{long}。", f"{long}，{long}。短块{long}！", f"{long}？"]


def test_headings_carry_over_paragraphs(spark):
    rows = [("d", 0, "没有节气的段落" * 5), ("d", 1, "01 立春 LICHUN 标题"), ("d", 2, "跟随的段落" * 6), ("d", 3, "前面的文字" * 5 + "02 雨水 YUSHUI " + "后面的文字" * 5 + " 03 甲乙 AB"), ("d", 4, "再后面" * 9), ("e", 0, "另一文件")]
    df = spark.createDataFrame([(d, [t for e, _, t in rows if e == d]) for d in "de"], "doc string, paragraphs array<string>")
    parts = df.select("doc", F.explode(segment.split_headings(F.col("paragraphs"))).alias("p")).select("doc", "p.*")
    got = [(r.doc, r.pos, r.segment, r.season) for r in parts.orderBy("doc", "pos", "segment").collect()]
    assert got == [("d", 0, 0, None), ("d", 2, 0, "立春"), ("d", 3, 0, "立春"), ("d", 3, 1, "雨水"), ("d", 4, 0, "雨水"), ("e", 0, 0, None)]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_numbers_follow_the_order(spark, most):
    rng = random.Random(2)
    docs = [(f"f{i % 37}_x{i:03}.pdf", [(k, 0, f"{i}-{k}", "s") for k in range(rng.choice([0, 1, 3, 40]))]) for i in range(200)]
    docs += [("f3_x003.pdf", [(0, 0, "again", "s")]), ("g", None), ("h", [])]
    df = spark.createDataFrame(docs, "doc string, parts array<struct<pos:int,segment:int,context:string,season:string>>").repartition(9)
    got = segment.number_paragraphs(df, most).orderBy("id").collect()
    want = [(d, p[0], p[2]) for d, parts in docs for p in parts or []]
    assert [r.id for r in got] == list(range(1, len(want) + 1))
    own = [r.context for r in got if r.context != "again"]
    assert own == [c for _, _, c in sorted(w for w in want if w[2] != "again")]


def test_numbering_moves_no_text(spark):
    df = spark.createDataFrame([("a", [(0, 0, "c", "s")])], "doc string, parts array<struct<pos:int,segment:int,context:string,season:string>>")
    plan = segment.number_paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange" in x]
    assert moved and all("Broadcast" in x for x in moved)


def test_lines_of_two_columns(spark):
    rows = [("d", 0, i, x, top, c, 100.0) for i, (x, top, c) in enumerate([(60, 1, "C"), (10, 2, "B"), (5, 0, "A"), (62, 2.4, "D"), (5, 7.6, "E"), (5, 12.5, "F")])]
    rows += [("d", 1, 0, 5.0, 0.0, "Z", 100.0)]
    df = spark.createDataFrame([(d, p, i, float(x), float(t), c, w) for d, p, i, x, t, c, w in rows], "doc string, page int, pos long, x0 double, top double, text string, page_width double")
    # 12.5 / 5 = 2.5 rounds to the even 2
    assert layout.reconstruct_lines(df).first().text == "AB\nEF\nCD\nZ"


def test_pages_against_plain_python(spark):
    rng = random.Random(21)
    rows = []
    for page in range(25):
        for pos in range(rng.choice([1, 2, 30, 200])):
            x = rng.choice([rng.uniform(0, 40), rng.uniform(47, 70), rng.uniform(90, 100), 10.0])
            rows.append((f"d{page % 4}", page, pos, x, rng.uniform(0, 40), rng.choice(["a", "立", " ", None]), 100.0))
    want = {}
    for page in range(25):
        own = sorted((r for r in rows if r[1] == page), key=lambda r: r[3])
        gaps = sorted(((r[3] - q[3], -i) for i, (q, r) in enumerate(zip(own, own[1:])) if r[3] - q[3] > 5), reverse=True)[:2]
        dividers = [own[-i][3] + g / 2 for g, i in gaps]
        lines = {}
        for _, _, pos, x, top, text, _ in own:
            lines.setdefault((sum(d <= x for d in dividers), round(top / 5) * 5), []).append((x, pos, text or ""))
        text = "\n".join("".join(c for *_, c in sorted(lines[k])) for k in sorted(lines))
        want.setdefault(f"d{page % 4}", []).append(text)
    df = spark.createDataFrame(rows, "doc string, page int, pos long, x0 double, top double, text string, page_width double").repartition(7)
    assert {r.doc: r.text for r in layout.reconstruct_lines(df).collect()} == {d: "\n".join(t) for d, t in want.items()}
    plan = layout.reconstruct_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


BOX = "doc string, page int, pos long, x0 double, top double, text string, page_width double"


def boxes_by_page(spark, rows):
    """The same characters as a page reader gives them."""
    pages = {}
    for doc, page, *char, width in rows:
        pages.setdefault((doc, page, width), []).append(tuple(char))
    return spark.createDataFrame([(*k, v) for k, v in pages.items()], "doc string, page int, page_width double, chars array<struct<pos:long,x0:double,top:double,text:string>>")


def odd_boxes():
    rng = random.Random(22)
    odd = [None, float("nan"), -0.0, 0.0, 30.0, 60.0]
    rows = [(f"d{page % 3}", page, rng.choice([None, pos]), rng.choice(odd), rng.choice([*odd, 2.5, 7.5, 12.4]), rng.choice(["a", "fi", "立", "😀", "", None]), rng.choice([100.0])) for page in range(12) for pos in range(40)]
    return rows + [("d9", 0, 1, None, None, "x", 100.0), ("d9", 1, 1, 5.0, 0.0, None, None)]


def test_pages_in_rows_give_what_characters_give(spark):
    flat, pages = spark.createDataFrame(odd_boxes(), BOX).repartition(5), boxes_by_page(spark, odd_boxes())
    for job in (layout.detect_columns, layout.assign_columns, layout.reconstruct_lines):
        # repr, as NaN is not equal to itself
        assert sorted(map(repr, job(flat).collect())) == sorted(map(repr, job(pages).collect()))
    joined = flat.join(layout.detect_columns(flat), ["doc", "page"])
    counted = joined.select("doc", "page", "pos", F.size(F.filter("dividers", lambda d: d <= F.col("x0"))).alias("col"))
    assert sorted(map(repr, counted.collect())) == sorted(map(repr, layout.assign_columns(flat).collect()))


def test_odd_characters_stand_as_spark_orders_them(spark):
    """Lines by columns, heights, x0, pos and text, nulls first and NaN last."""
    flat = spark.createDataFrame(odd_boxes(), BOX)
    placed = flat.join(layout.detect_columns(flat), ["doc", "page"]).select("doc", "page", F.struct(F.size(F.filter("dividers", lambda d: d <= F.col("x0"))).alias("col"), (F.rint(F.col("top") / 5) * 5).alias("line"), "x0", "pos", F.coalesce("text", F.lit("")).alias("text")).alias("c"))
    want = {}
    for r in placed.groupBy("doc", "page").agg(F.sort_array(F.collect_list("c")).alias("c")).orderBy("doc", "page").collect():
        text = "".join(("\n" if i and (repr(r.c[i - 1].line), r.c[i - 1].col) != (repr(c.line), c.col) and not (c.line == r.c[i - 1].line and c.col == r.c[i - 1].col) else "") + c.text for i, c in enumerate(r.c))
        want.setdefault(r.doc, []).append(text)
    assert {r.doc: r.text for r in layout.reconstruct_lines(flat).collect()} == {d: "\n".join(t) for d, t in want.items()}


def test_layout_queries_move_no_characters(spark):
    """Boxes are cut into pages in their documents' rows; only lines' texts are shuffled."""
    sf = "/root/testdata/sf0.001"
    boxes = fixtures.frame(spark, sf, "char_boxes")
    own = fixtures.char_pages(spark, sf, "pos", "x0", "top", "text").select("doc", "page", "page_width", F.inline("chars")).select(*boxes.columns)
    assert own.dtypes == boxes.dtypes and own.exceptAll(boxes).isEmpty() and boxes.exceptAll(own).isEmpty()
    for query, moves in ((catalog_text.detect_columns, 0), (catalog_more.assign_column, 0), (catalog_text.reconstruct_lines, 1)):
        assert query(spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == moves


class Node:
    def __init__(self, tag, attrs="", parent=None):
        self.tag, self.parent, self.children = tag, parent, []
        found = dict(re.findall(r"""([\w-]+)\s*=\s*["']([^"']*)["']""", attrs))
        self.classes, self.id = found.get("class", "").split(), found.get("id", "")

    def every(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.every()


def tree_of(page):
    """A tree of a page by a tokenizer of its own: comments and declarations go, scripts and
    styles hold no tags, an end tag closes up to its start."""
    page = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "", page)
    page = re.sub(r"(?is)<(script|style)([^>]*)>.*?</\1>", r"<\1\2></\1>", page)
    at = top = Node("top")
    for end, tag, attrs, text in re.findall(r"<(/?)([A-Za-z][\w-]*)([^>]*)>|([^<]+)", page):
        tag = tag.lower()
        if text:
            at.children.append(html_entities.unescape(text))
        elif end:
            up = at
            while up.parent and up.tag != tag:
                up = up.parent
            at = up.parent or at
        else:
            node = Node(tag, attrs, at)
            at.children.append(node)
            if tag not in pages.VOID:
                at = node
    return top


def text_of_tree(page):
    top = tree_of(page)

    def dropped(n):
        return n.tag in pages.DROPPED_TAGS or bool(pages.DROPPED_CLASSES & set(n.classes))

    def cleaned(n):
        n.children = [c for c in n.children if not (isinstance(c, Node) and dropped(c))]
        for c in n.children:
            if isinstance(c, Node):
                cleaned(c)

    cleaned(top)
    for wanted in pages.CONTAINERS:
        found = [n for n in top.every() if wanted in (n.tag, "#" + n.id) or wanted[1:] in n.classes and wanted[0] == "."]
        if found:
            break
    else:
        return ""

    def pieces(n):
        for c in n.children:
            if isinstance(c, str):
                yield c.replace("\n", " ")
            else:
                around = "" if c.tag in pages.INLINE else "\n"
                yield around + "".join(pieces(c)) + around

    return "\n".join(x.strip() for x in "".join(pieces(found[0])).split("\n") if x.strip())


def test_main_text_of_all_pages_against_a_tree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = rows.select("page_id", "html", pages.html_main_text(F.col("html")).alias("t")).collect()
    assert len(got) > 200 and all(r.t == text_of_tree(r.html or "") for r in got)
    assert sum(len(r.t) > 100 for r in got) > 100
    articles = pages.pages_to_articles(rows.select("url", "html", F.col("page_id").alias("pos"))).collect()
    want = {r.page_id: r.html for r in got if len(r.t) > 100}
    assert {a.pos for a in articles} == set(want)
    for a in articles:
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", want[a.pos])
        assert a.content == text_of_tree(want[a.pos]) and a.title == (title[1].strip(" ") if title else "")


def test_main_text():
    html = "<html><body><nav>menu</nav><p>out</p><article><h1>T<b>i</b></h1><script>x()</script><p>one<br>two</p><div class='ads big'>ad</div><footer>f</footer></article><article>second</article></body></html>"
    assert pages.main_text(html) == "Ti\none\ntwo"
    assert pages.main_text("<body>a<div id=content>b</div></body>") == "b"
    assert pages.main_text(None) == pages.main_text("<p>no body</p>") == ""


def test_linking_methods_agree(spark):
    names = ["立春", "春", "养生", "立春养生", "食", "饮食", "a.b"]
    dictionary = spark.createDataFrame([(n, f"L{i}", i) for i, n in enumerate(names)], "name string, label string, pos long")
    docs = spark.createDataFrame([(1, None, "立春养生的饮食a.b春"), (2, "冬至", "没有"), (3, "x", None), (4, "y", ""), (5, "z", "春春" * 9000)], "id long, season string, context string")
    want = {1: ("未知", ["立春养生", "立春", "春", "养生", "饮食", "食", "a.b"]), 5: ("z", ["春"])}
    for method in ("names", "automaton"):
        got = {r.id: (r.season, [e.name for e in r.entities]) for r in mentions.link_mentions(docs, dictionary, method, block_chars=4).collect()}
        assert got == want
    assert mentions.link_mentions(docs, dictionary.limit(0)).count() == 0


def test_candidates_and_season(spark):
    ents = [(f"n{'x' * (i % 5)}{i}", "L") for i in range(70)]
    df = spark.createDataFrame([(1, "n0", "c" * 2000, ents), (2, "未知", "context", ents[:2]), (3, "s", "abc", ents[:2]), (4, "s", "context", ents[:1])], "id long, season string, context string, entities array<struct<name:string,label:string>>")
    got = {r.id: r for r in extraction.prepare_requests(df).collect()}
    assert set(got) == {1, 2} and len(got[1].candidates) == 60 and len(got[1].context) == 1500
    want = sorted(ents, key=lambda e: -len(e[0]))[:60]
    assert [e.name for e in got[1].candidates] == [n for n, _ in want]
    moved = df.select(extraction.promote_season_entity(F.col("entities"), F.lit("nx1")).alias("e")).first().e
    assert [e.name for e in moved[:3]] == ["nx1", "n0", "nxx2"]


def test_responses(spark):
    fence = "```"
    cases = [
        ('[["a","r","b"],["a","r"],["a","r","a"],["a","r","z"]]', [["a", "r", "b"]]),
        (f'x {fence}json\n[["b","q","a"]]\n{fence} y', [["b", "q", "a"]]),
        (f'{fence}\n[["a","r","b"]]{fence}', [["a", "r", "b"]]),
        ('[["a","r","b"], 5]', []),
        ("garbage", []), ("{}", []), (None, []),
    ]
    rows = [(i, "s", t, [("a", "L"), ("b", "L")]) for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, season string, response string, candidates array<struct<name:string,label:string>>")
    df = df.withColumn("relations", extraction.listed_relations(extraction.parse_response_list(F.col("response"))))
    got = {}
    for r in extraction.validate_relations(df).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append([r.head, r.type, r.tail])
    assert got == {i: w for i, (_, w) in enumerate(cases) if w}


def test_extractor_failures_are_empty(spark):
    df = spark.createDataFrame([(1, "c", "t")], "id long, candidates_text string, context string")

    def fails(candidates, contexts):
        raise ValueError("no model")

    assert extraction.apply_extractor(df, fails).first().response is None


def test_one_bad_request_leaves_its_batch_alone(spark):
    rows = [(i, f"c{i}", "bad" if i in (3, 8) else "t") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, candidates_text string, context string").coalesce(1)

    def model(candidates, contexts):
        if (contexts == "bad").any():
            raise ValueError("refused")
        return candidates.str.upper()

    got = {r.id: r.response for r in extraction.apply_extractor(df, model).collect()}
    assert got == {i: None if i in (3, 8) else f"C{i}" for i in range(12)}
    assert extraction.apply_extractor(df.limit(0), model).count() == 0


def test_a_run_that_was_stopped_asks_only_what_is_missing(spark, tmp_path):
    calls, stop, log = tmp_path / "calls", tmp_path / "stop", str(tmp_path / "log")
    calls.mkdir()
    rows = [(i, f"c{i % 30}", "t") for i in range(40)]  # ten requests come twice
    df = spark.createDataFrame(rows, "id long, candidates_text string, context string")

    def model(candidates, contexts):
        for c in candidates:
            if stop.exists() and len(list(calls.iterdir())) >= 17:
                raise KeyboardInterrupt("the run is stopped")
            (calls / f"{c}-{uuid.uuid4().hex}").touch()
        return candidates.str.upper()

    stop.touch()
    with pytest.raises(Exception, match="stopped"):
        extraction.apply_extractor(df, model, log, save_every=1, parallel=2)
    known = {r.key for r in extraction.known_answers(spark, log).collect()}
    assert 0 < len(known) < 30
    stop.unlink()
    (tmp_path / "log" / "cut.json").write_text('{"key": "abc", "resp')
    before = len(list(calls.iterdir()))
    got = {r.id: r.response for r in extraction.apply_extractor(df, model, log, save_every=4).collect()}
    assert got == {i: f"C{i % 30}" for i in range(40)}
    # each answer that was kept was asked for once, by either run
    assert len(list(calls.iterdir())) - before == 30 - len(known)
    asked = [p.name.split("-")[0] for p in calls.iterdir()]
    assert max(map(asked.count, asked)) <= 2 and len(asked) - 30 <= 2  # what was asked when it stopped
    assert extraction.apply_extractor(df, None, log).count() == 40  # no model is needed any more


def test_retries(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "t"), (2, "d", "t")], "id long, candidates_text string, context string").coalesce(1)

    def model(candidates, contexts):
        mark = tmp_path / "-".join(candidates)
        tries = len(list(tmp_path.glob(mark.name + ".*")))
        (tmp_path / f"{mark.name}.{tries}").touch()
        if len(candidates) > 1 or (candidates.iloc[0] == "d" and tries < 2):
            raise ValueError("busy")
        return candidates

    got = {r.id: r.response for r in extraction.apply_extractor(df, model, parallel=1, retries=2).collect()}
    assert got == {1: "c", 2: "d"}


def test_free_extraction(spark):
    texts = [json.dumps({"entities": ["e"], "relations": [["a", "b", "c", "d"], "x，y-z", "one"], "attributes": [{"entity": "e", "attribute": "k", "value": "v"}]}), 'so {"relations": []} ok', "[1]", None, "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.n for r in df.orderBy("id").select(extraction.normalize_extraction(extraction.parse_response_object(F.col("text"))).alias("n")).collect()]
    assert got[0].relations == [["a", "b", "c", "d"], ["x", "y", "z"]] and got[0].attributes[0].value == "v"
    assert all(n.entities == [] and n.relations == [] for n in got[1:])


def test_text_to_mentions_job(spark):
    text = "\n".join([SENTENCE + SENTENCE + "立春宜食韭菜。"] * 3)
    docs = spark.createDataFrame([("书_1.pdf", text)], "doc string, text string")
    dictionary = spark.createDataFrame([("韭菜", "FoodHerb", 1), ("立春", "SolarTerm", 2)], "name string, label string, pos long")
    got = pipelines.text_to_mentions(docs, dictionary).collect()
    assert got and all([e.name for e in r.entities][0] == "立春" and r.season == "立春" for r in got)
