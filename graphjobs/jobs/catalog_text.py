"""Queries of the text, mention, extraction, layout and page operators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..operators import extraction, layout, mentions, pages, segment
from . import sql as S
from .catalog import flat, query
from .fixtures import char_pages, cte, frame

LATIN = C.LATIN


def _docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- text --------------------------------------------------------------------------

_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, {S.clean_paragraph('text', raw=True)} AS text FROM documents")
def clean_paragraph_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_paragraph_text(F.col("text"), raw=True).alias("text"))


@query(f"SELECT doc_id, {S.clean_paragraph('text')} AS text FROM documents")
def clean_paragraph_text_without_letters(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_paragraph_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {S.replaced(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', (*X.EXTRACT_STEPS, (X.STRIP, '')))} AS text FROM documents")
def clean_extract_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_extract_text(F.col("text")).alias("text"))


_LINES = "WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


@query(f"{_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {S.skip_line('line', LATIN)}) AS skipped FROM lines GROUP BY doc_id")
def skip_line(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.skip_line(F.col("line"), LATIN)).alias("skipped"))


@query(f"SELECT doc_id, {S.valid(_TEXT, LATIN)} AS valid, {S.any_of(_TEXT, LATIN.relevant_words)} AS relevant FROM documents")
def valid_paragraph(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.valid_paragraph(F.col("text"), LATIN).alias("valid"), X.relevant(F.col("text"), LATIN).alias("relevant"))


@query("SELECT doc_id, string_split(replace(source || '.pdf_' || lang, '.pdf', ''), '_')[1] AS title FROM documents")
def normalize_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalize_title(F.concat("source", F.lit(".pdf_"), "lang")).alias("title"))


@query(f"SELECT doc_id, {S.filter_sections(_TEXT, LATIN)} AS text FROM documents")
def filter_sections(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", segment.filter_sections(F.col("text"), LATIN).alias("text"))


def _named(spark, sf_dir) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf"))
    return _docs(spark, sf_dir).select(name.alias("doc"), "text")


def _listed(docs: DataFrame, paragraphs) -> DataFrame:
    rows = docs.select("doc", F.posexplode_outer(paragraphs).alias("pos", "paragraph"))
    return rows.filter("paragraph is not null")


#: The paragraphs of all documents, as lists.
_BODIES = f"""named AS (SELECT coalesce(source, 'none') || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.pdf' AS doc, {_TEXT} AS full_text FROM documents),
    bodies AS (SELECT doc, full_text, {S.filter_sections('full_text', LATIN, raw=True)} AS body FROM named),
    listed AS (SELECT doc, full_text, {S.paragraphs('body', LATIN, raw=True)} AS l FROM bodies),
    paragraphs AS (SELECT doc, full_text, CAST(i - 1 AS INT) AS pos, l[i] AS paragraph FROM listed, unnest(range(1, len(l) + 1)) AS r(i))"""


@query(f"WITH {_BODIES} SELECT doc, pos, paragraph FROM paragraphs")
def chunk_sentences(spark, sf_dir):
    return _listed(segment.document_paragraphs(_named(spark, sf_dir), LATIN, raw=True), F.col("paragraphs"))


@query(f"""WITH lists AS (SELECT coalesce(source, 'none') || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.pdf' AS doc, replace({_TEXT}, chr(10), chr(10) || chr(10)) AS t FROM documents),
    listed AS (SELECT doc, {S.paragraphs('t', LATIN, raw=True)} AS l FROM lists)
    SELECT doc, CAST(i - 1 AS INT) AS pos, l[i] AS paragraph FROM listed, unnest(range(1, len(l) + 1)) AS r(i)""")
def split_paragraphs(spark, sf_dir):
    blocks = F.regexp_replace("text", "\n", "\n\n")
    return _listed(_named(spark, sf_dir), segment.split_paragraphs(blocks, LATIN, raw=True))


@query(f"WITH {_BODIES} SELECT doc, pos, {S.season_of('paragraph', 'full_text', LATIN.terms)} AS season FROM paragraphs")
def detect_season(spark, sf_dir):
    return segment.paragraphs_of(_named(spark, sf_dir), LATIN, raw=True).select("doc", "pos", "season")


def _with_headings(spark, sf_dir) -> DataFrame:
    """Paragraphs of which some begin with a heading and some hold one."""
    rows = segment.document_paragraphs(_named(spark, sf_dir), LATIN, raw=True)
    terms = F.array(*map(F.lit, C.TERMS))

    def headed(p, i):
        heading = F.concat(F.lpad((i % 24 + 1).cast("string"), 2, "0"), F.lit(" "), F.get(terms, i % 24), F.lit(" ABC "))
        return F.when(i % 5 == 1, F.concat(heading, p)).when(i % 5 == 3, F.concat(F.substring(p, 1, 30), heading, p)).otherwise(p)

    return rows.withColumn("parts", segment.split_headings(F.transform("paragraphs", headed)))


#: Within a document the season is that of the latest heading; the fixture's headings are
#: known by their place, and no other text has one.
_HEADED = f"""{_BODIES}, headed AS (SELECT *, ([{S.listed(C.TERMS)}])[pos % 24 + 1] AS term FROM paragraphs),
    pieces AS (SELECT doc, full_text, pos, 0 AS segment, paragraph AS text, NULL AS heading, false AS cut FROM headed WHERE pos % 5 NOT IN (1, 3)
        UNION ALL SELECT doc, full_text, pos, 0, NULL, term, false FROM headed WHERE pos % 5 = 1
        UNION ALL SELECT doc, full_text, pos, 0, {S.strip('left(paragraph, 30)')}, NULL, true FROM headed WHERE pos % 5 = 3
        UNION ALL SELECT doc, full_text, pos, 1, {S.strip('paragraph')}, term, true FROM headed WHERE pos % 5 = 3),
    carried AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos, segment) AS season FROM pieces),
    parts AS (SELECT doc, full_text, pos, segment, text AS paragraph, season FROM carried WHERE text IS NOT NULL AND (NOT cut OR length(text) > 20))"""


@query(f"WITH {_HEADED} SELECT doc, pos, segment, paragraph, season FROM parts")
def split_headings(spark, sf_dir):
    return segment.in_rows(_with_headings(spark, sf_dir), "doc", items="parts")


@query(f"""WITH {_HEADED} SELECT row_number() OVER (ORDER BY doc, pos, segment) AS id, string_split(doc, '_')[1] AS title, replace(paragraph, chr(10), '  ') AS context,
    coalesce(season, {S.season_of('paragraph', 'full_text', LATIN.terms)}) AS season FROM parts""")
def number_paragraphs(spark, sf_dir):
    rows = _with_headings(spark, sf_dir)
    return segment.number_paragraphs(rows.select("doc", segment.with_seasons(F.col("parts"), F.col("full_text"), LATIN).alias("parts")))


_AS_PARAGRAPHS = "SELECT replace(source, 'src', 'title') AS title FROM documents"


@query(f"SELECT count(DISTINCT title) AS titles, count(*) AS paragraphs, count(*) / count(DISTINCT title) AS avg_per_title FROM ({_AS_PARAGRAPHS})")
def paragraph_stats(spark, sf_dir):
    return segment.paragraph_stats(_docs(spark, sf_dir).select(F.replace("source", F.lit("src"), F.lit("title")).alias("title")))


@query("SELECT row_number() OVER (ORDER BY source || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS id, source AS title, text AS context, lang AS season FROM documents")
def number_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("doc"), F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("segment"), F.col("text").alias("context"), F.col("lang").alias("season"))).alias("parts"))
    return segment.number_paragraphs(rows)


# --- layout ------------------------------------------------------------------------

_COLUMNS = """, gaps AS (SELECT doc, page, x0, page_width, lead(x0) OVER (PARTITION BY doc, page ORDER BY x0) - x0 AS gap FROM char_boxes),
    wide AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY gap DESC, x0) AS n FROM gaps WHERE gap > page_width * 0.05),
    dividers AS (SELECT doc, page, list_sort(list(x0 + gap / 2)) AS dividers FROM wide WHERE n <= 2 GROUP BY doc, page),
    pages_of AS (SELECT doc, page, coalesce(dividers, []) AS dividers FROM (SELECT DISTINCT doc, page FROM char_boxes) LEFT JOIN dividers USING (doc, page))"""


@query(f"{cte('char_boxes')} {_COLUMNS} SELECT doc, page, array_to_string(dividers, '|') AS dividers FROM pages_of")
def detect_columns(spark, sf_dir):
    found = layout.detect_columns(char_pages(spark, sf_dir, "x0"))
    return found.select("doc", "page", F.array_join(F.transform("dividers", lambda d: d.cast("string")), "|").alias("dividers"))


@query(
    f"""{cte('char_boxes')} {_COLUMNS}, placed AS (SELECT doc, page, len(list_filter(dividers, lambda d: d <= x0)) AS col, round_even(top / 5, 0) * 5 AS line, x0, pos, text FROM char_boxes JOIN pages_of USING (doc, page)),
    lines AS (SELECT doc, page, col, line, string_agg(text, '' ORDER BY x0, pos) AS text FROM placed GROUP BY ALL),
    whole AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY col, line) AS text FROM lines GROUP BY doc, page)
    SELECT doc, string_agg(text, chr(10) ORDER BY page) AS text FROM whole GROUP BY doc"""
)
def reconstruct_lines(spark, sf_dir):
    return layout.reconstruct_lines(char_pages(spark, sf_dir, "x0", "pos", "top", "text"))


# --- pages -------------------------------------------------------------------------

_PAGES = "SELECT page_id AS pos, CASE WHEN page_id % 9 = 0 THEN 'ftp://x' WHEN page_id % 5 = 0 THEN regexp_replace(url, '[0-9]+', '') ELSE url END AS url, html FROM pages"


def _pages(spark, sf_dir) -> DataFrame:
    url = F.when(F.col("page_id") % 9 == 0, "ftp://x").when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^([^0-9]*)[0-9]+", "$1")).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("pos"), url.alias("url"), "html")


@query(f"SELECT url, min(pos) AS pos FROM ({_PAGES}) WHERE starts_with(url, 'http') GROUP BY url")
def filter_urls(spark, sf_dir):
    return pages.filter_urls(_pages(spark, sf_dir).select("pos", "url"))


@query()
def pages_to_articles(spark, sf_dir):
    return pages.pages_to_articles(_pages(spark, sf_dir))


# --- dictionaries and mentions -----------------------------------------------------


def _responses(spark, sf_dir) -> DataFrame:
    rows = frame(spark, sf_dir, "entity_rows")
    return rows.select(F.col("pos").alias("doc_pos"), F.array(F.struct("name", "label")).alias("entities"))


_BUILT = f"""{cte('entity_rows')}, kept AS (SELECT {S.strip('name')} AS name, {S.strip('label')} AS label, pos FROM entity_rows),
    built AS (SELECT name, arg_min(label, pos) AS label FROM kept WHERE name <> '' AND label <> '' AND (length(name) >= 2 OR name IN ({S.listed(C.SHORT_DICTIONARY_NAMES)})) GROUP BY name)"""


@query(f"{_BUILT} SELECT name, label FROM built")
def build_entity_dictionary(spark, sf_dir):
    return mentions.build_entity_dictionary(_responses(spark, sf_dir))


@query(f"{_BUILT} SELECT name, label FROM built WHERE length(name) % 2 = 0")
def append_entities(spark, sf_dir):
    built = build_entity_dictionary(spark, sf_dir)
    return mentions.append_entities(built.filter(F.length("name") % 2 == 1), _responses(spark, sf_dir))


@query(f"{cte('entity_rows')} SELECT {S.strip('name')} AS name, arg_max({S.strip('label')}, pos) AS label, min(pos) AS pos FROM entity_rows WHERE {S.strip('name')} <> '' GROUP BY 1")
def load_entity_map(spark, sf_dir):
    return mentions.load_entity_map(frame(spark, sf_dir, "entity_rows"))


@query(f"{cte('entity_rows')} SELECT {S.strip('name')} AS name, coalesce(nullif(arg_min({S.strip('label')}, pos), ''), 'Other') AS label, min(pos) AS pos FROM entity_rows WHERE {S.strip('name')} <> '' GROUP BY 1")
def load_lexicon(spark, sf_dir):
    return mentions.load_lexicon(frame(spark, sf_dir, "entity_rows"))


@query(f"{cte('relations')} SELECT DISTINCT {S.strip('type')} AS type FROM relations WHERE {S.strip('type')} <> ''")
def relation_types(spark, sf_dir):
    return mentions.relation_types(frame(spark, sf_dir, "relations"))


_DICTIONARY = """words AS (SELECT item_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM benchmark),
    dictionary AS (SELECT name, min(pos) AS pos, 'L' || CAST(length(name) % 3 AS VARCHAR) AS label FROM (SELECT item_id * 100000 + i AS pos, w[i] AS name FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) WHERE length(name) >= 4 GROUP BY name)"""


def _dictionary(spark, sf_dir) -> DataFrame:
    words = F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(words).alias("i", "name")).filter(F.length("name") >= 4)
    rows = rows.groupBy("name").agg(F.min(F.col("item_id") * 100000 + F.col("i") + 1).alias("pos"), F.countDistinct("item_id").alias("items"))
    return rows.select("name", F.concat(F.lit("L"), (F.length("name") % 3).cast("string")).alias("label"), "pos", "items")


def _contexts(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("season"), F.col("text").alias("context"))


def _entities_flat(df: DataFrame) -> DataFrame:
    return df.withColumn("entities", F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["label"])), "|"))


_LINKED = f"""WITH {_DICTIONARY}, found AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '未知' END AS season, instr(text, name) AS start, name, label, pos FROM documents, dictionary WHERE contains(text, name))
    SELECT id, season, string_agg(name || ':' || label, '|' ORDER BY start, -length(name), pos) AS entities FROM found GROUP BY id, season"""


@query(_LINKED)
def link_mentions(spark, sf_dir):
    return _entities_flat(mentions.link_mentions(_contexts(spark, sf_dir), _dictionary(spark, sf_dir), "automaton", block_chars=4000)).drop("context")


# the SQL of the names' method is for few names: here words of a twentieth of the items
_COMMON = """dictionary AS (SELECT * FROM every WHERE items * 20 >= (SELECT count(*) FROM benchmark))"""


@query(_LINKED.replace("dictionary AS", "every AS", 1).replace(", found AS", f", {_COMMON}, found AS", 1).replace("SELECT name, min(pos) AS pos,", "SELECT name, min(pos) AS pos, count(DISTINCT pos // 100000) AS items,", 1))
def link_mentions_by_name(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    common = _dictionary(spark, sf_dir).filter(F.col("items") * 20 >= items)
    return _entities_flat(mentions.link_mentions(_contexts(spark, sf_dir), common, "names")).drop("context")


# --- extraction --------------------------------------------------------------------


def _linked(spark, sf_dir) -> DataFrame:
    """Mentions in the order in which names occur, from the reply turns' words."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'")
    words = F.array_distinct(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " +"))
    entities = F.transform(words, lambda w: F.struct(w.alias("name"), F.concat(F.lit("L"), (F.length(w) % 3).cast("string")).alias("label")))
    season = F.when(F.col("conv_id") % 2 == 0, F.get(words, F.lit(3))).otherwise(F.lit(C.UNKNOWN_SEASON))
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce(season, F.lit(C.UNKNOWN_SEASON)).alias("season"), F.col("text").alias("context"), entities.alias("entities"))


_MENTIONED = """WITH rows AS (SELECT conv_id * 100 + turn AS id, conv_id, text AS context, string_split_regex(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +') AS s FROM conversations WHERE role = 'assistant'),
    uniq AS (SELECT id, conv_id, context, list_filter(s, lambda x, i: list_position(s, x) = i) AS w FROM rows),
    seasons AS (SELECT *, CASE WHEN conv_id % 2 = 0 AND len(w) >= 4 THEN w[4] ELSE '未知' END AS season FROM uniq),
    moved AS (SELECT *, CASE WHEN season <> '未知' THEN list_concat([season], list_filter(w, lambda x: x <> season)) ELSE w END AS m FROM seasons WHERE len(w) >= 2 AND length(context) >= 5),
    picked AS (SELECT id, season, context, CASE WHEN len(m) > 60 THEN list_transform(list_sort(list_transform(m, lambda x, i: {'s': -length(x), 'i': i, 'x': x}))[1:60], lambda k: k.x) ELSE m END AS c FROM moved)"""


@query(f"""{_MENTIONED} SELECT id, season, array_to_string(list_transform(c, lambda x: '- ' || x || ' (L' || CAST(length(x) % 3 AS VARCHAR) || ')'), chr(10)) AS candidates_text, substr(context, 1, 1500) AS context FROM picked""")
def prepare_requests(spark, sf_dir):
    return extraction.prepare_requests(_linked(spark, sf_dir)).drop("candidates")


def _answer(candidates: pd.Series, contexts: pd.Series) -> pd.Series:
    """A stand-in for a model: a fenced list of triples from the first candidates, with
    items that a reader has to refuse."""

    def one(text: str, context: str) -> str:
        names = [x[2:].rpartition(" (")[0] for x in text.split("\n")]
        kinds = ["宜食", "属于", "包含", "导致"]
        triples = [[names[i], kinds[(i + len(context)) % 4], names[(i * 3 + 1) % len(names)]] for i in range(min(6, len(names)))]
        triples += [[names[0], "宜食", "nowhere"], [names[0], "宜食"], ["养生", "包含", names[-1]]]
        return f"Here:\n```json\n{json.dumps(triples, ensure_ascii=False)}\n```\nDone."

    return pd.Series([one(a, b) for a, b in zip(candidates, contexts)])


def _answered(spark, sf_dir) -> DataFrame:
    return extraction.apply_extractor(extraction.prepare_requests(_linked(spark, sf_dir)), _answer)


@query()
def apply_extractor(spark, sf_dir):
    return _answered(spark, sf_dir).select("id", "response")


_TRIPLES = f"""{_MENTIONED}, triples AS (
        SELECT id, season, c, i - 1 AS pos, c[i] AS head, (['宜食', '属于', '包含', '导致'])[CAST((i - 1 + length(substr(context, 1, 1500))) % 4 + 1 AS INT)] AS type, c[CAST(((i - 1) * 3 + 1) % len(c) + 1 AS INT)] AS tail
        FROM picked, unnest(range(1, 7)) AS r(i) WHERE i <= len(c)
    ), valid AS (SELECT id, season, head, type, tail, pos FROM triples WHERE head <> tail)"""


def _validated(spark, sf_dir) -> DataFrame:
    rows = _answered(spark, sf_dir).withColumn("relations", extraction.listed_relations(extraction.parse_response_list(F.col("response"))))
    return extraction.validate_relations(rows)


@query(f"{_TRIPLES} SELECT id, season, head, type, tail FROM valid")
def validate_relations(spark, sf_dir):
    return _validated(spark, sf_dir).drop("pos")


@query(f"{_TRIPLES} SELECT DISTINCT head AS source, tail AS target, type, season FROM valid")
def dedupe_relations(spark, sf_dir):
    return extraction.dedupe_relations(extraction.drop_generic_relations(_validated(spark, sf_dir))).select("source", "target", "type", "season")


@query(f"{_TRIPLES} SELECT DISTINCT head AS source, tail AS target, type, season FROM valid WHERE (head, tail, type, season) NOT IN (SELECT (head, tail, type, season) FROM valid WHERE id % 3 = 0)")
def append_relations(spark, sf_dir):
    rows = _validated(spark, sf_dir)
    old = extraction.dedupe_relations(rows.filter("id % 3 = 0"))
    return extraction.append_relations(old, rows).select("source", "target", "type", "season")


_SAID = r"""said AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS l FROM documents),
    w AS (SELECT doc_id, t, coalesce(l[1], '') AS a, coalesce(l[2], '') AS b, coalesce(l[3], '') AS c FROM said)"""


@query(
    f"""WITH {_SAID} SELECT doc_id, CASE WHEN doc_id % 6 IN (3, 4) THEN '' ELSE a || '|' || b END AS entities,
    CASE doc_id % 6 WHEN 0 THEN a || '>宜>' || b WHEN 1 THEN a || '>属于>' || c WHEN 2 THEN a || '>x>' || b || '>' || t WHEN 5 THEN c || '>p>q|' || b || '>忌>' || a ELSE '' END AS relations,
    CASE WHEN doc_id % 6 IN (3, 4) THEN '' ELSE a || ':k:' || t END AS attributes FROM w"""
)
def normalize_extraction(spark, sf_dir):
    """Responses with the words and the whole text of each document: bare, fenced and in
    prose; lists, broken ones; relations of two, three and more items and as text."""
    docs = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = docs.withColumn("l", F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0)))
    a, b, c = (F.coalesce(F.get("l", F.lit(i)), F.lit("")) for i in range(3))
    listed = lambda *items: F.to_json(F.array(*items))
    text = lambda *parts: F.substring(F.to_json(F.array(F.concat(*parts))), 2, 1 << 30)  # noqa: E731  with the bracket that closes
    lit = F.lit
    relations = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(lit("["), listed(a, lit("宜"), b), lit(", "), listed(a, b), lit(", 5]")))
        .when(F.col("doc_id") % 6 == 1, F.concat(lit('["one", '), text(a, lit(", 属于，"), b, lit("- "), c)))
        .when(F.col("doc_id") % 6 == 2, F.concat(lit("["), listed(a, lit("x"), b, F.col("t")), lit("]")))
        .otherwise(F.concat(lit("["), listed(c, lit("p"), lit("q")), lit(", "), text(b, lit("-忌，"), a)))
    )
    attributes = F.to_json(F.array(F.struct(a.alias("entity"), lit("k").alias("attribute"), F.col("t").alias("value"))))
    whole = F.concat(lit('{"entities": '), listed(a, b), lit(', "relations": '), relations, lit(', "attributes": '), attributes, lit("}"))
    said = (
        F.when(F.col("doc_id") % 6 == 1, F.concat(lit("Answer: ```json\n"), whole, lit("\n``` end")))
        .when(F.col("doc_id") % 6 == 2, F.concat(lit("so "), whole, lit(" it is")))
        .when(F.col("doc_id") % 6 == 3, F.concat(lit("["), whole, lit("]")))
        .when(F.col("doc_id") % 6 == 4, F.substring(whole, 2, 1 << 30))
        .otherwise(whole)
    )
    out = found.select("doc_id", extraction.normalize_extraction(extraction.parse_response_object(said)).alias("n"))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return out.select(
        "doc_id",
        F.array_join("n.entities", "|").alias("entities"),
        joined("n.relations", lambda r: F.array_join(r, ">")).alias("relations"),
        joined("n.attributes", lambda x: F.concat_ws(":", x["entity"], x["attribute"], x["value"])).alias("attributes"),
    )
