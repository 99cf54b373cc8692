"""Queries of single column functions and of composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..operators import cleaning, extraction, layout, pages, qa, segment
from . import catalog as K
from . import catalog_qa as Q
from . import catalog_text as T
from . import pipelines
from . import sql as S
from .catalog import query
from .fixtures import char_pages, cte, frame

_REL = cte("relations")


def _rows(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, "relations")


@query(f"{_REL} SELECT row_no, {S.sanitize_name('source')} AS name FROM relations")
def sanitize_name(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", X.sanitize_name(F.col("source")).alias("name"))


@query(f"{_REL} SELECT row_no, {S.clean_string('source')} AS name FROM relations")
def clean_string(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", X.clean_string(F.col("source")).alias("name"))


@query(f"{_REL} SELECT row_no, {S.safe_type('type')} AS rel_type FROM relations")
def safe_type(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", X.safe_type(F.col("type")).alias("rel_type"))


@query(f"{_REL} SELECT row_no, {S.any_of('source', (*C.TERMS, '节气'))} OR ends_with(source, '时节') AS is_term FROM relations")
def is_solar_term(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", X.is_solar_term(F.col("source")).alias("is_term"))


@query(f"""{_REL} SELECT row_no, regexp_matches(source, '\\A[一-龥]{{2,4}}\\z') AND contains({S.q(C.SURNAMES)}, left(source, 1)) AND NOT {S.any_of('source', C.NO_PERSON_WORDS)} AS is_person FROM relations""")
def is_probable_person(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", X.is_probable_person(F.col("source")).alias("is_person"))


@query(f"SELECT doc_id, {S.any_of(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', C.LATIN.relevant_words)} AS relevant FROM documents")
def relevant(spark, sf_dir):
    return T._docs(spark, sf_dir).select("doc_id", X.relevant(F.col("text"), C.LATIN).alias("relevant"))


@query(f"{cte('char_boxes')} {T._COLUMNS} SELECT doc, page, pos, CAST(len(list_filter(dividers, lambda d: d <= x0)) AS INTEGER) AS col FROM char_boxes JOIN pages_of USING (doc, page)")
def assign_column(spark, sf_dir):
    return layout.assign_columns(char_pages(spark, sf_dir, "x0", "pos"))


@query()
def html_main_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", pages.html_main_text(F.col("html")).alias("content"))


@query(f"WITH {T._BODIES} SELECT doc, pos, 0 AS segment, replace(paragraph, chr(10), '  ') AS context, {S.season_of('paragraph', 'full_text', C.LATIN.terms)} AS season FROM paragraphs")
def with_seasons(spark, sf_dir):
    return segment.paragraphs_of(T._named(spark, sf_dir), C.LATIN, raw=True)


_ITEMS = "rows AS (SELECT conv_id * 100 + turn AS id, list_distinct(string_split_regex(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +')) AS w FROM conversations WHERE role = 'assistant')"


def _named_entities(spark, sf_dir) -> DataFrame:
    rows = T._linked(spark, sf_dir)
    return rows.select("id", "season", "entities")


def _names(column: str | F.Column) -> F.Column:
    return F.array_join(F.transform(column, lambda e: e["name"]), "|").alias("names")


_MOVED = T._MENTIONED.replace("WHERE len(w) >= 2 AND length(context) >= 5", "")


@query(f"{_MOVED} SELECT id, array_to_string(m, '|') AS names FROM moved")
def promote_season_entity(spark, sf_dir):
    return _named_entities(spark, sf_dir).select("id", _names(extraction.promote_season_entity(F.col("entities"), F.col("season"))))


@query(f"""{_MOVED} SELECT id, array_to_string(CASE WHEN len(w) > 60 THEN list_transform(list_sort(list_transform(w, lambda x, i: {{'s': -length(x), 'i': i, 'x': x}}))[1:60], lambda k: k.x)
    WHEN len(w) < 2 THEN [] ELSE w END, '|') AS names FROM moved""")
def select_candidates(spark, sf_dir):
    return _named_entities(spark, sf_dir).select("id", _names(extraction.select_candidates(F.col("entities"))))


@query(f"""{T._TRIPLES} SELECT id, season, head, type, tail FROM valid WHERE NOT (type = '属于' AND tail = '养生') AND NOT (head IN ({S.listed(C.GENERIC_HEADS)}) AND type IN ({S.listed(C.GENERIC_TYPES)}))""")
def drop_generic_relations(spark, sf_dir):
    return extraction.drop_generic_relations(T._validated(spark, sf_dir)).drop("pos")


_FENCE = "```"
#: Kinds of responses, with @ for a text of the row.
_RESPONSES = ('{"a": "@"}', f'x {_FENCE}json\n{{"b": ["@"]}}\n{_FENCE}', 'say {"c": "}@"} so', '["@", 2]', "nothing @", f'{_FENCE}json\n[["@", "r", "b"]]\n{_FENCE}', f'{_FENCE}\n[]\n{_FENCE}@')
_OBJECTS = ('{"a": "@"}', '{"b": ["@"]}', '{"c": "}@"}', "", "", "", "")
_LISTS = ("[]", "[]", "[]", '["@", 2]', "[]", '[["@", "r", "b"]]', "[]")


def _responses(spark, sf_dir) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _RESPONSES)), (F.col("row_no") % 7 + 1).cast("int"))
    return _rows(spark, sf_dir).select("row_no", F.replace(text, F.lit("@"), F.col("source")).alias("response"))


def _case(values) -> str:
    return f"replace(([{S.listed(values)}])[CAST(row_no % 7 + 1 AS INT)], '@', source)"


@query(f"{_REL} SELECT row_no, {_case(_OBJECTS)} AS parsed FROM relations")
def parse_response_object(spark, sf_dir):
    return _responses(spark, sf_dir).select("row_no", F.coalesce(extraction.parse_response_object(F.col("response")), F.lit("")).alias("parsed"))


@query(f"{_REL} SELECT row_no, {_case(_LISTS)} AS parsed FROM relations")
def parse_response_list(spark, sf_dir):
    return _responses(spark, sf_dir).select("row_no", X.strip(extraction.parse_response_list(F.col("response"))).alias("parsed"))


def _planned(spark, sf_dir) -> DataFrame:
    return qa.plan_query(qa.link_question(frame(spark, sf_dir, "questions"), Q._lexicon(spark, sf_dir)))


@query(f"{Q._PLANNED} SELECT question_id, intent FROM planned")
def classify_intent(spark, sf_dir):
    return _planned(spark, sf_dir).select("question_id", "intent")


_WORDS = " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in C.INTENT_WORDS.items())


@query(f"{Q._PLANNED} SELECT question_id, CASE intent {_WORDS} ELSE '{'|'.join(C.OTHER_INTENT_WORDS)}' END AS keywords FROM planned")
def intent_keywords(spark, sf_dir):
    return _planned(spark, sf_dir).select("question_id", F.array_join("keywords", "|").alias("keywords"))


@query(f"{Q._PLANNED} SELECT question_id, season FROM planned")
def pick_season(spark, sf_dir):
    return _planned(spark, sf_dir).select("question_id", "season")


def _job(spark, sf_dir):
    return pipelines.clean_graph(K._mentions(spark, sf_dir), _rows(spark, sf_dir))


_ALL_KNOWN = K._JUDGED.replace("SELECT name FROM clean WHERE length(name) % 4 <> 3", "SELECT name FROM clean")


@query(f"""{_ALL_KNOWN} SELECT source, target, type, season, min(row_no) AS row_no FROM (SELECT source, target, type, {S.infer_season('season', 'source', 'target')} AS season, row_no FROM decided WHERE category IS NULL) GROUP BY ALL""")
def clean_graph_job(spark, sf_dir):
    return _job(spark, sf_dir)[1]


@query(f"""{_ALL_KNOWN}, every AS (SELECT category FROM decided WHERE category IS NOT NULL UNION ALL SELECT 'reject_node_' || reason FROM judged WHERE reason <> 'passed')
    SELECT category, count(*) AS n FROM every GROUP BY category""")
def clean_graph_rejects(spark, sf_dir):
    return cleaning.reject_report(_job(spark, sf_dir)[2].drop("reason")).groupBy("category").agg(F.sum("n").alias("n"))
