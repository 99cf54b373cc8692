"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, media, mixing, preference, repair, secrets, simhash, toxicity, urlglobs, warc, weighted
from .common import table, written


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = media.rendered(table(spark, sf_dir, "embeddings"))
    return media.copies(pictures)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = langid.training_rows(docs)
    model = langid.train(docs.filter(learn))
    return langid.identify(docs.drop("lang"), model).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", langid.span_list(F.col("lang_spans")).alias("lang_spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = toxicity.training_rows(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(learn)
    lexicon = toxicity.train(docs.filter(learn), labels)
    return toxicity.score(docs, lexicon).select("doc_id", (~learn).alias("held_out"), "score", "predicted")


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.turn_arrays(table(spark, sf_dir, "conversations"))
    out = preference.format_pairs(preference.echo_pairs(turns))
    return out.withColumns({c: preference.span_list(F.col(c)) for c in ("chosen_loss", "rejected_loss")})


def op9_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlglobs.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.digest(simhash.near_duplicates(docs))

def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.scored(written(alignment.align(docs, keep_groups=False), "aligned"))

def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damaged(conversations)), conversations)

def op13_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    """DuckDB: a list of the rule's spans in the text t, from the lengths of matches and
    of what parts them."""
    regex = rule.regex.replace("'", "''")
    measured = "m[i]" if rule.group == 0 else f"regexp_extract(m[i], '{regex}', {rule.group})"
    return f"""(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
            'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
            'rank': {rank}, 'n': length(m[i]), 'g': length({measured}), 'kind': '{rule.kind}'}}), lambda s: s.g >= {rule.min_length})
        FROM (SELECT regexp_extract_all(t, '{regex}') AS m, string_split_regex(t, '{regex}') AS p))"""


def _edit_sql(state: str, cost: str, letter: str, line: str = "''") -> str:
    """DuckDB: a state after one more edit."""
    return f"{{'c': {state}.c + {cost}, 'p': {state}.p || '{letter}', 'l': {state}.l || {line}}}"


def _repair_sql() -> str:
    """The fold as a recursion over the rows of a conversation; e, s, u and a are its states,
    and insertions are tried before each row as well as at the end."""
    user, assistant = (f"chr(10) || '{r}:'" for r in (repair.USER, repair.ASSISTANT))
    stays, cost = "chr(10) || role || ':' || text", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    never = "{'c': 1000000000, 'p': '', 'l': ''}"

    def moved(own: str, before: str, letter: str, name: str) -> str:
        kept = f"CASE WHEN initial = '{letter}' THEN {_edit_sql(before, cost, 'K', stays)} ELSE {_edit_sql(before, f'3 + {cost}', 'R', f'{name} || text')} END"
        return f"CASE WHEN gone THEN {_edit_sql(own, '4', 'D')} ELSE least({_edit_sql(own, '4', 'D')}, {kept}) END"

    return rf"""
        WITH RECURSIVE crcs AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
        ), fates AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                                   lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) % 20 AS fate
            FROM conversations, crcs
        ), turns AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM fates WHERE fate <> 0
        ), placed AS (
            SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
            FROM turns
        ), told AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
                   (lag(initial) OVER w) || initial AS steps
            FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY n)
        ), edits AS (
            SELECT conv_id, n, role, text, initial, fault, fault IN ('blank', 'duplicate') AS gone FROM told
        ), counts AS (
            SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (steps NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM told GROUP BY conv_id
        ), fold(conv_id, n, e, s, u, a) AS (
            SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'p': '', 'l': ''}}, {never}, {never}, {never} FROM counts
            UNION ALL
            SELECT conv_id, n, {_edit_sql("e", "4", "D")},
                   CASE WHEN gone OR initial <> 's' THEN {_edit_sql("s", "4", "D")} ELSE least({_edit_sql("s", "4", "D")}, {_edit_sql("e", cost, "K", stays)}) END,
                   {moved("u1", "tu", "u", user)}, {moved("a1", "ta", "a", assistant)}
            FROM (
                SELECT *, least(e, s, a1) AS tu, u1 AS ta FROM (
                    SELECT *, least(a, {_edit_sql("u1", "3", "I", assistant)}) AS a1 FROM (
                        SELECT r.*, e, s, u, a, least(u, {", ".join(_edit_sql(x, "3", "I", user) for x in "esa")}) AS u1
                        FROM fold f JOIN edits r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.n = f.n + 1)))
        ), ended AS (
            SELECT f.conv_id, least(e, a, {_edit_sql("u", "3", "I", assistant)}) AS best FROM fold f JOIN counts k ON f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.n = k.n
        )
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.p, '') AS audit, sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i
        LEFT JOIN counts k ON i.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ended d ON i.conv_id IS NOT DISTINCT FROM d.conv_id
    """


_RULES = secrets.BASE_RULES + secrets.MORE_RULES
_LISTED = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.n)), ',')"

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_media": op2_media,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_mix": op5_mix,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_preference": op8_preference,
    "op9_url_globs": op9_url_globs,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_repair": op12_repair,
    "op13_weighted_fingerprints": op13_weighted_fingerprints,
}

ORACLES = {
    "op3_warc": """
        WITH payloads AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM payloads)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM kept
    """,
    "op4_secrets": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS (SELECT doc_id, list_sort(flatten([{", ".join(_spans_sql(r, i) for i, r in enumerate(_RULES))}])) AS spans FROM texts)
        SELECT doc_id,
               CAST(len(list_filter(spans, lambda s: s.kind = 'assign')) AS BIGINT) AS n_assign,
               CAST(len(list_filter(spans, lambda s: s.kind = 'access')) AS BIGINT) AS n_access,
               CAST(len(list_filter(spans, lambda s: s.kind = 'hex')) AS BIGINT) AS n_hex,
               sha256({_LISTED.format("list_filter(spans, lambda s: s.rank < 3)")}) AS base_sha256,
               {_LISTED.format("spans")} AS spans
        FROM found
    """,
    "op5_mix": r"""
        WITH sizes AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM documents
        ), totals AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM sizes GROUP BY source
        ), levels AS (
            SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
                       - coalesce(sum(source_size) OVER fill, 0) * CAST(2 AS DOUBLE))
                      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0) AS DOUBLE) AS level
            FROM totals
            WINDOW fill AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), goals AS (
            SELECT source, source_size, least(source_size * CAST(2 AS DOUBLE),
                   coalesce((SELECT max(level) FROM levels WHERE level * weight <= source_size * CAST(2 AS DOUBLE)) * weight, source_size * CAST(2 AS DOUBLE))) AS target
            FROM levels
        ), rests AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
        ), runs AS (
            SELECT doc_id, size, h, r.source_size, target, epochs, CAST(round(target - epochs * r.source_size) AS BIGINT) AS rest,
                   sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                   sum(size) OVER (PARTITION BY s.source, h) AS tie
            FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
        )
        SELECT doc_id, size, source_size, target, CAST(size * epochs + CASE
            WHEN upto <= rest THEN size
            WHEN upto - tie <= rest AND tie > 0 THEN size * (rest - upto + tie) // tie
            ELSE 0 END AS BIGINT) AS taken
        FROM runs
    """,
    "op8_preference": r"""
        WITH items AS (
            SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
            UNION ALL SELECT conv_id, [{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}] FROM conversations WHERE conv_id IS NULL
        ), placed AS (
            SELECT conv_id, l, list_max(list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant')) AS last FROM items
        ), parts AS (
            SELECT conv_id, l[1:last - 1] AS head, l[last].text AS reply, coalesce(l[last - 1].text, '') AS echo, last FROM placed WHERE last IS NOT NULL
        ), cut AS (
            SELECT *, CASE WHEN reply = echo OR (last = 1 AND reply = '') THEN last ELSE last - 1 END AS n FROM parts
        ), rendered AS (
            SELECT conv_id, n, last,
                   array_to_string(list_transform(head, lambda t: '<|im_start|>' || replace(t.role, '<|', '<\|') || chr(10) || replace(t.text, '<|', '<\|') || '<|im_end|>' || chr(10)), '') AS top,
                   '<|im_start|>assistant' || chr(10) || replace(reply, '<|', '<\|') || '<|im_end|>' || chr(10) AS a,
                   '<|im_start|>assistant' || chr(10) || replace(echo, '<|', '<\|') || '<|im_end|>' || chr(10) AS b
            FROM cut
        )
        SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns, CASE WHEN n = last THEN top || a ELSE top END AS prompt,
               CASE WHEN n = last THEN '' ELSE a END AS chosen, CASE WHEN n = last THEN '' ELSE b END AS rejected,
               CASE WHEN n = last THEN '' ELSE '22:' || length(a) END AS chosen_loss, CASE WHEN n = last THEN '' ELSE '22:' || length(b) END AS rejected_loss,
               n < last AS usable
        FROM rendered
    """,
    "op9_url_globs": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fits AS (
            SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
            FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id, host, path
        )
        SELECT page_id, host, path, rule, CASE
            WHEN v IS NOT NULL THEN v
            WHEN contains(host, 'spam') OR contains(host, 'casino') OR starts_with(host, 'ads-') THEN 'block'
            WHEN ends_with(path, '.exe') OR contains(path, '/tracking/') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM fits
    """,
    "op12_repair": _repair_sql(),
}
