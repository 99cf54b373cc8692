"""DuckDB forms of the column functions, for the queries' SQL. Word lists and regular
expressions are shared with Spark; the rules are stated again."""

from __future__ import annotations

from ..functions import config as C
from ..functions import text as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(q, words))


def replaced(x: str, steps) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return x


def strip(x: str) -> str:
    return replaced(f"coalesce({x}, '')", ((X.STRIP, ""),))


def holds(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")" if words else "false"


def first_in(x: str, words) -> str:
    return "(CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " END)"


def clean_string(x: str) -> str:
    return replaced(strip(x), ((X.NAME_EDGES, ""),))


def sanitize_name(x: str) -> str:
    return strip(f"replace(replace(coalesce({x}, ''), '《', ''), '》', '')")


def validate_entity(n: str) -> str:
    return f"""(CASE WHEN {n} = '' THEN 'empty' WHEN length({n}) < 2 AND NOT contains({q(C.SHORT_NAMES)}, {n}) THEN 'entity_too_short'
        WHEN {n} IN ({listed(C.BLACKLIST)}) THEN 'entity_blacklist' WHEN {holds(n, chr(92) + 'A[0-9' + chr(92) * 2 + '.]+' + chr(92) + 'z')} THEN 'entity_numeric'
        WHEN contains({n}, 'http') OR contains({n}, 'www') THEN 'entity_url' ELSE 'passed' END)"""


def infer_season(season: str, head: str, tail: str) -> str:
    s = clean_string(season)
    return f"coalesce(nullif(nullif({s}, ''), '未知'), {first_in(head, C.TERMS)}, {first_in(tail, C.TERMS)}, '未知')"


def safe_type(x: str) -> str:
    return replaced(x, ((r"[^\p{L}\p{N}_]", "_"),))


def infer_label(name: str, relation: str, subject: str) -> str:
    n = sanitize_name(name)
    person = f"({holds(n, chr(92) + 'A[一-龥]{2,4}' + chr(92) + 'z')} AND contains({q(C.SURNAMES)}, left({n}, 1)) AND NOT {any_of(n, C.NO_PERSON_WORDS)})"
    return f"""(CASE WHEN {n} = '' THEN 'Entity'
        WHEN {relation} IN ({listed(C.CREATION_RELATIONS)}) THEN CASE WHEN {subject} THEN 'Technique' ELSE 'Person' END
        WHEN {relation} IN ({listed(C.PERSON_RELATIONS)}) AND {subject} THEN 'Person'
        WHEN {relation} IN ({listed(C.SOURCE_RELATIONS)}) OR {any_of(relation, C.SOURCE_WORDS)} THEN 'Source'
        WHEN {any_of(n, (*C.TERMS, '节气'))} OR ends_with({n}, '时节') THEN 'SolarTerm'
        WHEN {any_of(n, C.SEASON_WORDS)} THEN 'Season' WHEN {any_of(n, C.TECHNIQUE_WORDS)} THEN 'Technique' WHEN {any_of(n, C.DISEASE_WORDS)} THEN 'Disease'
        WHEN {any_of(n, C.BODY_WORDS)} THEN 'BodyPart' WHEN {any_of(n, C.FOOD_WORDS)} THEN 'Food' WHEN {any_of(n, C.SOURCE_WORDS)} THEN 'Source'
        WHEN {any_of(n, C.ORGANISATION_WORDS)} THEN 'Organization' WHEN {any_of(n, C.LOCATION_WORDS)} THEN 'Location' WHEN {person} THEN 'Person' ELSE 'Entity' END)"""


def clean_paragraph(x: str, raw: bool = False) -> str:
    return replaced(f"coalesce({x}, '')", X.paragraph_steps(raw=raw))


def skip_line(x: str, cfg: C.TextConfig, raw: bool = False) -> str:
    out = f"(length({x}) < 5 OR {holds(x, X.skip_patterns(cfg, raw))}"
    return out + ")" if raw else f"{out} OR NOT {holds(x, cfg.script)})"


def valid(x: str, cfg: C.TextConfig) -> str:
    return f"(length({x}) >= {cfg.min_chars} AND len(regexp_extract_all({x}, {q(cfg.script)})) >= {cfg.min_script})"


def filter_sections(x: str, cfg: C.TextConfig, raw: bool = False) -> str:
    """Line by line: what comes before the first reference line, isn't in an abstract
    and isn't skipped, from a list of lines."""
    return f"""(SELECT coalesce(string_agg(l, chr(10) ORDER BY i), '') FROM (
        SELECT i, l, coalesce(max(CASE WHEN mark THEN i END) OVER (ORDER BY i), 0) AS marked,
               coalesce(max(CASE WHEN l = '' THEN i END) OVER (ORDER BY i), 0) AS blank, max(CASE WHEN ref THEN 1 ELSE 0 END) OVER (ORDER BY i) AS cut
        FROM (SELECT i, l, {any_of('lower(l)', cfg.abstract_marks)} AS mark, {any_of('lower(l)', cfg.reference_marks)} AS ref
              FROM (SELECT i, {strip('s[i]')} AS l FROM (SELECT string_split({x}, chr(10)) AS s), unnest(range(1, len(s) + 1)) AS r(i))))
        WHERE cut = 0 AND marked <= blank AND l <> '' AND NOT {skip_line('l', cfg, raw)})"""


def kept(x: str, cfg: C.TextConfig) -> str:
    return f"({valid(x, cfg)} AND {any_of(x, cfg.relevant_words)})"


_START = "{'now': '', 'out': CAST([] AS VARCHAR[])}"


def _flushed(state: str, cfg: C.TextConfig) -> str:
    return f"CASE WHEN {kept(state + '.now', cfg)} THEN list_append({state}.out, {state}.now) ELSE {state}.out END"


def chunks(x: str, cfg: C.TextConfig, raw: bool = False) -> str:
    """A list of chunks, folded sentence by sentence."""
    step = f"""CASE WHEN length(a.now || s) < {cfg.target} THEN {{'now': a.now || s, 'out': a.out}}
        ELSE {{'now': '', 'out': CASE WHEN {kept('(a.now || s)', cfg)} THEN list_append(a.out, a.now || s) ELSE a.out END}} END"""
    sentences = f"list_filter(list_transform(string_split_regex({clean_paragraph(x, raw)}, {q(cfg.sentence_marks)}), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"(SELECT {_flushed('f', cfg)} FROM (SELECT list_reduce({sentences}, lambda a, s: {step}, {_START}) AS f))"


def paragraphs(x: str, cfg: C.TextConfig, raw: bool = False) -> str:
    """A list of paragraphs, folded block by block, or else of chunks."""
    joins = f"a.now <> '' AND (length(b) < 100 OR NOT contains({q(cfg.closing_marks)}, right(a.now, 1)))"
    step = f"CASE WHEN {joins} THEN {{'now': a.now || b, 'out': a.out}} ELSE {{'now': b, 'out': {_flushed('a', cfg)}}} END"
    blocks = f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10) || chr(10)), lambda b: {clean_paragraph(strip('b'), raw)}), lambda b: b <> '')"
    return f"(SELECT CASE WHEN len(l) < 3 THEN {chunks(x, cfg, raw)} ELSE l END FROM (SELECT {_flushed('f', cfg)} AS l FROM (SELECT list_reduce({blocks}, lambda a, b: {step}, {_START}) AS f)))"


def season_of(paragraph: str, text: str, terms) -> str:
    """The first term of the paragraph, else of the nearest short line before it."""
    return f"""coalesce({first_in(paragraph, terms)},
        (SELECT t FROM (SELECT i, CASE WHEN length(b[i]) < 100 THEN {first_in('b[i]', terms)} END AS t
            FROM (SELECT string_split(substr({text}, greatest(p - 500, 1), p - greatest(p - 500, 1)), chr(10)) AS b FROM (SELECT instr({text}, left({paragraph}, 50)) AS p) WHERE p > 1), unnest(range(1, len(b) + 1)) AS r(i))
            WHERE t IS NOT NULL ORDER BY i DESC LIMIT 1), {q(C.UNKNOWN_SEASON)})"""
