"""Column functions on texts and names. Lists of words are parameters; regular
expressions are written to mean the same to Java and to RE2."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config as C

#: The white space that Unicode strips, as the inside of a class.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"\A[{WS}]+|[{WS}]+\z"

_BRACKETED = r"[\[［【〔][%s]*\p{Nd}+[^\]］】〕]*[\]］】〕]" % WS
#: Replacements of paragraph cleaning, in order: always, and unless the text is kept raw.
PARAGRAPH_STEPS = (
    (_BRACKETED, ""),
    (r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", ""),
    ("~", ""),
    ('""', ""),
    ("''", ""),
    (f'"[{WS}]+"', ""),
    (f"'[{WS}]+'", ""),
)
LETTER_STEPS = (
    (r"[A-Za-z\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]+", ""),
    (r"[0-9\x{ff10}-\x{ff19}]+", ""),
    (r"[\[\]\(\)（）【】［］〈〉<>{}]", ""),
)
EXTRACT_STEPS = ((r"[,，:：、.\\-]{2,}", " "), (f"[{WS}]+", " "))
NAME_EDGES = r"""\A["'《“‘]+|["'》”’。，]+\z"""


def _replaced(text: Column, steps) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def alternatives(words) -> str:
    """A regular expression for any of the words."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", w) for w in words)


def in_any_case(words) -> str:
    """The same in upper or lower case of ASCII letters."""
    spelt = (re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", alternatives([w])) for w in words)
    return "|".join(spelt)


def is_json(text: Column) -> Column:
    """True for one whole JSON value: what follows a value makes an array of it invalid,
    or longer. Null is none."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def contains_any(text: Column, words) -> Column:
    return text.rlike(alternatives(words)) if words else F.lit(False)


def first_in(text: Column, words) -> Column:
    """The first word of the list, in its order, that the text holds; else null."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0))


# --- paragraphs --------------------------------------------------------------------


def paragraph_steps(keep_spaces: bool = True, raw: bool = False) -> tuple:
    spaces = (("[ \\t]+", " "),) if keep_spaces else ((f"[{WS}]+", ""),)
    return PARAGRAPH_STEPS + (() if raw else LETTER_STEPS) + spaces + ((STRIP, ""),)


def clean_paragraph_text(text: Column, keep_spaces: bool = True, raw: bool = False) -> Column:
    """Drops bracketed citations, controls, tildes and empty quotes, unless raw also
    letters, digits and brackets; then joins spaces. Null is empty."""
    return _replaced(_or_empty(text), paragraph_steps(keep_spaces, raw))


def clean_extract_text(text: Column) -> Column:
    """Runs of punctuation and of white space become a space. Null is empty."""
    return _replaced(_or_empty(text), (*EXTRACT_STEPS, (STRIP, "")))


def skip_patterns(cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> str:
    """What marks a line as front matter."""
    return "|".join(
        [
            in_any_case([*cfg.skip_words, "doi"]),
            rf"\A[·{WS}]*\p{{Nd}}+[·{WS}]*\z",
            rf"第[{WS}]*\p{{Nd}}+[{WS}]*[卷期]",
            rf"\p{{Nd}}{{4}}[{WS}]*年[{WS}]*\p{{Nd}}{{1,2}}[{WS}]*月",
        ]
    )


def skip_line(line: Column, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> Column:
    """True for null and short lines, front matter, bare numbers, volume and date
    lines, and unless raw for lines without the script."""
    line = _or_empty(line)
    out = (F.length(line) < 5) | line.rlike(skip_patterns(cfg, raw))
    return out if raw else out | ~line.rlike(cfg.script)


def valid_paragraph(text: Column, cfg: C.TextConfig = C.TextConfig()) -> Column:
    text = _or_empty(text)
    return (F.length(text) >= cfg.min_chars) & (F.regexp_count(text, F.lit(cfg.script)) >= cfg.min_script)


def relevant(text: Column, cfg: C.TextConfig = C.TextConfig()) -> Column:
    return contains_any(_or_empty(text), cfg.relevant_words)


def normalize_title(filename: Column) -> Column:
    return F.substring_index(F.replace(filename, F.lit(".pdf"), F.lit("")), "_", 1)


def detect_season(paragraph: Column, full_text: Column, cfg: C.TextConfig = C.TextConfig()) -> Column:
    """The first term in calendar order within the paragraph; else the term of the
    nearest short line among the 500 characters before it; else unknown."""
    at = F.call_function("instr", full_text, paragraph.substr(1, 50))
    start = F.greatest(at - 500, F.lit(1))
    before = F.when(at > 1, F.substring(full_text, start, at - start)).otherwise(F.lit(""))
    found = F.filter(
        F.transform(F.reverse(F.split(before, "\n")), lambda line: F.when(F.length(line) < 100, first_in(line, cfg.terms))),
        lambda t: t.isNotNull(),
    )
    return F.coalesce(first_in(paragraph, cfg.terms), F.get(found, F.lit(0)), F.lit(C.UNKNOWN_SEASON))


# --- names -------------------------------------------------------------------------


def sanitize_name(name: Column) -> Column:
    """Without title marks and outer white space. Null is empty."""
    return strip(F.translate(_or_empty(name), "《》", ""))


def is_solar_term(name: Column, terms=C.TERMS) -> Column:
    return contains_any(name, (*terms, "节气")) | name.endswith("时节")


def is_probable_person(name: Column, surnames: str = C.SURNAMES) -> Column:
    return name.rlike(r"\A[\x{4e00}-\x{9fa5}]{2,4}\z") & name.rlike(f"\\A[{surnames}]") & ~contains_any(name, C.NO_PERSON_WORDS)


def infer_label(name: Column, relation_type: Column, is_subject: Column, surnames: str = C.SURNAMES) -> Column:
    """A label from the relation and then from the name, in a fixed order of rules."""
    n, r = sanitize_name(name), _or_empty(relation_type)
    return (
        F.when(n == "", "Entity")
        .when(r.isin(*C.CREATION_RELATIONS), F.when(is_subject, "Technique").otherwise("Person"))
        .when(r.isin(*C.PERSON_RELATIONS) & is_subject, "Person")
        .when(r.isin(*C.SOURCE_RELATIONS) | contains_any(r, C.SOURCE_WORDS), "Source")
        .when(is_solar_term(n), "SolarTerm")
        .when(contains_any(n, C.SEASON_WORDS), "Season")
        .when(contains_any(n, C.TECHNIQUE_WORDS), "Technique")
        .when(contains_any(n, C.DISEASE_WORDS), "Disease")
        .when(contains_any(n, C.BODY_WORDS), "BodyPart")
        .when(contains_any(n, C.FOOD_WORDS), "Food")
        .when(contains_any(n, C.SOURCE_WORDS), "Source")
        .when(contains_any(n, C.ORGANISATION_WORDS), "Organization")
        .when(contains_any(n, C.LOCATION_WORDS), "Location")
        .when(is_probable_person(n, surnames), "Person")
        .otherwise("Entity")
    )


def clean_string(text: Column) -> Column:
    """Without outer white space and then outer quotes and stops. Null is empty."""
    return F.regexp_replace(strip(_or_empty(text)), NAME_EDGES, "")


def validate_entity(name: Column, blacklist=C.BLACKLIST, short_names: str = C.SHORT_NAMES) -> Column:
    """passed, or why not: empty, entity_too_short, entity_blacklist, entity_numeric,
    entity_url; the first that holds."""
    n = _or_empty(name)
    return (
        F.when(n == "", "empty")
        .when((F.length(n) < 2) & ~n.isin(*short_names), "entity_too_short")
        .when(n.isin(*blacklist), "entity_blacklist")
        .when(n.rlike(r"\A[0-9\\.]+\n?\z"), "entity_numeric")
        .when(F.contains(n, F.lit("http")) | F.contains(n, F.lit("www")), "entity_url")
        .otherwise("passed")
    )


def infer_season(season: Column, head: Column, tail: Column, terms=C.TERMS) -> Column:
    """The cleaned season if it is known, else the first term, in calendar order, that
    the head holds, or else the tail."""
    s = clean_string(season)
    known = F.when((s != "") & (s != C.UNKNOWN_SEASON), s)
    return F.coalesce(known, first_in(head, terms), first_in(tail, terms), F.lit(C.UNKNOWN_SEASON))


def safe_type(relation_type: Column) -> Column:
    """Letters, digits and `_` stay, all else becomes `_`."""
    return F.regexp_replace(relation_type, r"[^\p{L}\p{N}_]", "_")


def is_nonsense(question: Column) -> Column:
    """True for questions without a core of at least two letters, digits or CJK
    characters that isn't a short repetition or a bare number."""
    core = F.regexp_replace(_or_empty(question), r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "")
    distinct = F.size(F.array_distinct(F.split(core, "")))
    return (F.length(core) <= 1) | ((distinct == 1) & (F.length(core) <= 5)) | ~core.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")
