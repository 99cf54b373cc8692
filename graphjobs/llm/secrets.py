"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query of trigrams is derived that every match must
satisfy. An inverted index over the documents holds postings for the trigrams that
rules ask for, in blocks of document ids; intersecting them gives each rule's
candidates, and only those are searched by its regex. A rule without mandatory
trigrams searches every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the regex, leftmost and non-overlapping, whose
    group has at least min_length characters; others are dropped after matching."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 0


#: The base rules, fixed values. Their cases are spelt out: engines differ in what
#: letters "either case" takes in beyond ASCII.
BASE_RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

#: Further rules of the scan.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

#: More strings than these are not told apart while a query is derived.
_MOST = 64
#: Ids of a block of postings share all but this many bits.
BLOCK_BITS = 12

Query = frozenset  # of alternatives, each a frozenset of trigrams that must all occur


def _and(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > _MOST:
        return a
    return frozenset(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> Query | None:
    """Trigrams of one of the strings; None if one is too short to have any."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(parsed) -> tuple[set[str] | None, Query | None]:
    """(all strings that the expression matches if they are few, else None; what its
    matches must hold besides). Letters are lower-case."""
    exact: set[str] | None = {""}
    must: Query | None = None

    def flush():
        nonlocal exact, must
        if exact:
            must = _and(must, _of_strings(exact))
        exact = {""}

    closed = True
    for op, arg in parsed:
        name = str(op)
        own: set[str] | None = None
        need: Query | None = None
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            chars = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            own = chars if len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            own, need = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None and n is None for s, n in parts):
                own = set().union(*(s for s, _ in parts))
            else:
                full = [_and(n, _of_strings(s) if s else None) for s, n in parts]
                need = None if any(f is None for f in full) else frozenset().union(*full)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            s, n = _walk(inner)
            if (int(low), int(high)) == (0, 1) and s is not None and n is None:
                own = s | {""}
            elif low and int(low) == int(high) and s is not None and len(s) ** int(low) <= _MOST:
                own, need = {"".join(p) for p in product(s, repeat=int(low))}, n
            elif low:
                need = _and(n, _of_strings(s) if s else None)
        elif name == "AT":
            own = {""}
        must = _and(must, need)
        if own is not None and len(own) * len(exact) <= _MOST:
            exact = {a + b for a, b in product(exact, own)}
        else:
            flush()
            closed = False
            if own is not None:
                exact = own
    if closed:
        return exact, must
    flush()
    return None, must


def trigram_query(regex: str) -> Query | None:
    """The alternatives of lower-case trigrams one of which every match holds in full;
    None if no trigram is mandatory."""
    exact, must = _walk(re._parser.parse(regex))
    query = _and(must, _of_strings(exact) if exact else None)
    if query is None or any(not part for part in query):
        return None
    return frozenset(p for p in query if not any(q < p for q in query))


def posting_id(docs: DataFrame, id_col: str) -> Column:
    """A number for each id: whole numbers are their own, others go by a hash. Rows that
    share one are candidates together, which costs a search and loses nothing; null ids
    are dealt to numbers of their own by their text's hash."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    own = F.col(id_col).cast("bigint") if whole else F.xxhash64(id_col)
    rest = [F.col(c) for c in docs.columns if c != id_col]
    return F.when(F.col(id_col).isNull(), F.xxhash64(*rest) if rest else F.lit(0)).otherwise(own)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(block, postings: map of trigram to the block's ids whose text holds it, in any
    case). Ids of a block differ in their last BLOCK_BITS bits only, so a list has
    4,096 entries at most however common its trigram is."""
    lower = docs.select(posting_id(docs, id_col).alias("id"), F.lower(text_col).alias("text")).filter("text is not null")
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in trigrams]))
    pairs = lower.select("id", F.explode(held).alias("trigram"))
    lists = pairs.groupBy(F.shiftright("id", BLOCK_BITS).alias("block"), "trigram").agg(F.collect_set("id").alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))


def _candidates_of(query: Query) -> Column:
    """Ids of a block that satisfy the query, from its map of postings."""
    out = None
    for part in sorted(map(sorted, query)):
        both = None
        for t in part:
            ids = F.coalesce(F.try_element_at("postings", F.lit(t)), F.array().cast("array<bigint>"))
            both = ids if both is None else F.array_intersect(both, ids)
        out = both if out is None else F.array_union(out, both)
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(id, kinds): the rules with mandatory trigrams that each document may match, by its
    posting_id. None if no rule has any."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    if not queries:
        return None
    trigrams = sorted({t for q in queries.values() for part in q for t in part})
    index = trigram_index(docs, trigrams, id_col, text_col)

    def of(kind: str, query: Query) -> Column:
        return F.transform(_candidates_of(query), lambda x: F.struct(x.alias("id"), F.lit(kind).alias("kind")))

    found = [of(kind, q) for kind, q in queries.items()]
    return index.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.id").agg(F.collect_set("c.kind").alias("kinds"))


def _kinds_of(lower: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds of rules whose trigram query the text satisfies."""
    kinds = []
    for r in rules:
        query = trigram_query(r.regex)
        if query is not None:
            any_part = None
            for part in sorted(map(sorted, query)):
                both = None
                for t in part:
                    has = F.contains(lower, F.lit(t))
                    both = has if both is None else both & has
                any_part = both if any_part is None else any_part | both
            kinds.append(F.when(any_part, F.lit(r.kind)))
    return F.array_compact(F.array(*kinds))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start,rank,end,kind>> of the rule's matches in the text, in code
    points. Positions follow from the lengths of the matches and of what parts them."""
    regex = F.lit(rule.regex)
    pieces = F.split(text, rule.regex, -1)
    zipped = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, regex, F.lit(0)).alias("m"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        measured = x["m"] if rule.group == 0 else F.regexp_extract(x["m"], rule.regex, rule.group)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["m"].isNotNull() & (F.length(measured) >= rule.min_length)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.aggregate(F.transform(zipped, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"))), start, step, lambda acc: acc["out"])


def _shortcut(rule: Rule) -> Rule:
    """A rule that is one repeated character class needs no short runs at all: runs are
    maximal, so asking for min_length at once finds the same ones."""
    parsed = list(re._parser.parse(rule.regex))
    if len(parsed) == 1 and str(parsed[0][0]) == "MAX_REPEAT" and rule.group == 0 and rule.regex.endswith("]+"):
        return Rule(rule.kind, f"{rule.regex[:-1]}{{{max(1, rule.min_length)},}}", 0, rule.min_length)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text", most: int = 500_000) -> DataFrame:
    """The documents with secret_spans: array<struct<start,rank,end,kind>> sorted by
    start, then by the rules' order.

    Up to `most` candidates are broadcast to the documents. Null and empty texts have none. Repeated rows, rows with equal ids and rows with a
    null id are each searched. A column secret_spans of docs is replaced.
    """
    docs = docs.drop("secret_spans")
    found = candidates(docs.select(id_col, text_col), rules, id_col, text_col)
    if found is None:
        own = docs.withColumn("_secret_kinds", F.lit(None).cast("array<string>"))
    else:
        found = written(found, "secret-candidates").select(F.col("id").alias("_secret_id"), F.col("kinds").alias("_secret_kinds"))
        if found.limit(most + 1).count() <= most:
            key = posting_id(docs.select(id_col, text_col), id_col)
            own = docs.withColumn("_secret_key", key).join(F.broadcast(found), F.col("_secret_key") == F.col("_secret_id"), "left")
        else:
            # too many to broadcast: a document looks its trigrams up in its own text, with
            # the same outcome, so that no text is shuffled to meet its postings
            own = docs.withColumn("_secret_kinds", _kinds_of(F.lower(text_col), rules))
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for rank, rule in enumerate(rules):
        indexed = trigram_query(rule.regex) is not None
        fast = _shortcut(rule)
        test = F.coalesce(F.array_contains("_secret_kinds", rule.kind), F.lit(False)) if indexed else text.rlike(fast.regex)
        parts.append(F.when(test, rule_spans(text, fast, rank)).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")))
    return own.withColumn("secret_spans", F.array_sort(F.concat(*parts))).select(*docs.columns, "secret_spans")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    kinds = [r.kind for r in base]

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    own = F.filter("secret_spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *counts, F.sha2(span_list(own), 256).alias("base_sha256"), span_list(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; overlapping
    spans are merged under the first one's kind. n_chars, where docs have it, is
    counted anew for changed texts. Returns the columns of docs."""
    found = scan(docs, rules, id_col, text_col)
    text = F.col(text_col)

    def step(acc, s):
        start = F.greatest(s["start"], acc["at"])
        clean = F.concat(acc["out"], text.substr(acc["at"] + 1, start - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        more = s["start"] >= acc["at"]
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(more, clean).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    found = found.withColumn("_secret_done", F.when(F.size("secret_spans") > 0, done))
    new = F.when(F.col("_secret_done").isNull(), text).otherwise(F.concat(F.col("_secret_done.out"), text.substr(F.col("_secret_done.at") + 1, F.length(text))))
    found = found.withColumn("_secret_new", new)
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept.append(F.col("_secret_new").alias(c))
        elif c == "n_chars":
            kept.append(F.when(F.col("_secret_done").isNull(), F.col(c)).otherwise(F.length("_secret_new").cast(docs.schema[c].dataType)).alias(c))
        else:
            kept.append(F.col(c))
    return found.select(*kept)
