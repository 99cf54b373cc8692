import hashlib
import math
import random
import re
import struct
from collections import Counter
from functools import lru_cache

import xxhash

from graphjobs.llm import queries, weighted

SF = "/root/testdata/sf0.001"


@lru_cache(maxsize=None)
def drawn(word, weight, k):
    """The k-th draw of a word, in plain arithmetic: (ln a in steps, name)."""
    term = xxhash.xxh64_intdigest(word.encode(), seed=42)

    def hashed(x):
        return xxhash.xxh64_intdigest(struct.pack("<Q", x & (1 << 64) - 1), seed=42)

    first = hashed(term ^ (k + 1) * 0x9E3779B97F4A7C15)
    second = hashed(first)
    u = [((first >> low & (1 << bits) - 1) + 0.5) / (1 << bits) for low, bits in ((0, 21), (21, 21), (42, 22))]
    v = [((second >> low & 0xFFFFFFFF) + 0.5) / (1 << 32) for low in (0, 32)]
    r, log_c = -math.log(u[0] * u[1]), math.log(-math.log(v[0] * v[1]))
    t = math.floor(math.log(weight) / r + u[2])
    log_a = log_c - r * (t - u[2] + 1)
    return int((log_a + 128) * (1 << 32)), (second ^ (t << 7)) & ((1 << 23) - 1)


@lru_cache(maxsize=None)
def printed(text, n=weighted.SAMPLES):
    weights = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    return "".join(f"{min(drawn(w, x, k) for w, x in weights.items())[1] & 0xFFFF:04x}" for k in range(n)) if weights else ""


def near(a, b):
    if a == b or not a or not b:
        return float(a == b)
    parts = [[x[i : i + 4] for i in range(0, len(x), 4)] for x in (a, b)]
    return sum(p == q for p, q in zip(*parts, strict=True)) / len(parts[0])


def expected(rows):
    """rows of (doc_id, text) in the order of the result's definition."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    texts = [t for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        following = texts[(k + 1) % len(texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        own, new, other = printed(text), printed(edited), printed(following)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, near(own, new), near(own, other)))
    return out


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values())


HARD = ["", None, "   ", "one", "one two three four", "a " * 3000, "é😀  x", "tab\tand\nline", "one two three four", "x" * 9000 + " y"]


def test_hard_texts_against_brute_force(spark):
    rows = [(i, t) for i, t in zip([5, 3, None, 7, 1, 2, 900, -4, 1, None], HARD, strict=True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in weighted.compared(df).collect()), key=key) == sorted(expected(rows), key=key)
    alone = sorted((tuple(r) for r in weighted.fingerprints(df).collect()), key=key)
    assert alone == sorted(((i, printed(t or "")) for i, t in rows), key=key)
    assert weighted.compared(df.limit(0)).count() == 0
    (one,) = weighted.compared(df.filter("doc_id = 7")).collect()
    assert one.near_next == one.near_edited == 1.0


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(weighted, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    ids = [*rng.sample(range(-(10**15), 10**15), 40), *range(30), 5, 5, 5, None, None]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = weighted.with_next(df).filter("not last").collect()
    assert len({r.block for r in got}) > 8
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.text, r.next_text) for r in got) == sorted((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_weighted_fingerprints"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_collisions_meet_the_generalised_jaccard_similarity(spark):
    """Real-valued weights too: over many samples the share of equal ones is sum(min)/sum(max)."""
    rng = random.Random(8)
    a = {t: rng.uniform(1, 9) for t in range(60)}
    b = {t: w * rng.choice([1, 1, 0.5, 1.7]) + 1 for t, w in a.items() if t % 5} | {t: 4.0 for t in range(100, 108)}
    df = spark.createDataFrame([(k, t, float(w)) for k, x in (("a", a), ("b", b)) for t, w in x.items()], "k string, term long, weight double")
    n = 200
    found = {r.k: r.samples for r in weighted.samples(df, ["k"], n=n).collect()}
    want = sum(min(a.get(t, 0), b.get(t, 0)) for t in {*a, *b}) / sum(max(a.get(t, 0), b.get(t, 0)) for t in {*a, *b})
    assert abs(sum(x == y for x, y in zip(found["a"], found["b"], strict=True)) / n - want) < 4 * math.sqrt(want * (1 - want) / n)


def test_likeness_follows_the_texts(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 400").limit(60).collect()]
    pairs = [(k, t, t[: len(t) * keep // 10] + rows[(k + 1) % len(rows)][: len(t) * (10 - keep) // 10]) for k, t in enumerate(rows) for keep in (3, 6, 9)]
    errors = [near(printed(a), printed(b)) - jaccard(a, b) for _, a, b in pairs[:45]]
    assert abs(sum(errors) / len(errors)) < 0.02
    assert max(map(abs, errors)) < 0.25


def test_draws_of_frequent_words_are_looked_up_with_the_same_outcome(spark, monkeypatch):
    rows = [(1, "the cat the dog " * 5 + "rare"), (2, "the bird the cat the"), (3, None), (4, "  "), (5, "the " * 9 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rare in (1, 5):
        monkeypatch.setattr(weighted, "RARE", rare)
        known = {r.pair: r.draws for r in weighted.frequent_draws(df, "text").collect()}
        counts = Counter(" ".join(t or "" for _, t in rows).split())
        want = {(w, x) for w, c in counts.items() if c >= rare for x in range(1, 2 + int(math.log2(c / rare)))}
        hashed = {xxhash.xxh64_intdigest(struct.pack("<q", x), seed=xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), seed=42)), seed=42)): (w, x) for w, x in want}
        assert {k % 2**64 for k in known} == set(hashed)
        assert all([(d >> 23, d & (1 << 23) - 1) for d in draws] == [drawn(*hashed[k % 2**64], i) for i in range(weighted.SAMPLES)] for k, draws in known.items())
        assert sorted(tuple(r) for r in weighted.compared(df).collect()) == sorted(expected(rows))
    # the looked-up draws are those that are used
    terms = weighted.weighted_terms(df.filter("doc_id = 2"), ["doc_id"], "text")
    pairs = spark.createDataFrame([(k, [-7] * weighted.SAMPLES) for k in known], "pair long, draws array<long>")
    assert weighted.samples(terms, ["doc_id"], known=pairs).first().samples == [-7] * weighted.SAMPLES


def test_the_plan_does_not_grow_with_the_samples(spark):
    """Draws are made in parts by one expression, and parts are joined in their order."""
    df = spark.createDataFrame([("a", 5, 2.0), ("a", 6, 1.0), ("b", 5, 3.0)], "k string, term long, weight double")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plans = [weighted.samples(df, ["k"], n=n)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") for n in (16, 128)]
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plans[0] == plans[1] > 0
    few, many = ({r.k: r.samples for r in weighted.samples(df, ["k"], n=n).collect()} for n in (10, 100))
    assert all(len(few[k]) == 10 and len(many[k]) == 100 and many[k][:10] == few[k] for k in "ab")
