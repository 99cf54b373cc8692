import random
import re

from graphjobs.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshares the excess until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full = set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in order}
        full |= over


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "k", "e") for r in rows], "doc_id long, text string, source string, size int, key string, epochs string").repartition(4)
    return mixing.mix(docs).collect()


def test_targets_and_taken(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = rng.choice(["big"] * 12 + ["a", "b", "c", "Z", "é", "", None])
        rows.append((i, "w " * rng.randint(0, 90) + "　x", source))
    rows += [(900, None, "only"), (901, "", "nothing"), (902, "a b c", "single"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (None, "n u l l", "a")]
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(size)
    got = run(spark, rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 3
    again = run(spark, rows)
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty_and_wordless_tables(spark):
    assert run(spark, [])  == []
    got = run(spark, [(1, None, None), (2, "", "a")])
    assert sorted((r.doc_id, r["size"], r.taken, r.target) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_a_rest_that_rounds_up_to_the_whole_source(spark):
    # one word: target 1.5, one epoch and a rest that rounds to the whole source
    assert [(r.target, r.taken) for r in run(spark, [(1, "word", "a")])] == [(1.5, 2)]
