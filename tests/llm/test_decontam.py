import random

from graphjobs.llm import decontam
from graphjobs.llm.decontam import Budget, Searcher, myers, normalise, original_span, pieces


def semi_global(pattern, text):
    """Best (distance, first end) by the plain dynamic programme."""
    col = list(range(len(pattern) + 1))
    best = None
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(col[i + 1] + 1, new[i] + 1, col[i] + (p != c)))
        col = new
        if best is None or col[-1] < best[0]:
            best = (col[-1], j + 1)
    return best


def test_myers_equals_the_dynamic_programme():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abc", k=rng.randint(1, 120)))
        want = semi_global(p, t)
        for k in (0, want[0] - 1, want[0], want[0] + 3):
            assert myers(p, t, k) == (want if want[0] <= k else None)


def test_pieces_cover_the_item():
    assert "".join(x for _, x in pieces("abcdefghij", 3)) == "abcdefghij"
    assert len(pieces("abcdefghij", 3)) == 4


def test_search_loses_no_passage_within_the_budget():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    budget = Budget(rate=0.1)
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(30)]
    searcher = Searcher(items, budget)
    for item_id, text in items:
        k = budget.edits(len(text))
        t = list(text)
        for _ in range(k):
            at = rng.randrange(len(t))
            t[at] = rng.choice(["", "z", t[at] + "z"])
        doc = " ".join(rng.choices(words, k=50)) + " " + "".join(t) + " " + " ".join(rng.choices(words, k=50))
        doc = normalise(doc)
        want = {i: semi_global(x, doc)[0] for i, x in items}
        got = {i: d for i, d, _, _ in searcher.search(doc)}
        assert got == {i: d for i, d in want.items() if d <= budget.edits(len(dict(items)[i]))}
        assert item_id in got


def test_short_items_and_short_pieces_lose_nothing():
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)]
    items = list(enumerate({normalise(" ".join(rng.choices(words, k=rng.randint(1, 12)))) for _ in range(60)}))
    searcher = Searcher(items, Budget(rate=0.2))
    for _ in range(40):
        doc = normalise(" ".join(rng.choices(words, k=rng.randint(0, 60))))
        got = {i: d for i, d, _, _ in searcher.search(doc)}
        want = {}
        for i, x in items:
            k = int(len(x) * 0.2)
            if not k:
                if f" {x} " in f" {doc} ":
                    want[i] = 0
            elif doc and (d := semi_global(x, doc)[0]) <= k:
                want[i] = d
        assert got == want
    assert Budget().edits(100) == 5 and Budget().edits(19) == 0


def test_periodic_texts():
    searcher = Searcher([(1, "ab " * 40)])
    assert [x[:2] for x in searcher.search(normalise("ab " * 3000))] == [(1, 0)]


def test_original_span():
    text = "  Ünder--the   OLD tree!"
    assert normalise(text) == "ünder the old tree"
    assert [text[slice(*original_span(text, 6, 13))], text[slice(*original_span(text, 0, 18))]] == ["the   OLD", "Ünder--the   OLD tree"]


def test_query_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away from the burning barn."
    other = "Completely different words are written here so that nothing at all agrees with it."
    items = spark.createDataFrame([(1, item), (2, other), (3, item), (4, None), (5, ""), (6, "short")], "item_id long, text string")
    rows = [(10, "x " * 50 + item.replace("lazy", "lazzy").upper()), (11, None), (12, ""), (13, "short"), (10, item), (None, other), (14, "y " * 60000 + other)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    got = sorted([(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs, items).collect()], key=repr)
    assert got == sorted([(10, 1, 1), (10, 3, 1), (10, 1, 0), (10, 3, 0), (None, 2, 0), (14, 2, 0), (13, 6, 0)], key=repr)
    # blocks of the benchmark change nothing
    blocks = decontam.contaminated(docs, items, block_chars=50)
    assert sorted([(r.doc_id, r.item_id, r.distance) for r in blocks.collect()], key=repr) == got
    assert sorted(r.doc_id for r in decontam.without_contaminated(docs, items).collect()) == [11, 12]
    assert sorted(r.doc_id for r in decontam.without_contaminated(docs, items, block_chars=50).collect()) == [11, 12]
    assert decontam.without_contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
