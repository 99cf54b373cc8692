import itertools
import random

import numpy as np

from graphjobs.llm import langid

WORDS = {"xx": ["the", "and", "house", "water", "there"], "yy": ["der", "und", "häuser", "wässer", "nicht"], "ru": ["вода", "дом", "где", "мы", "она"]}


def corpus(n=150):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang))
    return rows


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, s = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = rng.normal(0, 3, (n, s))
        p = float(rng.uniform(0, 5))

        def value(path):
            return sum(scores[i, x] for i, x in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))

        best = max(value(x) for x in itertools.product(range(s), repeat=n))
        assert abs(value(langid.viterbi(scores, p)) - best) < 1e-9


def test_word_scores_are_sums_of_trigrams():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], rng.normal(0, 1, (langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.SCRIPT_NAMES), 2), dtype=bool), 0)
    for text in ("a", "ab c", "  the old, tree!x", "дом house", "x" * 300):
        codes = langid._codes(text)
        words = langid.split_words(codes)
        want = [model.table[words.grams[a:b]].sum(axis=0) for a, b in zip(words.starts, words.ends)]
        assert np.allclose(model.word_scores(codes, words), want, atol=1e-4)


def test_learns_and_labels_spans(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["ru", "xx", "yy"]
    text = "the house and water there the water house " + "der häuser und nicht wässer und nicht " + "где вода она"
    spans = model.spans(text)
    assert [x for _, _, x in spans] == ["xx", "yy", "ru"]
    assert text[spans[1][0] : spans[1][1]].startswith("der") and text[spans[2][0] : spans[2][1]] == "где вода она"
    rows = [(1, "und nicht häuser"), (2, None), (3, ""), (4, "123 !?"), (5, "水"), (6, "the water"), (6, "the water"), (None, "ВОДА"), (7, "house water " * 30000)]
    many = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(many, model).collect()}
    assert got >= {(1, "yy"), (2, "und"), (3, "und"), (4, "und"), (6, "xx"), (None, "ru"), (7, "xx")}
    assert all(0 <= r.score <= 1 for r in langid.identify(many, model).collect())
    assert {x for d, x in got if d == 5} <= set(model.langs)
    kept = langid.identified_only(many, model)
    assert kept.columns == many.columns and [r.score for r in kept.collect()] == ["old"] * 6
    assert langid.identify(many.limit(0), model).count() == 0
    assert [len(r.lang_spans) for r in langid.identify(many.filter("doc_id < 3"), model).orderBy("doc_id").collect()] == [1, 0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "xx")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [r.lang_pred for r in langid.identify(docs, model).collect()] == ["und", "und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = langid.training_rows(docs)
    model = langid.train(docs.filter(learn))
    held = langid.identify(docs.filter(~learn & docs.lang.isNotNull()), model).select("lang", "lang_pred").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def by_hand(model, text):
    """(language, score, spans) with plain loops over characters and words."""
    table, names = langid._script_table(), langid.SCRIPT_NAMES
    chars = [x if len(x := c.lower()) == 1 else c for c in text or ""]
    kinds = [int(table[ord(c)]) for c in chars]
    words, at = [], 0
    for kind, run in itertools.groupby(kinds):
        n = len(list(run))
        if kind:
            words.append((at, at + n, kind - 1))
        at += n
    if not words:
        return "und", 0.0, []
    codes = [0] + [ord(c) if k else 0 for c, k in zip(chars, kinds)] + [0]

    def bucket(i):
        m = (1 << 64) - 1
        x = (codes[i] * 0x9E3779B97F4A7C15 & m) ^ (codes[i + 1] * 0xC2B2AE3D27D4EB4F & m) ^ (codes[i + 2] * 0x165667B19E3779F9 & m)
        x ^= x >> 29
        return (x * 0xBF58476D1CE4E5B9 & m) >> 48

    scores = []
    for a, b, script in words:
        row = np.sum([model.table[bucket(i)].astype(float) for i in range(a, b)], axis=0)
        ok = model.scripts[script] if model.scripts[script].any() else [True] * len(model.langs)
        scores.append([s if o else -1e9 for s, o in zip(row, ok)])
    best = {x: (s, [x]) for x, s in enumerate(scores[0])}
    for row in scores[1:]:
        best = {x: max(((v - (0 if y == x else langid.SWITCH)) + row[x], p + [x]) for y, (v, p) in best.items()) for x in best}
    labels = max(best.values())[1]
    letters = [sum(b - a for (a, b, _), x in zip(words, labels) if x == lang) for lang in range(len(model.langs))]
    top = letters.index(max(letters))
    own = np.sum([s for s, x in zip(scores, labels) if x == top], axis=0)
    spans = []
    for (a, b, _), x in zip(words, labels):
        if spans and spans[-1][2] == model.langs[x]:
            spans[-1] = (spans[-1][0], b, spans[-1][2])
        else:
            spans.append((a, b, model.langs[x]))
    return model.langs[top], letters[top] / sum(letters) / np.exp(np.clip(own - own[top], -50, 50)).sum(), spans


def test_query_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = langid.training_rows(docs)
    model = langid.train(docs.filter(learn))
    rows = [(r.doc_id, (r.text or "")[:1500]) for r in docs.filter("doc_id % 4 = 0").collect()]
    rows += [(-1, "İstanbul der häuser İİ und вода где она the house"), (-2, None), (-3, "ΑΣ ΟΔΟΣ x"), (-4, "…"), (-5, rows[0][1][:200] + " " + rows[5][1][:200])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    texts = dict(rows)
    for r in got:
        lang, score, spans = by_hand(model, texts[r.doc_id])
        assert (r.lang_pred, [tuple(s) for s in r.lang_spans]) == (lang, spans)
        assert abs(r.score - score) < 1e-6
        assert all(texts[r.doc_id][s.start : s.end].strip() for s in r.lang_spans)


def test_training_counts_by_hand(spark):
    rows = [(1, "aba ab", "xx"), (2, "ab", "xx"), (3, "где", "yy"), (4, None, "yy"), (5, "q", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {"xx": {}, "yy": {}}
    for _, text, lang in rows:
        if text and lang:
            codes = langid._codes(text)
            words = langid.split_words(codes)
            for a, b in zip(words.starts, words.ends):
                for g in words.grams[a:b].tolist():
                    counts[lang][g] = counts[lang].get(g, 0) + 1
    for n, lang in enumerate(model.langs):
        total = sum(counts[lang].values())
        for g in set(counts["xx"]) | set(counts["yy"]):
            want = np.log((counts[lang].get(g, 0) + 0.5) / (total + 0.5 * langid.BUCKETS))
            assert abs(model.table[g, n] - want) < 1e-5
