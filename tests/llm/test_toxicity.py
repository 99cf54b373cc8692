import time

import numpy as np
from pyspark.sql import functions as F

from graphjobs.llm import toxicity
from graphjobs.llm.toxicity import Lexicon, fold


def test_folding():
    assert fold("1D10T") == "idiot"
    assert fold("іdіоt café 2024 $cum") == "idiot cafe 2024 scum"
    assert fold(None) == ""


def test_exceptions_and_word_starts():
    lexicon = Lexicon({"trash": 2.0, "clown": 1.0}, scale=(-3.0, 2.0, 1.0))
    assert [h[:2] for h in lexicon.hits(fold("Trash, trashy; not atrash"))] == [(0, 5), (7, 12)]
    assert lexicon.hits(fold("put it in the trash can by the clown fish")) == []
    assert lexicon.score("you trash") > lexicon.score("you trash " + "word " * 500) > lexicon.score("word") == lexicon.score(None) == lexicon.score("")


def test_learning(spark):
    bad = [(i, f"word{i % 7} you vile{'x' * (i % 3)} thing number {i}", 1) for i in range(40)]
    good = [(100 + i, f"word{i % 7} you kind thing number {i}", 0) for i in range(200)]
    docs = spark.createDataFrame([(a, b, 9) for a, b, _ in bad + good] + [(500, None, 9), (501, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(a, c) for a, _, c in bad + good] + [(500, 1), (501, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert list(lexicon.weights) == ["vile"]
    more = docs.union(spark.createDataFrame([(None, "VILE", 0), (600, "vile " * 90000, 0), (600, "vile", 0)], docs.schema))
    rows = toxicity.score(more, lexicon).collect()
    assert len(rows) == 245 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.predicted == ("vile" in (r.text or "").lower()) for r in rows)
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0)).weights == {}


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn = toxicity.training_rows(F.col("doc_id"))
    lexicon = toxicity.train(docs.filter(learn), labels.filter(learn))
    held = toxicity.score(docs.filter(~learn).join(labels, "doc_id"), lexicon).select("toxic", "predicted").collect()
    hit = sum(r.toxic == r.predicted == 1 for r in held)
    assert hit >= 0.95 * sum(r.predicted for r in held) and hit >= 0.75 * sum(r.toxic for r in held)


def by_hand(lexicon, text):
    """The score by comparing every stem and phrase at every place."""
    folded = fold(text)
    at_word = [i for i in range(len(folded)) if not i or not folded[i - 1].isalnum()]
    covered = [(i, i + len(fold(p))) for i in at_word for p in lexicon.exceptions if folded.startswith(fold(p), i)]
    total = 0.0
    for i in at_word:
        for stem, weight in lexicon.weights.items():
            if folded.startswith(stem, i) and not any(s <= i and i + len(stem) <= e for s, e in covered):
                total += weight
    rate = 100 * total / max(len(toxicity._TOKEN.findall(folded)), 20)
    z = lexicon.scale[0] + lexicon.scale[1] * np.log1p(total) + lexicon.scale[2] * np.log1p(rate)
    return 1 / (1 + np.exp(-z))


def test_query_against_every_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = toxicity.training_rows(F.col("doc_id"))
    lexicon = toxicity.train(docs.filter(learn), labels.filter(learn))
    lexicon.exceptions = (*lexicon.exceptions, *(f"{s} the" for s in list(lexicon.weights)[:5]))
    own = docs.filter(F.length("text") < 3000).join(labels, "doc_id").select(docs.columns).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "trash can " * 50)], docs.schema))
    rows = toxicity.score(own, lexicon).collect()
    assert len(rows) > 100
    for r in rows:
        assert abs(r.score - by_hand(lexicon, r.text)) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_harmless_phrases_are_learned(spark):
    bad = [(i, f"you vile thing number w{i} here", 1) for i in range(40)]
    good = [(100 + i, f"the vile weather of day d{i}" if i < 8 else f"plain words about some thing {i} and more of them every day", 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in bad + good], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, exceptions=("vile number",))
    assert "vile" in lexicon.weights and {"vile number", "vile weather", "the vile"} <= set(lexicon.exceptions)
    assert "vile thing" not in lexicon.exceptions and lexicon.hits("the vile weather") == []


def test_many_exceptions_take_linear_time():
    lexicon = Lexicon({"trash": 2.0, "clown": 1.0})
    text = "trash can and trash or clown fish " * 40000
    began = time.time()
    assert len(lexicon.hits(text)) == 40000
    assert time.time() - began < 5
