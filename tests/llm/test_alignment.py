import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphjobs.llm import alignment, queries

A, B = f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
HARD = ["a  b", "foo\n bar", "x \n y", "  lead", "trail ", " ", "", None, "a▁b c", "é  x", "a\n\n b", "\x1c b", "😀 😀", "<|endoftext|> <s> <0x41>", "don't 12 345", "x" * 5000, "ab " * 3000, "a b"]


def brute(texts):
    """Whole texts by the files' own libraries; overlaps by comparing all byte ranges in turn."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    own_a, own_b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    own_a.encode_special_tokens = True
    chars = alignment.byte_characters()
    out = []
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups": ""}
        out.append(row)
        if not text:
            continue
        raw = (" " + text).encode()
        e = own_a.encode(" " + text, add_special_tokens=False)
        ids_b = own_b.encode(text)
        bytes_a = [bytes(chars[c] for c in t) for t in e.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if own_b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [own_b.id_to_piece(i)]]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b)) if len(raw) < 3000 else (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
        i = j = 0
        group, groups = ([], []), []
        seen_a = seen_b = -1
        while i < len(ends_a):
            row["links"].append((e.ids[i], ids_b[j]))
            if i > seen_a:
                group[0].append(e.ids[i])
            if j > seen_b:
                group[1].append(ids_b[j])
            seen_a, seen_b = i, j
            x, y = ends_a[i], ends_b[j]
            if x == y:
                groups.append("|".join(",".join(map(str, g)) for g in group))
                group = ([], [])
            i, j = i + (x <= y), j + (y <= x)
        row |= {"n_a": len(ends_a), "n_b": len(ends_b), "n_groups": len(groups), "groups": ";".join(groups)}
    return out


def scores(rows):
    counts = Counter(p for r in rows for p in set(r["links"]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), sum(counts[p] == most[p[0]] for p in r["links"]), sum(counts[p] for p in r["links"]), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        for r in rows
    ]


def test_bits():
    rng = np.random.default_rng(3)
    places = np.unique(rng.integers(0, 1000, 200))
    bits = alignment.Bits.at(places, 1000)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.arange(1001)).tolist() == [int((places < p).sum()) for p in range(1001)]


def test_words_give_what_whole_texts_give():
    words = alignment.Words(alignment.ByteLevel(A), alignment.Pieces(B))
    assert words.by_words
    found = alignment.aligned(HARD, words)
    for k, r in enumerate(brute(HARD)):
        assert (found["n_a"][k], found["n_b"][k], found["n_groups"][k], found["n_links"][k], found["groups"][k]) == (r["n_a"], r["n_b"], r["n_groups"], len(r["links"]), r["groups"]), HARD[k]
    before = found["groups"]
    words.clear()
    assert alignment.aligned(HARD, words)["groups"] == before


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 20, 0])
def test_counts_against_brute_force(spark, most):
    texts = HARD + ["the cat sat", "the cat", "the cat", "the dog's"] * 3
    df = spark.createDataFrame([(k % 20, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, links string").repartition(3)
    rows = alignment.scored(alignment.written(alignment.align(df, keep_groups=False), "t"), most).collect()
    want = scores(brute(texts))
    assert sorted(tuple(r) for r in rows) == sorted((k % 20, *w) for k, w in enumerate(want))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, scores(brute([d.text for d in docs])), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_alignment"](spark, SF).collect()}
    assert got == want


def test_links_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b a"), (None, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(df).collect()}
    assert sum(x.times for x in rows[1].links) == rows[1].n_links == 3 and len(rows[1].links) == 2
    assert rows[None].links == [] and rows[None].groups == ""
    empty = alignment.written(alignment.align(df.limit(0), keep_groups=False), "t")
    assert alignment.scored(empty).count() == 0
