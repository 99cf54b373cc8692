import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphjobs.llm import simhash


MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
EDGES = (0, 11, 21, 32, 43, 53, 64)


def mixed(h, n):
    if n:
        m = (1 << 64) - 1
        h = (h ^ h >> 32) * MIX[n - 1] & m
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 32
    return h


def linked(x, y):
    """Two of six blocks of a fingerprint agree, the next one is near, and all of them."""
    far = [a ^ b for a, b in zip(x, y)]
    if len(far) == 1:
        return far[0].bit_count() <= 3
    if sum(f.bit_count() for f in far) > 68:
        return False
    alike = [sum(f >> a & (1 << b - a) - 1 == 0 for a, b in zip(EDGES, EDGES[1:])) for f in far]
    return any(n >= 2 and far[(k + 1) % len(far)].bit_count() <= 22 for k, n in enumerate(alike))


def brute(rows, words=3, signatures=1):
    """(id, fingerprint, component) of each row, sorted."""
    out, all_fps = [], []
    for doc_id, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps = []
        for k in range(signatures):
            own = [mixed(h, k) for h in hashes]
            fps.append(sum((2 * sum(h >> bit & 1 for h in own) > len(own) and own != []) << bit for bit in range(64)))
        out.append((doc_id, fps[0]))
        all_fps.append(fps)
    n = len(out)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(all_fps[i], all_fps[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(out):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted([(d, f"{fp:016x}", best.get(find(i))) for i, (d, fp) in enumerate(out)], key=repr)


def corpus():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(60)] + ["É", "ÀB", "x y"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(1, 200)))))
    for i in range(60, 120):
        w = rows[rng.randrange(60)][1].split(" ")
        if len(w) > 20:
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (None, "one"), (205, "A b"), (0, rows[0][1])]
    rows.append((300, "long " * 70000))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(5)
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_hot_buckets_are_dealt_to_cells(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62)
    fps = sorted({int(base ^ (1 << a) ^ (1 << b)) for a in range(0, 60, 3) for b in range(0, 60, 5)} | {int(x) for x in rng.integers(-(2**62), 2**62, 200)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.close_links(df, cell=16)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = dict(simhash.forest(np.array(fps), 3))
    assert {k: v for k, v in roots.items() if k != v} == want


def test_forest_keeps_chains_whole():
    rng = np.random.default_rng(2)
    for trial in range(60):
        nodes = []
        for length in rng.integers(2, 22, 1 + trial % 8):
            steps = rng.permutation(64)[: 3 * (length - 1)].reshape(-1, 3)
            at = int(rng.integers(0, 2**63))
            nodes.append(at)
            for bits in steps:
                at ^= sum(1 << int(b) for b in bits)
                nodes.append(at)
        fps = sorted({n - (1 << 64) if n >> 63 else n for n in nodes})
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a in fps:
            for b in fps:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        assert dict(simhash.forest(np.array(fps), 3)) == {f: find(f) for f in fps if find(f) != f}


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (1, "A b c d", "y"), (None, "a b c d", "z"), (5, "q r s t u", None)], "doc_id long, text string, source string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted([r.doc_id for r in got.collect()], key=repr) == [1, 5]


def test_keep_one_of_rows_that_share_a_file_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    twice = docs.select("doc_id", F.explode(F.array("text", F.concat(F.lit("quite another beginning "), F.reverse("text")))).alias("text"))
    rows = [tuple(r) for r in twice.collect()]
    want = brute([(n, t) for n, (_, t) in enumerate(rows)], words=5, signatures=6)
    assert simhash.keep_one(twice).count() == len({c for _, _, c in want})
    assert simhash.keep_one(docs, most=0).count() == simhash.keep_one(docs).count()


def test_keep_one_goes_by_rows(spark):
    # one id with two texts, of which one is a copy of a lesser id; a hot null id
    rows = [(1, "a b c d"), (7, "a b c d"), (7, "k l m n o p"), (8, "q r s t u"), (8, "v w x y z")] + [(None, "e f g h i j")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == sorted({r for r in rows if r != (7, "a b c d")}, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def near_copies(n=300, seed=5):
    """(text, copy, similarity of five-word shingles) with words replaced or a passage lost."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(5000)]
    out = []
    for i in range(n):
        text = rng.choices(vocab, k=rng.randint(120, 500))
        copy = list(text)
        if i % 4 == 3:
            at = rng.randrange(len(copy))
            del copy[at : at + int(len(copy) * rng.uniform(0, 0.2))]
        else:
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.uniform(0, 0.035))):
                copy[at] = rng.choice(vocab)
        out.append((" ".join(text), " ".join(copy), similarity(text, copy)))
    return out


def test_keep_one_finds_copies_of_similarity_08(spark):
    pairs = near_copies()
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    near = [2 * i + 1 not in kept for i, p in enumerate(pairs) if p[2] >= 0.8]
    assert sum(near) >= 0.9 * len(near) and len(near) > 100
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [2 * i + 1 not in kept for i, p in enumerate(pairs) if low <= p[2] < high]
        print(low, len(own), sum(own) / len(own))
    # half-alike texts stay apart
    halves = [(i, " ".join(p[0].split()[: len(p[0].split()) // 2]) + " " + pairs[i - 1][1]) for i, p in enumerate(pairs)]
    assert simhash.keep_one(spark.createDataFrame(halves, "doc_id long, text string")).count() == len(halves)


def test_partners_of_hot_buckets_over_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k * 10_000 + i, int(rng.integers(-(2**62), 2**62))) for k, n in enumerate((3, 40, 2, 700, 1, 5000, 30)) for i in range(n)]
    rows += [(k, r + 500_000, s ^ 7) for k, r, s in rows if r % 9 == 0]
    own = {}
    for k, r, s in rows:
        own.setdefault(k, []).append((r, s))
    want = {(k, r) for k, b in own.items() for r, s in b if len(b) > 64 or any(r != o and ((s ^ t) & (1 << 64) - 1).bit_count() <= 22 for o, t in b)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = simhash.with_partners(spark.createDataFrame(rows, "key long, node long, sketch long"), unchecked=64).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.key, r.node) for r in got) == sorted(want)
    assert {(r.key, r.node, r.sketch) for r in got} <= set(rows)


def test_links_don_t_depend_on_the_bucket_s_size(spark, monkeypatch):
    """Nodes of one bucket whose next fingerprints are now near, now far."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**62), 2**62, 6)
    sigs = []
    for i in range(90):
        own = base.copy()
        for k, n in enumerate(rng.permutation([0, 30, 9, 9, 9, 9]) if i % 2 else [0, 0, 0, 0, 0, 1]):
            for bit in rng.permutation(64)[:n]:
                own[k] ^= np.int64(1) << np.int64(bit)
        sigs.append([int(x) for x in own])
    df = spark.createDataFrame([(i, bytearray(np.array(s, dtype=np.int64).tobytes())) for i, s in enumerate(sigs)], "node long, sigs binary")
    unsigned = [[x & (1 << 64) - 1 for x in s] for s in sigs]
    root = list(range(90))
    for _ in range(90):
        for i in range(90):
            for j in range(i):
                if linked(unsigned[i], unsigned[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert len(set(root)) > 1
    partners = simhash.with_partners
    for unchecked in (1, 30, 1000):
        monkeypatch.setattr(simhash, "with_partners", lambda rows, u=unchecked: partners(rows, unchecked=u))
        roots = {r.node: r.root for r in simhash.components(simhash.wide_links(df, cell=16)).collect()}
        assert [roots.get(i, i) for i in range(90)] == root


def test_recall_on_documents(spark):
    """Of all pairs of different documents that share four fifths of their five-word
    shingles, counted over every shingle, at least nine tenths link."""
    texts = sorted({r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()})
    words = [t.encode().lower().split() for t in texts]
    shingles = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for w in words]
    holders, shared = {}, {}
    for i, own in enumerate(shingles):
        for s in own:
            for j in holders.setdefault(s, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[s].append(i)
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(shingles[i]) + len(shingles[j]) - n)]
    sigs = {i: [x & (1 << 64) - 1 for x in simhash.signatures_of(texts[i], 5, 6)] for p in pairs for i in p}
    found = sum(linked(sigs[i], sigs[j]) for i, j in pairs)
    print(len(pairs), found)
    assert len(pairs) > 40 and found >= 0.9 * len(pairs)
