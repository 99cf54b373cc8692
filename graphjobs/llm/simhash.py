"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Cut into b blocks, two of them that differ in at most d
bits agree on b - d whole blocks at least, so a join on every choice of b - d blocks
finds each close pair; the Hamming distance then verifies it. With b = 5 and d = 3 a
key has about 26 bits: random fingerprints seldom meet, unlike on single 16-bit
blocks, where the work would grow with the square of the rows.

Three bits of 64 link texts that hardly differ. To find texts whose shingles have a
similarity of 0.8, keep_one takes several fingerprints of a text, joins on two of six
blocks of any of them and verifies the distance over all their bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: Shingles whose bits are counted at once, so that one very long text stays small.
CHUNK = 1 << 15

#: Fingerprints of a text in keep_one, their blocks, and the differing bits of all their
#: 384 up to which texts link: at a similarity of 0.8 a bit differs with 0.15, so that 58
#: are expected and 68 passed by one pair in twelve.
SIGNATURES, WIDE_BLOCKS, WIDE_DISTANCE = 6, 6, 68
#: Differing bits of the next fingerprint up to which two rows of a bucket are compared in
#: full, and the bucket's size from which rows are not looked through one by one before.
SKETCH_DISTANCE, UNCHECKED = 22, 256


#: Odd numbers that mix a shingle's hash into those of further signatures.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of signature n; those of the first are the hashes themselves."""
    if not n:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(32))) * _MIX[n - 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of the text's word shingles, repeats included."""
    return signatures_of(text, words, 1)[0]


def signatures_of(text: str | None, words: int, count: int) -> list[int]:
    """So many SimHashes of the same shingles, each by hashes of its own."""
    # bytes.lower and bytes.split know only A-Z and the six ASCII spaces
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return [0] * count
    if len(w) < words:
        w = [b" ".join(w)]
        words = 1
    n = len(w) - words + 1
    ones = np.zeros((count, 64), dtype=np.int64)
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        parts = zip(*(w[at + k : stop + k] for k in range(words)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts), dtype=np.uint64, count=stop - at)
        for k in range(count):
            ones[k] += np.unpackbits(_mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """Adds `fp` (long). Null texts have no words and get 0, like empty ones."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    return docs.withColumn("fp", simhash(F.col(text_col)))


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks that close fingerprints can agree on."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(near, n: int) -> np.ndarray:
    """The least number of each one's component; near lists linked numbers."""
    root = np.arange(n)
    a, b = np.concatenate(near, axis=1)
    while len(a):
        # only roots are hooked, and all nodes point at roots again before edges go
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        rest = root[a] != root[b]
        a, b = a[rest], b[rest]
    return root


def _near(bits: np.ndarray, distance: int, sketch: np.ndarray | None = None) -> list[np.ndarray]:
    """Numbers of the rows of bits (64 in a word) that differ in few bits, lower first; with
    sketches only those whose sketches are near as well."""
    near = []
    for at in range(0, len(bits), 256):
        far = np.zeros((len(bits[at : at + 256]), len(bits)), dtype=np.uint16)
        for word in bits.T:
            far += np.bitwise_count(word[at : at + 256, None] ^ word[None, :])
        close = far <= distance
        if sketch is not None:
            close &= np.bitwise_count(sketch[at : at + 256, None] ^ sketch[None, :]) <= SKETCH_DISTANCE
        i, j = np.nonzero(close)
        keep = i + at < j
        near.append(np.stack([i[keep] + at, j[keep]]))
    return near


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(fingerprint, least fingerprint of its component) among one cell's members."""
    fps = np.unique(fps)
    root = _roots(_near(fps.view(np.uint64)[:, None], distance), len(fps))
    own = np.nonzero(root != np.arange(len(fps)))[0]
    return list(zip(fps[own].tolist(), fps[root[own]].tolist()))


def close_links(fps: DataFrame, distance: int = 3, blocks: int = 5, cell: int = 1024) -> DataFrame:
    """Links (a, b) that join all fingerprints of the column `fp` (distinct) whose
    distance is small, a spanning forest of each bucket instead of all its pairs.

    A bucket of more than `cell` members is dealt to cells that hold two slices of it
    each, every two slices in one of them; no task gets more than two slices.
    """
    masks = block_masks(blocks, distance)
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("block", "key"),
    )
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sliced = (
        keyed.join(sizes, ["block", "key"])
        .withColumn("slices", F.ceil(F.col("n") / cell))
        .withColumn("own", F.pmod(F.hash("fp"), F.col("slices")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .groupBy("block", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
    )

    def link(batches):
        for batch in batches:
            out = [e for x in batch["fps"] for e in forest(np.array(x, dtype=np.int64), distance)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sliced.select("fps").mapInPandas(link, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for the nodes in links.

    Alternates the large star (larger neighbours are hung on the least one) and the
    small star (smaller neighbours and the node itself likewise) until nothing moves.
    Each round is checkpointed; only two sums come to the driver.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = edges.checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").filter("u != v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, blocks: int = 5
) -> DataFrame:
    """(id, fp, component_id) for every row: its fingerprint, and the least id that
    is reachable over links of at most `distance` differing bits, its own included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null
    id get their component, but never name it (null if no row of it has an id);
    repeated rows each come back.
    """
    own = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", words).select("doc_id", "fp"), "simhash")
    map_ = fingerprint_components(own, distance, blocks)
    return own.join(map_, own["fp"] == map_["of"]).select("doc_id", "fp", "component_id")


def fingerprint_components(own: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(of, root, component_id) for each fingerprint of own (doc_id, fp): the least
    fingerprint and the least id of its component."""
    groups = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    links = close_links(groups.select("fp"), distance, blocks)
    roots = components(links)
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return written(named.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id"), "simhash-map")


def _row_places(docs: DataFrame) -> DataFrame:
    """The documents with _file and _at, which tell each row from all others: the file it
    lies in, hashed, and its number there. Documents that aren't read from files are
    written first."""
    try:
        own = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        own.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        own = written(docs, "simhash-docs").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return own.withColumn("_file", F.xxhash64("_file"))


def _words_of(sigs: pd.Series) -> np.ndarray:
    """The fingerprints of packed lists, a row for each."""
    return np.frombuffer(b"".join(sigs), dtype=np.uint64).reshape(len(sigs), -1)


def block_rows(groups: DataFrame, blocks: int = WIDE_BLOCKS) -> DataFrame:
    """(key, node, sketch) of (node, sigs): a key for each choice of two blocks of each
    fingerprint, with the next fingerprint."""
    masks = block_masks(blocks, blocks - 2)

    def deal(batches):
        for batch in batches:
            words, node = _words_of(batch["sigs"]), batch["node"].to_numpy()
            for k in range(words.shape[1]):
                sketch = words[:, (k + 1) % words.shape[1]].view(np.int64)
                for n, m in enumerate(masks):
                    key = _mixed((words[:, k] & np.uint64(m)) ^ np.uint64(k * len(masks) + n << 57), 1).view(np.int64)
                    yield pd.DataFrame({"key": key, "node": node, "sketch": sketch})

    return groups.select("node", "sigs").mapInPandas(deal, "key long, node long, sketch long")


def with_partners(rows: DataFrame, distance: int = SKETCH_DISTANCE, unchecked: int = UNCHECKED) -> DataFrame:
    """The rows (key, node, sketch) whose bucket holds one with a sketch near their own, and
    all rows of buckets beyond `unchecked`, whose pairs are held to the same distance when
    they are compared. A task streams its buckets in order and keeps that many rows at most."""

    def emit(key, node, sketch, opened):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        out = (size > unchecked) | ((key == opened) if opened is not None else False)
        later = np.flatnonzero(~out & (size > 1))
        for d in range(1, unchecked):
            later = later[later >= d]
            later = later[key[later] == key[later - d]]
            if not len(later):
                break
            hit = later[np.bitwise_count((sketch[later] ^ sketch[later - d]).view(np.uint64)) <= distance]
            out[hit] = out[hit - d] = True
        return pd.DataFrame({"key": key[out], "node": node[out], "sketch": sketch[out]})

    def meet(batches):
        kept, opened = [np.zeros(0, dtype=np.int64)] * 3, None
        for batch in batches:
            key, node, sketch = (np.concatenate([k, batch[c].to_numpy(np.int64)]) for k, c in zip(kept, ("key", "node", "sketch")))
            if not len(key):
                continue
            # the last bucket may go on
            start = int(np.argmax(key == key[-1]))
            if len(key) - start > unchecked or key[-1] == opened:
                yield emit(key, node, sketch, opened)
                opened, kept = key[-1], [np.zeros(0, dtype=np.int64)] * 3
            else:
                if start:
                    yield emit(key[:start], node[:start], sketch[:start], opened)
                kept = [key[start:], node[start:], sketch[start:]]
        if len(kept[0]):
            yield emit(*kept, opened)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "key long, node long, sketch long")


def wide_links(groups: DataFrame, distance: int = WIDE_DISTANCE, blocks: int = WIDE_BLOCKS, cell: int = 512) -> DataFrame:
    """Links (a, b) between nodes of groups (node, sigs) that share two blocks of a
    fingerprint, differ in SKETCH_DISTANCE bits of the next one at most and in few bits of
    all: a spanning forest of each bucket's cell, as in close_links. Whether two nodes link
    depends on these two alone, not on the size of a bucket."""
    met = written(with_partners(block_rows(groups, blocks)), "simhash-met")
    sizes = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cells = (
        met.join(sizes, "key")
        .withColumn("slices", F.ceil(F.col("n") / cell))
        .withColumn("own", F.pmod(F.hash("node"), F.col("slices")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .join(groups, "node")
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(F.struct("node", "sigs", "sketch")).alias("c"))
        .select(F.col("c.node").alias("nodes"), F.col("c.sigs").alias("sigs"), F.col("c.sketch").alias("sketches"))
    )

    def link(batches):
        for batch in batches:
            out = []
            for nodes, sigs, sketches in zip(batch["nodes"], batch["sigs"], batch["sketches"]):
                root = _roots(_near(_words_of(sigs), distance, np.asarray(sketches, dtype=np.int64).view(np.uint64)), len(nodes))
                own = np.flatnonzero(root != np.arange(len(nodes)))
                out.append(np.stack([nodes[own], nodes[root[own]]]))
            yield pd.DataFrame(np.concatenate(out, axis=1).T if out else np.zeros((0, 2)), columns=["a", "b"], dtype="int64")

    return cells.mapInPandas(link, "a long, b long").filter("a != b").distinct()


def linked_rows(rows: DataFrame, distance: int = WIDE_DISTANCE, blocks: int = WIDE_BLOCKS) -> DataFrame:
    """(_sigs, root) of the distinct packed lists of fingerprints, which go by their 64-bit
    hash."""
    groups = written(rows.groupBy("sigs").agg(F.count("*")).select("sigs", F.xxhash64("sigs").alias("node")), "simhash-groups")
    roots = components(written(wide_links(groups, distance, blocks), "simhash-links"))
    named = groups.join(roots, "node", "left")
    return written(named.select(F.col("sigs").alias("_sigs"), F.coalesce("root", "node").alias("root")), "simhash-roots")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    signatures: int = SIGNATURES,
    distance: int = WIDE_DISTANCE,
    blocks: int = WIDE_BLOCKS,
    most: int = 2_000_000,
) -> DataFrame:
    """One row of each component of near copies: that with the least doc_id, rows without
    one last, and of equals the first by the text's hash and place.

    Texts link if they share two blocks of one of their fingerprints, differ in at most
    SKETCH_DISTANCE bits of the next one and in at most `distance` bits of all. Equal ids with different texts are judged row by row. Rows are
    told apart by file and number; up to `most` that go are broadcast, so that the texts
    are filtered where they lie, and more are joined.
    """
    own = _row_places(docs)

    @F.pandas_udf("binary")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(signatures_of(t, words, signatures), dtype=np.int64).tobytes() for t in texts], dtype=object)

    def signed_rows(own: DataFrame) -> DataFrame:
        return written(own.select(F.col(id_col).alias("doc_id"), signed(text_col).alias("sigs"), F.xxhash64(text_col).alias("hash"), "_file", "_at"), "simhash")

    rows = signed_rows(own)
    if not rows.groupBy("_file", "_at").count().filter("count > 1").isEmpty():
        # a row of a file became several on the way here
        own = _row_places(written(docs, "simhash-docs"))
        rows = signed_rows(own)
    found = linked_rows(rows, distance, blocks)
    joined = rows.join(found, rows["sigs"] == found["_sigs"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "_file", "_at")
    kept = written(joined.groupBy("root").agg(F.min(order).alias("k")).select("k._file", "k._at"), "simhash-kept")
    gone = written(rows.select("_file", "_at").join(kept, ["_file", "_at"], "left_anti"), "simhash-gone")
    return own.join(broadcast_if_small(gone, most), ["_file", "_at"], "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
