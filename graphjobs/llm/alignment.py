"""Alignment of the tokens that two tokenizers cut a text into.

Both sides tile the same bytes, so their token ends are marks on one line: a bit for each
byte place, set where a token ends. The AND of the two bitsets holds the places where
both end (the cuts into groups), the OR the ends of all overlaps. Popcounts in a rank
directory turn a byte place into the number of tokens that end before it, and so into the
tokens that cover it: each bit of the OR is one link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Where the vocabularies lie on each executor.
FOLDER = "/opt/tokenizers"
#: How a byte-level vocabulary parts a text before it merges bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose counts are broadcast at most; the rarer ones are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Bytes of text that a task aligns at once, and tokens of words that it remembers.
BATCH_BYTES, REMEMBERED = 2_000_000, 4_000_000
#: New words that are encoded together.
JOINED = 1_000

#: No token of either side crosses from a letter, digit or mark to the space after it. A
#: word here is what stands between such spaces; most often that is what splitting gives.
_ENDS_WELL, _WORDS = re.compile(r"[!-~\w]\Z"), re.compile(r"(?s)(?:^|(?<=[!-~\w]) )(.+?)(?=(?<=[!-~\w]) .|\Z)")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from its JSON file. Where merges come in the order of their ids, the
    ids are ranks, and a faster encoder takes them; else the file's own library encodes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, bytes_of = spec["model"], byte_characters()
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        vocab = {i: bytes(bytes_of[c] for c in t) for t, i in model["vocab"].items() if i not in special}
        self.table = [vocab.get(i, special.get(i, "").encode()) for i in range(max([*vocab, *special]) + 1)]
        merged = [model["vocab"]["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)] for m in model["merges"]]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_words = merged == sorted(merged) and spec["normalizer"] is None and not model.get("ignore_merges") and all((spec["pre_tokenizer"] or {}).get(k) == v for k, v in plain.items())
        if self.by_words:
            import tiktoken

            encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={b: i for i, b in vocab.items()}, special_tokens={})
            self.encode = lambda text: encoding.encode_to_numpy(text, disallowed_special=())
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class Pieces:
    """A piece model, which puts a space before what it encodes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.encode = lambda text: own.encode(text)
        #: No piece goes on after a space, and spaces stay as they are.
        self.by_words = not any(re.search("[^▁]▁", p) for p in pieces) and b"".join(self.table[i] for i in own.encode("a  b ")) == b" a  b "


class Bits:
    """A packed bitset with a rank directory over words of 64 bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size // 64 + 2) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class _Known(dict):
    """Numbers of words; a new word gets the next one and is listed."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Words:
    """Token ids of the words met so far, on both sides, as two pools of ids. Where the two
    vocabularies allow it, a text's tokens are those of its words one after the other."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.sides = (a, b)
        self.by_words = a.by_words and b.by_words
        self.names = [np.array([str(i) for i in range(len(x.table))], object) for x in self.sides]
        self.sizes = [np.array([len(t) for t in x.table], np.int64) for x in self.sides]
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.odd, self.lossy = set(), set()
        self.ids = [np.zeros(0, np.int64)] * 2
        self.many = [np.zeros(0, np.int64)] * 2

    def held(self) -> int:
        return len(self.ids[0]) + len(self.ids[1])

    def of(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's words; none for a text that its tokens don't give back."""
        known, split = self.known, self.by_words
        places = [list(map(known.__getitem__, t.split(" ") if split else [t])) if t else [] for t in texts]
        self._add()
        if self.odd:  # a text with a word that spaces alone don't part from the next one
            places = [s if self.odd.isdisjoint(s) else list(map(known.__getitem__, _WORDS.findall(texts[k]))) for k, s in enumerate(places)]
            self._add()
        if self.lossy:
            places = [s if self.lossy.isdisjoint(s) or self._given_back(s, (" " + texts[k]).encode()) else [] for k, s in enumerate(places)]
        return places

    def _add(self) -> None:
        new, self.known.new = self.known.new, []
        if not new:
            return
        parts, start, first = [], 0, len(self.known) - len(new)
        well = [bool(_ENDS_WELL.search(w)) for w in new]
        for k, ok in enumerate([*well, False]):  # runs of words that can be encoded as one text
            if not (ok and self.by_words) or k - start == JOINED:
                parts += [x for x in (new[start:k], new[k : k + 1] if not ok else []) if x]
                start = k + (not ok)
        if self.by_words:
            self.odd.update(first + k for k, ok in enumerate(well) if not ok)
        at = first
        for words, whole, *_ in (encoded := [x for part in parts for x in self._encoded(part)]):
            if not whole:
                self.lossy.update(range(at, at + len(words)))
            at += len(words)
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], *(x[2][k] for x in encoded)])
            self.many[k] = np.concatenate([self.many[k], *(x[3][k] for x in encoded)])

    def _encoded(self, words: list[str]) -> list[tuple]:
        """(words, given back whole?, ids, ids for each word) of words that are encoded as one
        text; those that aren't given back are taken one by one."""
        text, (a, b) = " ".join(words), self.sides
        raw = f" {text}".encode()
        ids = (a.encode(f" {text}"), b.encode(text))
        whole = all(b"".join([side.table[i] for i in x]) == raw for side, x in zip(self.sides, ids, strict=True))
        if not whole and len(words) > 1:
            return [x for w in words for x in self._encoded([w])]
        ids = [np.array(x, np.int64) for x in ids]
        if len(words) == 1:
            return [(words, whole, ids, [np.array([len(x)]) for x in ids])]
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        upto = [np.searchsorted(np.cumsum(size[x]), ends, side="right") for size, x in zip(self.sizes, ids, strict=True)]
        return [(words, True, ids, [np.diff(u, prepend=0) for u in upto])]

    def tokens(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids for each word) of the words in this order, on both sides."""
        out = []
        for ids, counts in zip(self.ids, self.many, strict=True):
            many = counts[places]
            first, start = np.cumsum(many) - many, (np.cumsum(counts) - counts)[places]
            out.append((ids[np.repeat(start - first, many) + np.arange(many.sum())], many))
        return out

    def _given_back(self, places: list[int], raw: bytes) -> bool:
        """Do both sides give back a text of these words?"""
        found = self.tokens(np.array(places, np.int64))
        return all(b"".join([side.table[i] for i in ids.tolist()]) == raw for side, (ids, _) in zip(self.sides, found, strict=True))


def _ends(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Where each group of consecutive sizes ends, in the sum."""
    return np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(groups)]


def aligned(texts: list[str | None], words: Words) -> dict[str, list]:
    """For each text n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links, the
    different (a, b, times). All texts of the batch lie on one line of bytes."""
    places = words.of(texts)
    in_text = np.array([len(s) for s in places], np.int64)
    (a, in_word_a), (b, in_word_b) = words.tokens(np.array([p for s in places for p in s], np.int64))
    text_a, text_b = _ends(in_word_a, in_text), _ends(in_word_b, in_text)  # ends of the texts, in tokens

    size_a, size_b = words.sizes
    byte_a, byte_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    size = int(byte_a[-1]) if len(a) else 0
    marks_a, marks_b = Bits.at(byte_a, size), Bits.at(byte_b, size)
    shared, either = Bits(marks_a.words & marks_b.words), Bits(marks_a.words | marks_b.words)
    text_bytes = np.concatenate([[0], byte_a])[text_a]

    cuts, overlaps = shared.select(), either.select()
    group_a, group_b = marks_a.rank(cuts + 1), marks_b.rank(cuts + 1)  # ends of the groups, in tokens
    link_a, link_b = a[marks_a.rank(overlaps)], b[marks_b.rank(overlaps)]
    text_groups, text_links = shared.rank(text_bytes + 1), either.rank(text_bytes + 1)
    text_groups, text_links = (np.where(text_bytes > 0, x, 0) for x in (text_groups, text_links))

    # equal links of a text become one, with how often it has them
    text_of = np.searchsorted(text_links, np.arange(len(overlaps)), side="right")
    key, times = np.unique((text_of * len(size_a) + link_a) * len(size_b) + link_b, return_counts=True)
    text_pairs = np.searchsorted(key // (len(size_a) * len(size_b)), np.arange(len(texts)), side="right")
    links = {"a": key // len(size_b) % len(size_a), "b": key % len(size_b), "times": times}

    # ids in the order of the groups, each with the mark that comes after it
    named = np.empty(len(a) + len(b), object)
    for ids, ends, others, names, last in ((a, group_a, np.concatenate([[0], group_b])[:-1], words.names[0], "|"), (b, group_b, group_a, words.names[1], ";")):
        text = (names + ",")[ids]
        text[ends - 1] = (names + last)[ids[ends - 1]]
        named[np.arange(len(ids)) + np.repeat(others, np.diff(ends, prepend=0))] = text
    text_names = text_a + text_b
    joined = ["".join(named[i:j].tolist())[:-1] for i, j in zip(np.concatenate([[0], text_names])[:-1], text_names, strict=True)]

    def each(ends: np.ndarray) -> np.ndarray:
        return np.diff(ends, prepend=0)

    return {"n_a": each(text_a), "n_b": each(text_b), "n_groups": each(text_groups), "n_links": each(text_links), "groups": joined, "link_ends": text_pairs, "links": links}


@lru_cache(maxsize=1)
def _words(path_a: str, path_b: str) -> Words:
    """Kept by the worker for its next tasks; at most REMEMBERED tokens and one batch more."""
    return Words(ByteLevel(path_a), Pieces(path_b))


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,times:int>>"


def _aligner(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path_a, path_b)
        for batch in batches:
            rows, ids, texts = (batch.column(n) for n in ("row_id", "doc_id", "text"))
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_BYTES, side="right")))
                if words.held() > REMEMBERED:
                    words.clear()
                found = aligned(texts.slice(start, stop - start).to_pylist(), words)
                offsets = pa.array(np.concatenate([[0], found["link_ends"]]), pa.int32())
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(found["links"][f.name], f.type) for f in _LINK], fields=list(_LINK)))
                groups = found["groups"] if keep_groups else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                columns = [rows.slice(start, stop - start), ids.slice(start, stop - start), *(pa.array(found[n], pa.int64()) for n in _COUNTS), pa.array(groups, pa.string()), links]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", *_COUNTS, "groups" if keep_groups else "groups_sha256", "links"])
                start = stop

    return run


def align(docs: DataFrame, path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """One row for each row of docs: row_id (a number of this run), doc_id, n_a, n_b,
    n_groups, n_links, groups (or groups_sha256) and links: array<struct<a,b,times>>, the
    different pairs of ids that overlap in the text.

    A text that is null, empty, or not given back by the bytes of its tokens has no tokens:
    zeros, '' and no links. Other columns of docs are left out, whatever their names; rows
    that repeat stay. No shuffle; a task holds BATCH_BYTES of text at once, or one text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _SCHEMA.replace("groups_sha256", "groups") if keep_groups else _SCHEMA
    return rows.mapInArrow(_aligner(path_a, path_b, keep_groups), schema)


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, a, n, best) for each pair of ids: in how many rows it is linked, and whether no
    pair of its a is in more. `links` has pair, a and one row for each text and pair."""
    counts = written(links.groupBy("pair", "a").agg(F.count("*").alias("n")), "link-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_broadcast(counts: DataFrame, most: int) -> int:
    """The least n such that at most so many pairs have n or more. Numbers of pairs by size
    class (an eighth of a power of two) are all that the driver sees."""
    classes = counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    left, least = most, 2**62
    for row in sorted(classes, key=lambda r: -r["least"]):
        left -= row["pairs"]
        if left < 0:
            break
        least = row["least"]
    else:
        return 1
    return least


def scored(aligned_docs: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row
    of an align() table, which is read three times, so it should be written.

    Frequent pairs are looked up in a broadcast of `most` rows at most; the rarer ones, each
    in few texts by that very threshold, meet their counts in a shuffle. Both ways give the
    same sums.
    """
    a, b = F.col("link.a"), F.col("link.b")
    pair = F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    links = aligned_docs.select("row_id", F.explode("links").alias("link")).select("row_id", pair.alias("pair"), a.alias("a"), F.col("link.times").alias("times"))
    counts = written(link_counts(links), "pair-counts")
    least = _least_broadcast(counts, most)
    frequent = links.join(F.broadcast(counts.filter(F.col("n") >= least).select("pair", "n", "best")), "pair", "left")
    if least > 1:
        rare = frequent.filter("n is null").drop("n", "best").join(counts.filter(F.col("n") < least).select("pair", "n", "best"), "pair")
        frequent = frequent.filter("n is not null").unionByName(rare)
    times = F.col("times").cast("long")
    sums = frequent.groupBy("row_id").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned_docs.drop("links").join(sums, "row_id", "left").select("doc_id", *_COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
