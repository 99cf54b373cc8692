"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: a passage within
k edits of it holds one piece unchanged at least. All pieces go into one Aho-Corasick
automaton; each hit tells where its item would lie, and Myers' bit-parallel distance
verifies that place.

Texts are compared as lower-case letters and digits with single spaces between.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: What parts the words of a normalised text.
_GAPS = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Budget:
    """Edits allowed for an item: `rate` of its normalised characters, rounded down, so
    that pieces have some 1 / rate characters. Items that allow none are searched as they
    are, from word to word. Items under `min_chars` are left out, none by default."""

    rate: float = 0.05
    min_chars: int = 1

    def edits(self, length: int) -> int:
        return int(length * self.rate)


def normalise(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, piece) of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best end of the pattern in the text, any start; the
    first of equals; None if over k."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # the text may begin anywhere: no carry enters the lowest row
        ph = ph << 1 & full
        mh = mh << 1 & full
        xv = eq | mv
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Searcher:
    """Finds all items in a text. items: (id, text); ids of equal texts share a search."""

    def __init__(self, items: Iterable[tuple[object, str]], budget: Budget = Budget()):
        by_text: dict[str, list] = {}
        for item_id, text in items:
            text = normalise(text)
            if len(text) >= budget.min_chars:
                by_text.setdefault(text, []).append(item_id)
        self.items = [(ids, text, budget.edits(len(text))) for text, ids in sorted(by_text.items())]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                owners.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        if owners:
            self.automaton.make_automaton()

    def _places(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Where each item may lie: ranges of starts that its pieces' hits point to."""
        starts: dict[int, set[int]] = {}
        if self.items:
            for last, (length, of) in self.automaton.iter(text):
                at = last - length + 1
                for n, offset in of:
                    starts.setdefault(n, set()).add(at - offset)
        out = {}
        for n, found in starts.items():
            k, ranges = self.items[n][2], []
            for s in sorted(found):
                if ranges and s - ranges[-1][1] <= k:
                    ranges[-1][1] = s
                else:
                    ranges.append([s, s])
            out[n] = [(a, b) for a, b in ranges]
        return out

    def search(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, distance, start, end) in the normalised text: the best match of
        each item, the first of equals."""
        for n, ranges in sorted(self._places(text).items()):
            ids, item, k = self.items[n]
            best = None
            if not k:
                # short items stand for themselves only as whole words
                whole = (s for a, b in ranges for s in range(a, b + 1) if text[s - 1 : s] in ("", " ") and text[s + len(item) : s + len(item) + 1] in ("", " "))
                at = next((s for s in whole if text.startswith(item, s)), None)
                ranges, best = [], None if at is None else (0, at, at + len(item))
            for a, b in ranges:
                low = max(0, a - k)
                window = text[low : b + len(item) + k]
                found = myers(item, window, k if best is None else best[0] - 1)
                if found:
                    distance, end = found
                    back = myers(item[::-1], window[:end][::-1], distance)
                    best = (distance, low + end - back[1], low + end)
                    if not distance:
                        break
            if best:
                for item_id in ids:
                    yield item_id, *best


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of the raw text that normalises to [start, end) of the whole."""
    at, first, last = 0, 0, 0
    for m in _WORDS.finditer(text):
        word = len(m[0].lower())
        if at <= start < at + word + 1:
            first = m.start() + min(start - at, len(m[0]))
        if at < end:
            last = m.start() + min(end - at, len(m[0]))
        else:
            break
        at += word + 1
    return first, last


class _Shared:
    """A block of items on its way to the workers, each of which builds the search once."""

    def __init__(self, items: list[tuple], budget: Budget):
        self.items, self.budget, self._searcher = items, budget, None

    def __getstate__(self):
        return {"items": self.items, "budget": self.budget, "_searcher": None}

    def searcher(self) -> Searcher:
        if self._searcher is None:
            self._searcher = Searcher(self.items, self.budget)
        return self._searcher


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[bool, list[tuple]]]:
    """(whether more follow, items) in blocks of about block_chars characters, one after
    the other, so that what driver and tasks hold does not grow with the benchmark."""
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)) == b)
        yield b + 1 < blocks, [tuple(r) for r in own.select(id_col, text_col).collect()]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    budget: Budget = Budget(),
    block_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item found in each document, by
    its best match; the span is in the document's characters.

    The documents are read once for each block of items and never shuffled; with more
    than one block, what each finds is a table in the shared folder before the next is
    loaded. Null and empty texts hold nothing; items with null texts or without letters
    and digits are found nowhere; repeated documents and items are each reported.
    """
    types = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, distance int, start int, end int"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for more, block in item_blocks(items, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(_Shared(block, budget))

        def search(batches, shared=shared):
            searcher = shared.value.searcher()
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    for item, distance, start, end in searcher.search(normalise(text)):
                        out.append((None if pd.isna(doc_id) else doc_id, item, distance, *original_span(text, start, end)))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "start", "end"], dtype=object)

        part = texts.mapInPandas(search, types)
        if more or found is not None:
            part = written(part, "contaminated")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", budget: Budget = Budget(), block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no item; each is judged where it lies, without a join.
    With more than one block of items, those that each leaves are written before the
    next is loaded."""
    for more, block in item_blocks(items, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(_Shared(block, budget))

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            searcher = shared.value.searcher()
            for texts in batches:
                yield pd.Series([next(searcher.search(normalise(t)), None) is None for t in texts], dtype=bool)

        docs = docs.filter(clean(F.col(text_col)))
        if more:
            docs = written(docs, "uncontaminated")
    return docs

