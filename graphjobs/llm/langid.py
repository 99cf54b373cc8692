"""Language identification: script ranges, word scores and Viterbi spans.

The script of a word's letters narrows the languages that it can be. Each word is then
scored by its character trigrams under every candidate, and Viterbi picks the best
sequence of languages, where each switch costs a penalty, so that a mixed text falls
into spans. A document gets the language that labels most of its letters.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: First code point and name of the script ranges, fixed values of the Unicode blocks.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = [s for s, _ in SCRIPTS]

#: Buckets that trigrams are hashed to.
BUCKETS = 1 << 16
#: What a change of language costs, in nats.
SWITCH = 12.0
#: Characters that are scored at once.
CHUNK = 1 << 18

_letters: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """Script number + 1 of each code point that is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = SCRIPT_NAMES.index(SCRIPTS[bisect.bisect(_STARTS, c) - 1][1]) + 1
        _letters.append(table)
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, one for each character of the text."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Words:
    """Runs of letters of one script: starts, ends and script numbers, with the bucket
    of the trigram that ends at each character."""

    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    grams: np.ndarray


def split_words(codes: np.ndarray) -> Words:
    script = _script_table()[codes]
    edge = np.flatnonzero(script[1:] != script[:-1]) + 1
    cuts = np.concatenate([[0], edge, [len(codes)]]) if len(codes) else np.zeros(1, dtype=np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    keep = script[starts] > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[keep], ends[keep]
    # characters outside words count as one border character
    c = np.where(script > 0, codes, 0).astype(np.uint64)
    padded = np.concatenate([[0], c, [0]]).astype(np.uint64)
    mixed = (padded[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (padded[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    grams = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    grams = np.append(grams, 0)  # so that the text's end is a place, too
    return Words(starts, ends, script[starts].astype(np.int64) - 1 if len(starts) else np.zeros(0, dtype=np.int64), grams)


@dataclass
class Model:
    """Log-likelihoods of trigram buckets by language, and which scripts each uses."""

    langs: list[str]
    table: np.ndarray  # buckets x languages
    scripts: np.ndarray  # scripts x languages, true for candidates
    prior: int

    def word_scores(self, codes: np.ndarray, words: Words) -> np.ndarray:
        """Words x languages: the summed log-likelihood of each word's trigrams; minus
        infinity for languages that its script rules out. A script that no language
        uses rules out none."""
        out = np.zeros((len(words.starts), len(self.langs)), dtype=np.float64)
        lo = 0
        while lo < len(words.starts):
            hi = max(lo + 1, int(np.searchsorted(words.ends, words.starts[lo] + CHUNK)))
            a, b = words.starts[lo], words.ends[hi - 1]
            # sums of words and of the gaps after them, in turn
            cuts = np.stack([words.starts[lo:hi], words.ends[lo:hi]], axis=1).ravel() - a
            out[lo:hi] = np.add.reduceat(self.table[words.grams[a : b + 1]], cuts, axis=0)[::2]
            lo = hi
        ok = self.scripts | ~self.scripts.any(axis=1, keepdims=True)
        out[~ok[words.scripts]] = -1e9
        return out

    def label(self, text: str | None) -> tuple[np.ndarray, Words, np.ndarray] | None:
        """A language number for each word, the words and their scores."""
        codes = _codes(text or "")
        words = split_words(codes)
        if not len(words.starts):
            return None
        scores = self.word_scores(codes, words)
        return viterbi(scores, SWITCH), words, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.told(text)[:2]

    def told(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language, score, spans) from one labelling of the text."""
        found = self.label(text) if self.langs else None
        if found is None:
            return "und", 0.0, []
        labels, words, scores = found
        letters = np.bincount(labels, weights=words.ends - words.starts, minlength=len(self.langs))
        best = int(letters.argmax())
        # how sure the words labelled so are of it, against the next language
        own = scores[labels == best].sum(axis=0)
        rest = np.exp(np.clip(own - own[best], -50, 50)).sum()
        return self.langs[best], float(letters[best] / letters.sum() / rest), self._spans(labels, words)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the text's stretches in code points, from the first
        letter of each to the last."""
        return self.told(text)[2]

    def _spans(self, labels: np.ndarray, words: Words) -> list[tuple[int, int, str]]:
        cut = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1])
        last = np.concatenate([cut[1:], [len(labels)]]) - 1
        return [(int(words.starts[i]), int(words.ends[j]), self.langs[labels[i]]) for i, j in zip(cut, last)]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best sequence of states, where each change costs the penalty."""
    best = int(scores.sum(axis=0).argmax())
    # What a stretch in another state gains over the best single state is at most `inner`,
    # at the start `first` and at the end `last`. Each stretch pays for the change into
    # it, and a sequence without the best state for all its changes but one, so that
    # under these bounds no change is worth its price.
    gain = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, [best]], axis=0)])
    inner = (gain - np.minimum.accumulate(gain, axis=0)).max()
    first, last = gain.max(), (gain[-1] - gain).max()
    if inner <= penalty and first + last <= penalty:
        return np.full(len(scores), best)
    rows = scores.tolist()
    value, came = rows[0], []
    for row in rows[1:]:
        top = max(value)
        bar = top - penalty
        came.append((value.index(top), [v < bar for v in value]))
        value = [(v if v >= bar else bar) + s for v, s in zip(value, row)]
    state = value.index(max(value))
    path = [state]
    for top, switched in reversed(came):
        if switched[state]:
            state = top
        path.append(state)
    return np.array(path[::-1])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", docs_per_lang: int = 1500) -> Model:
    """Fits trigram counts on about `docs_per_lang` whole documents of each language at
    most, picked by a hash of the key; every labelled row has the same chance.

    Each task counts its own rows into one table of BUCKETS x languages and sends the
    counts; only sums by bucket and language reach the driver, a size that the number
    of languages bounds.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), dtype=bool), 0)
    langs = sorted(sizes)
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, docs_per_lang / sizes[lang]) * 1_000_000)))])
    picked = labelled.filter(F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1_000_000)) < rate[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                codes = _codes(text)
                words, n = split_words(codes), langs.index(lang)
                inside = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(inside, words.starts, 1)
                np.add.at(inside, words.ends, -1)
                grams[n] += np.bincount(words.grams[:-1][np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
                scripts[n] += np.bincount(words.scripts, weights=words.ends - words.starts, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for kind, counts in (("gram", grams), ("script", scripts)):
            i, j = np.nonzero(counts)
            yield pd.DataFrame({"kind": kind, "lang": i, "slot": j, "n": counts[i, j]})

    sums = picked.mapInPandas(count, "kind string, lang int, slot int, n long").groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    for kind, into in (("gram", grams), ("script", scripts)):
        own = sums[sums["kind"] == kind]
        into[own["slot"], own["lang"]] = own["n"]
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, table.astype(np.float32), share > 0.05, langs.index(max(langs, key=lambda x: (sizes[x], x))))


def _shared(spark, model: Model):
    return spark.sparkContext.broadcast(model)


_SPANS = "array<struct<start:int,end:int,lang:string>>"


def _predicted(docs: DataFrame, model: Model, text_col: str) -> F.Column:
    """struct<lang_pred,score,lang_spans> of each text."""
    shared = _shared(docs.sparkSession, model)

    @F.pandas_udf(f"lang_pred string, score double, lang_spans {_SPANS}")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.told(t) for t in texts]
        spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "lang_spans": pd.Series(spans, dtype=object)})

    return predict(F.col(text_col))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_spans, an array of (start, end, lang) in code points
    of the text, to each row; existing columns of these names are replaced. Null texts
    and those without letters get `und`, 0 and no spans."""
    new = ("lang_pred", "score", "lang_spans")
    kept = [c for c in docs.columns if c not in new]
    return docs.withColumn("_lang", _predicted(docs, model, text_col)).select(*kept, *[f"_lang.{c}" for c in new])


def span_list(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ",")


def training_rows(docs: DataFrame, key_col: str = "doc_id") -> F.Column:
    """True for the rows that may be learned from: crc32 of the id mod 5 is not 0."""
    return F.crc32(F.coalesce(F.col(key_col).cast("string"), F.lit(""))) % 5 != 0


def identified_only(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.2) -> DataFrame:
    """The documents whose language is told: those with letters and a score of min_score
    at least, as texts in a script that the model never saw can't reach. Returns the
    columns of docs as they are."""
    own = docs.withColumn("_lang", _predicted(docs, model, text_col))
    return own.filter((F.col("_lang.lang_pred") != "und") & (F.col("_lang.score") >= min_score)).select(*docs.columns)
