"""Toxicity by a weighted lexicon.

Texts are folded first: case, marks, look-alike letters and digits that stand for
letters. One Aho-Corasick pass finds the words that begin with one of the lexicon's
stems, unless an exception phrase covers them, and the weights are set against the
text's length. Stems, weights and the scale of the score are learned from labelled
rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Look-alikes of Latin letters, fixed values: Cyrillic, Greek, then signs and digits.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Phrases in which a listed word is harmless whatever the labels say; further ones are
#: learned, and tables of them can be passed to train().
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "worthless check", "circus clown", "sore loser")

_TOKEN = re.compile(r"[\w@$]+")


class _Fold(dict):
    """A translation table that folds a character when it is first seen."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out = "".join(LOOKALIKES.get(x, x) for x in out)
        self[code] = out
        return out


_FOLD = _Fold()
_DIGIT = str.maketrans(DIGITS)
_MIXED = re.compile(r"[\w@$]*[0-9@$][\w@$]*")


def _undigit(m: re.Match) -> str:
    # only digits among letters stand for letters: 1d10t, but not 2024
    w = m[0]
    return w.translate(_DIGIT) if any(c.isalpha() for c in w) else w


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _MIXED.sub(_undigit, text)


@dataclass
class Lexicon:
    """Weights of folded stems, exceptions, and the scale of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def _built(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w in self.weights:
                a.add_word(w, (len(w), self.weights[w]))
            for p in self.exceptions:
                folded = fold(p)
                if folded not in self.weights:
                    a.add_word(folded, (len(folded), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of listed stems that begin a word outside exception
        phrases."""
        a = self._built()
        found, covered = [], []  # exceptions come in the order of their ends
        if len(a):
            for last, (length, weight) in a.iter(folded):
                s, e = last - length + 1, last + 1
                if not s or not folded[s - 1].isalnum():
                    (covered if weight is None else found).append((s, e, weight))
        if not covered:
            return found
        covered.sort()
        starts = [s for s, _, _ in covered]
        furthest = list(accumulate((e for _, e, _ in covered), max))
        # of the exceptions that begin before a hit one has to reach over its end
        return [h for h in found if not (i := bisect_right(starts, h[0])) or furthest[i - 1] < h[1]]

    def phrases(self, text: str | None) -> list[str]:
        """Each two words of the text of which one begins with a stem, as they stand."""
        folded = fold(text)
        words = [m.span() for m in _TOKEN.finditer(folded)]
        starts = [s for s, _ in words]
        out = []
        for s, _, _ in self.hits(folded):
            i = bisect_right(starts, s) - 1
            out += [folded[words[a][0] : words[a + 1][1]] for a in (i - 1, i) if 0 <= a < len(words) - 1]
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weights, and the same for each hundred words."""
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        words = len(_TOKEN.findall(folded)) if total else 0
        return total, 100 * total / max(words, 20) if total else 0.0

    def score(self, text: str | None) -> float:
        bias, by_sum, by_rate = self.scale
        total, rate = self.features(text)
        z = bias + by_sum * np.log1p(total) + by_rate * np.log1p(rate)
        return float(1 / (1 + np.exp(-z)))


def _fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps; slopes are not negative."""
    x = np.concatenate([np.ones((len(x), 1)), np.log1p(x)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.01 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


#: Lengths of stems.
SHORTEST, LONGEST = 3, 12


def _choose(bad: dict[str, tuple[int, int]], bad_words: int, good: dict[str, int], good_words: int, min_ratio: float) -> dict[str, float]:
    """Stem -> weight, from the candidates' (texts, uses) in toxic and uses in other
    texts. No chosen stem begins with another."""
    told = {}
    for stem, (docs, uses) in bad.items():
        ratio = (uses / bad_words) / ((good.get(stem, 0) + 1) / (good_words + 1))
        if ratio >= min_ratio:
            told[stem] = (docs * float(np.log(ratio)), len(stem), float(np.log(ratio)))
    out: dict[str, float] = {}
    for stem in sorted(told, key=lambda x: (*told[x][:2], x), reverse=True):
        if not any(stem[:k] in out for k in range(SHORTEST, len(stem))) and not any(x.startswith(stem) for x in out):
            out[stem] = told[stem][2]
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", max_rows: int = 4000, min_share: float = 0.02, min_ratio: float = 8.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from about `max_rows` labelled rows at most of each label, picked by a
    hash of the key; equal texts count once. The picked labels, of which there are no
    more, are broadcast to the documents.

    Candidates are the beginnings of words that occur in `min_share` of the toxic texts
    and in five of them at least. A stem enters the lexicon if toxic texts use it
    `min_ratio` times as often, word for word, as the others; its weight is the log of
    that ratio. Of stems that contain each other the one that tells most is kept. Two
    words of which one begins with a stem become an exception if five other texts have
    them and toxic texts, word for word, at most an eighth as often. Only the
    candidates' counts and two numbers for each sampled text reach the driver.
    """
    own = labels.select(F.col(key_col).alias("key"), (F.col(label_col) == 1).cast("int").alias("y")).filter("y is not null")
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("y") == 1, F.lit(max_rows / max(1, sizes.get(1, 0)))).otherwise(F.lit(max_rows / max(1, sizes.get(0, 0))))
    own = own.filter(F.pmod(F.xxhash64("key", F.lit("toxic")), F.lit(1_000_000)) < rate * 1_000_000)
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).filter("text is not null")
    picked = texts.join(F.broadcast(own), "key").dropDuplicates(["text", "y"]).select("text", "y").checkpoint()

    def stems(batches):
        docs, uses, words, texts = Counter(), Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                seen = Counter(_TOKEN.findall(fold(text)))
                own = Counter()
                for w, n in seen.items():
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        own[w[:k]] += n
                docs.update(own.keys())
                uses.update(own)
                words += seen.total()
                texts += 1
        yield pd.DataFrame([("", texts, words), *((g, n, uses[g]) for g, n in docs.items())], columns=["stem", "docs", "uses"])

    bad = picked.filter("y = 1").select("text").mapInPandas(stems, "stem string, docs long, uses long")
    bad = bad.groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).checkpoint()
    total = bad.filter("stem = ''").first()
    if not total or not total.docs:
        return Lexicon({}, scale=(-4.0, 0.0, 0.0))
    least = max(5, min_share * total.docs)
    rows = bad.filter((F.col("stem") != "") & (F.col("docs") >= least)).collect()
    wanted = {r.stem: (r.docs, r.uses) for r in rows}

    def against(batches):
        uses, words = Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                for w in _TOKEN.findall(fold(text)):
                    words += 1
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        if w[:k] in wanted:
                            uses[w[:k]] += 1
        yield pd.DataFrame([("", words), *uses.items()], columns=["stem", "uses"])

    good = picked.filter("y = 0").select("text").mapInPandas(against, "stem string, uses long")
    good = {r.stem: r.uses for r in good.groupBy("stem").agg(F.sum("uses").alias("uses")).collect()}
    lexicon = Lexicon(_choose(wanted, total.uses, good, good.get("", 0), min_ratio), tuple(exceptions))

    def pairs(batches):
        docs, uses = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch["y"].tolist(), batch["text"]):
                own = Counter(lexicon.phrases(text))
                docs.update((p, y) for p in own)
                uses.update({(p, y): n for p, n in own.items()})
        yield pd.DataFrame([(p, y, n, uses[p, y]) for (p, y), n in docs.items()], columns=["phrase", "y", "docs", "uses"])

    counted = picked.mapInPandas(pairs, "phrase string, y int, docs long, uses long").groupBy("phrase")
    toxic, other = F.col("y") == 1, F.col("y") == 0
    sums = counted.agg(F.sum(F.when(other, F.col("docs"))).alias("docs"), F.sum(F.when(other, F.col("uses"))).alias("good"), F.coalesce(F.sum(F.when(toxic, F.col("uses"))), F.lit(0)).alias("bad"))
    harmless = sums.filter(F.col("docs") >= 5).filter(F.col("bad") * (min_ratio * good.get("", 0) / total.uses) <= F.col("good")).select("phrase").collect()
    lexicon = replace(lexicon, exceptions=(*lexicon.exceptions, *sorted(r.phrase for r in harmless)))

    @F.pandas_udf("total double, rate double")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexicon.features(t) for t in texts], columns=["total", "rate"], dtype="float64")

    sample = picked.select("y", features("text").alias("f")).select("y", "f.total", "f.rate").toPandas().sort_values(["y", "total", "rate"])
    lexicon.scale = _fit_scale(sample[["total", "rate"]].to_numpy(float), sample["y"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if the score reaches the threshold) to each
    row; existing columns of these names are replaced. Null texts are empty ones and
    get the score of a text without hits."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.withColumn("_score", rate(F.col(text_col))).select(*kept, F.col("_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(key: F.Column) -> F.Column:
    """True for the rows that may be learned from: crc32 of the id mod 3 is not 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 != 1
