"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit for each pattern
character. One pass over a URL moves every rule's state at once: shift, or in the
starts, and with the mask of the character read (Shift-And), where a `*` is a state
that keeps itself alive. Whole Arrow batches of URLs step together.

Globs: `*` any run, also empty; `?` one character; `\\` makes the next one literal.
A glob has to match the whole canonical URL, which is host # path here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Allows or blocks a host with all its subdomains below a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        # neither host nor path can hold a #, so it parts them in the canonical form
        literal = f"{escape(self.host)}#{escape(self.path)}*"
        return [literal, f"*.{literal}"]


@dataclass(frozen=True)
class GlobRule:
    """A free glob over host + # + path, for what no host rule decides."""

    glob: str
    verdict: str


#: The host rules of the URL query, fixed values.
BASE_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

#: What decides where no host rule fits; the first that matches wins.
DEFAULT_GLOBS = (
    GlobRule("*spam*#*", "block"),
    GlobRule("*casino*#*", "block"),
    GlobRule("ads-*#*", "block"),
    GlobRule("*#*.exe", "block"),
    GlobRule("*#*/tracking/*", "block"),
)


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def parse(glob: str) -> list[tuple[str, str]]:
    """(kind, character) with kind one of star, any, char; runs of stars are one."""
    out, chars = [], iter(glob)
    for c in chars:
        if c == "\\":
            out.append(("char", next(chars, "\\")))
        elif c == "*":
            if not out or out[-1][0] != "star":
                out.append(("star", ""))
        else:
            out.append(("any", "") if c == "?" else ("char", c))
    return out


@dataclass
class Automaton:
    """Masks of all globs. A glob of k non-star characters takes k + 1 bits, from its
    start state to its end state; state i loops where a star follows character i."""

    globs: list[str]
    words: int = field(init=False)

    def __post_init__(self):
        starts, ends, loops, byte_bits = [], [], [], {}
        any_bits, at = [], 0
        for glob in self.globs:
            starts.append(at)
            for kind, c in parse(glob):
                if kind == "star":
                    loops.append(at)
                    continue
                at += 1
                if kind == "any":
                    any_bits.append(at)
                else:
                    byte_bits.setdefault(ord(c), []).append(at)
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.start, self.loop, wild = (self._mask(x) for x in (starts, loops, any_bits))
        self.ends = ends
        # a table of the characters that rules name; all others share its last row
        self.codes = np.array(sorted(byte_bits), dtype=np.uint32)
        self.masks = np.stack([self._mask(byte_bits[c]) | wild for c in self.codes.tolist()] + [wild])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix texts x globs."""
        n = len(texts)
        hits = np.zeros((n, len(self.globs)), dtype=bool)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (n, 1))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = 0
        sorted_lengths, begins = lengths[order], (np.cumsum(lengths) - lengths)[order]
        one, carry = np.uint64(1), np.uint64(63)
        while True:
            alive = int(np.searchsorted(-sorted_lengths, -at, side="left"))  # longer than at
            if not alive:
                break
            chars = codes[begins[:alive] + at]
            row = np.searchsorted(self.codes, chars)
            row[row == len(self.codes)] = 0
            row = np.where(self.codes[row] == chars, row, len(self.codes)) if len(self.codes) else row
            old = state[:alive]
            moved = old << one
            moved[:, 1:] |= old[:, :-1] >> carry
            state[:alive] = (moved & self.masks[row]) | (old & self.loop)
            at += 1
        for k, end in enumerate(self.ends):
            hits[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & one == one
        return hits


def canonical_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host with A-Z lower-cased, and path; both empty where there is no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    host_rules: tuple[HostRule, ...] = BASE_RULES,
    globs: tuple[GlobRule, ...] = DEFAULT_GLOBS,
    default: str = "allow",
) -> DataFrame:
    """Adds host, path, rule, verdict and matched_glob to each row; existing columns
    of these names are replaced.

    The longest host rule that fits wins; if none fits, the first glob that matches;
    else `default`. Null URLs and those without `://` have empty parts and get the
    default. No shuffle: rows are judged where they are read.
    """
    patterns = [(g, r.name, r.verdict) for r in sorted(host_rules, key=lambda r: -len(r.name)) for g in r.globs()]
    n_rules = len(patterns)
    patterns += [(g.glob, None, g.verdict) for g in globs]

    names, verdicts = np.array([p[1] for p in patterns] + [None], dtype=object), np.array([p[2] for p in patterns] + [default], dtype=object)
    shown = np.array([p[0] if i >= n_rules else None for i, p in enumerate(patterns)] + [None], dtype=object)

    @F.pandas_udf("rule string, verdict string, matched_glob string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([p[0] for p in patterns])
        for host, path in batches:
            hits = automaton.match((host + "#" + path).tolist())
            # the place after the last pattern stands for no match
            first = np.where(hits.any(axis=1), hits.argmax(axis=1), len(patterns)) if len(patterns) else np.zeros(len(host), dtype=int)
            yield pd.DataFrame({"rule": names[first], "verdict": verdicts[first], "matched_glob": shown[first]})

    host, path = canonical_parts(F.col(url_col))
    judged = pages.withColumns({"host": host, "path": path})
    return judged.withColumn("_judged", judge("host", "path")).select(
        *[judged[c] for c in judged.columns if c not in ("rule", "verdict", "matched_glob")],
        F.col("_judged.rule").alias("rule"),
        F.col("_judged.verdict").alias("verdict"),
        F.col("_judged.matched_glob").alias("matched_glob"),
    )
