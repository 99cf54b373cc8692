"""Records that go over line breaks, read from files in splits.

Files are cut into pieces at a separator that Spark's text reader takes, in splits of any
number. Whether a piece ends a record depends on all that stands before it (is this quote
closed? how deep are the brackets?), so there are two scans. The first tells, for each split
and each state that it may begin in, the state that it ends in and how many records end in
it. The states at the splits' borders follow from these rows, one for each split, on the
driver. The second scan knows them and puts the pieces of each record together; only what
goes over a border, a part at each end of a split, is gathered by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From a quoted field's first character to its closing quote; doubled quotes belong to it.
_CLOSED = re.compile(r'(?:[^"]|"")*+"(?!")')
_ESCAPED = re.compile(r"\\.", re.S)
#: What may stand before a record of an array.
_BEFORE = " \t\r\n,[\ufeff"


class Quotes:
    """Lines of CSV: whether a quoted field goes on over a line's end."""

    separator, level = "\n", 0

    def change(self, line: str, inside: bool) -> tuple[bool, int, bool]:
        """(inside quotes after the line?, change of depth, can a record end here?)"""
        inside = self._after(line, inside)
        return inside, 0, not inside

    def _after(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        at = 0
        if inside:
            closed = _CLOSED.match(line)
            if not closed:
                return True
            at = line.find(",", closed.end()) + 1
            if not at:
                return False
        while True:
            end = at
            if line.startswith('"', at):
                closed = _CLOSED.match(line, at + 1)
                if not closed:
                    return True
                end = closed.end()
            at = line.find(",", end) + 1
            if not at:
                return False

    def blank(self, pieces: list[str]) -> bool:
        """Is this no record?"""
        return len(pieces) == 1 and not pieces[0].strip()

    def text(self, joined: str, ended: bool) -> str:
        return joined


class Brackets:
    """Pieces of a JSON array up to each closing brace: whether a string goes on, and how deep
    the brackets are. Records end where only the array's own bracket is open."""

    separator, level = "}", 1

    def change(self, piece: str, inside: bool) -> tuple[bool, int, bool]:
        parts = _ESCAPED.sub("", piece).split('"')
        outside = "".join(parts[inside::2])
        depth = outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
        inside ^= len(parts) % 2 == 0
        return inside, depth - (not inside), not inside

    def blank(self, pieces: list[str]) -> bool:
        return False

    def text(self, joined: str, ended: bool) -> str:
        return (joined + "}" * ended).lstrip(_BEFORE)


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(file, split) and pieces, in order; a split may come in several parts."""
    for batch in batches:
        files, splits, values = (c.to_pylist() for c in batch.columns)
        start = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or (files[k], splits[k]) != (files[start], splits[start]):
                yield (files[start], splits[start]), values[start:k]
                start = k


def _summed_up(rules: Quotes | Brackets):
    """For each split, and for both answers to whether it begins inside quotes: the answer at
    its end, the change of depth, and how many records end at each depth (as JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for key, values in _by_split(batches):
            for way in found.setdefault(key, [[False, 0, Counter(), False], [True, 0, Counter(), True]]):
                inside, depth, ends, going_on = way
                for value in values:
                    inside, change, closes = rules.change(value, inside)
                    depth += change
                    # a blank line by itself is no record
                    if closes and (going_on or not rules.blank([value])):
                        ends[depth] += 1
                    going_on = not closes
                way[:] = inside, depth, ends, going_on
        rows = [(*key, bool(k), inside, depth, json.dumps(ends)) for key, ways in found.items() for k, (inside, depth, ends, _) in enumerate(ways)]
        names = ["file", "split", "way", "inside", "depth", "ends"]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def _put_together(rules: Quotes | Brackets, begins: dict):
    """Rows (file, split, before, at, first, last, value): records with their number in their
    file; first or last is false if one began before the split or goes on after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], []

        def row(last: bool) -> tuple:
            text = rules.separator.join(held)
            return (*now, before, number, whole, last, rules.text(text, True) if whole and last else text)

        for key, values in _by_split(batches):
            if key != now:
                if held:
                    rows.append(row(False))
                now, held = key, []
                inside, depth, number, whole, before = begins[key]
            for value in values:
                held.append(value)
                inside, change, closes = rules.change(value, inside)
                depth += change
                if closes and depth == rules.level:
                    if not whole or not rules.blank(held):
                        rows.append(row(True))
                        number += 1
                    held, whole = [], True
            if len(rows) > 1000:
                yield _table(rows)
                rows = []
        if held:
            rows.append(row(False))
        yield _table(rows)

    return run


_TYPES = (("file", pa.string()), ("split", pa.int64()), ("before", pa.int64()), ("at", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("value", pa.string()))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])


def whole_records(spark: SparkSession, path: str, rules: Quotes | Brackets, with_header: bool = False) -> DataFrame:
    """(file, before, at, value, ended) of the records of files: at counts a file's records
    from 0 in their order, blank lines of CSV not counted; before is the number of records in
    the files of lesser names, without a first one each where with_header says so; ended is
    false for what is left at the end of a file without the end of a record.

    The files have to stay as they are between the two scans. The driver keeps a row for
    each split (128 MB by default).
    """
    pieces = _pieces(spark, path, rules.separator)
    scanned: dict = {}
    for r in pieces.mapInArrow(_summed_up(rules), "file string, split long, way boolean, inside boolean, depth long, ends string").collect():
        scanned.setdefault(r["file"], {}).setdefault(r["split"], {})[r["way"]] = r
    begins, before = {}, 0
    for file, splits in sorted(scanned.items()):
        inside, depth, number = False, 0, 0
        for k, split in enumerate(sorted(splits)):
            begins[file, split] = (inside, depth, number, k == 0 or not inside and depth == rules.level, before)
            r = splits[split][inside]
            number += json.loads(r["ends"]).get(str(rules.level - depth), 0)
            inside, depth = r["inside"], depth + r["depth"]
        before += number + inside - with_header
    rows = pieces.mapInArrow(_put_together(rules, begins), "file string, split long, before long, at long, first boolean, last boolean, value string")
    whole = rows.filter("first and last").select("file", "before", "at", "value", F.lit(True).alias("ended"))
    # parts of one record have its number, as it counts the records that ended before
    parts = rows.filter("not (first and last)").groupBy("file", "before", "at").agg(F.array_sort(F.collect_list(F.struct("split", "last", "value"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda p: p["value"]), rules.separator)
    ended = F.get(F.col("p"), F.size("p") - 1)["last"]
    if rules.separator == Brackets.separator:
        joined = F.ltrim(F.concat(joined, F.when(ended, "}").otherwise("")), F.lit(_BEFORE))
    return whole.union(parts.select("file", "before", "at", joined, ended))
