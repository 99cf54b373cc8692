"""Character boxes of pages to lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A character of a page.
_CHAR = ("x0", "pos", "top", "text")
#: Dividers of a page at most.
MAX_DIVIDERS = 2
#: Characters that a task sorts at once, in whole pages.
_AT_ONCE = 200_000


def page_arrays(chars: DataFrame) -> DataFrame:
    """(doc, page, page_width, chars): a page's characters in one array. Pages as a reader gives
    them, each a row that already holds its `chars`, stay as they are; of rows for each
    character this is the only shuffle. A page has to fit a task."""
    if "chars" in chars.columns:
        return chars
    item = F.struct(*_CHAR) if {"top", "text"} <= set(chars.columns) else F.struct("x0", F.col("pos") if "pos" in chars.columns else F.lit(0).alias("pos"))
    return chars.groupBy("doc", "page").agg(F.max("page_width").alias("page_width"), F.collect_list(item).alias("chars"))


def with_dividers(pages: DataFrame, gap_ratio: float = 0.05, max_dividers: int = MAX_DIVIDERS) -> DataFrame:
    """Pages (doc, page, page_width, chars) with their dividers array<double>: middles of the
    widest gaps between neighbouring x0, if wider than gap_ratio of the page; of equal gaps
    the left one."""
    x0, width = F.col("chars.x0"), F.col("page_width")
    # equal x0 leave gaps of zero, which are never wide on a page that has a width
    plain = (width >= 0) & ~F.array_contains(x0, F.lit(float("nan")))
    # sorted in a column of their own, so by generated code, which functions with lambdas aren't; nulls come first and have no gap
    pages = pages.withColumn("_places", F.sort_array(F.when(plain, F.array_distinct(x0)).otherwise(x0)))
    after = F.slice("_places", F.lit(2), F.greatest(F.size("_places") - 1, F.lit(0)))
    wide = F.filter(F.zip_with("_places", after, lambda x, y: F.struct((x - y).alias("g"), x.alias("x"))), lambda s: -s["g"] > width * gap_ratio)
    return pages.withColumn("dividers", F.sort_array(F.transform(F.slice(F.sort_array(wide), 1, max_dividers), lambda s: s["x"] - s["g"] / 2))).drop("_places")


def detect_columns(chars: DataFrame, gap_ratio: float = 0.05, max_dividers: int = MAX_DIVIDERS) -> DataFrame:
    """(doc, page, dividers array<double>) of characters (doc, page, x0, page_width) or of pages."""
    return with_dividers(page_arrays(chars), gap_ratio, max_dividers).select("doc", "page", "dividers")


def assign_column(x0: Column, dividers: Column, most: int = MAX_DIVIDERS) -> Column:
    """How many of the dividers, `most` at most, lie at or left of x0."""
    return sum((F.coalesce((F.get(dividers, F.lit(k)) <= x0).cast("int"), F.lit(0)) for k in range(most)), F.lit(0))


def assign_columns(chars: DataFrame) -> DataFrame:
    """(doc, page, pos, col) of characters (doc, page, pos, x0, page_width) or of pages; a
    page's dividers are told in its row and go with its characters."""
    pages = with_dividers(page_arrays(chars)).select("doc", "page", "chars", "dividers")
    # outer, as Spark would else ask for the arrays' sizes first and build them twice; no page is empty
    rows = pages.select("doc", "page", "dividers", F.inline_outer("chars"))
    return rows.select("doc", "page", "pos", assign_column(F.col("x0"), F.col("dividers")).alias("col"))


def _page_texts(tolerance: int):
    """Texts of pages (doc, page, chars, dividers): characters by x0 and pos on lines by column
    and height, to the half-even multiple of the tolerance; a line breaks where column or
    height change. Nulls come first, as in Spark's order."""

    def texts(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def known(values, instead):
            return pc.fill_null(values, instead).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)

        chars, lists = rows.column("chars"), rows.column("dividers")
        n, c = (pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64) for a in (chars, lists))
        chars, places = chars.flatten(), lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(n)), n)
        (x, has_x), (pos, has_pos) = known(chars.field("x0"), -np.inf), known(chars.field("pos"), 0)
        top, has_top = known(chars.field("top"), 0.0)
        line = np.rint(top / tolerance) * tolerance
        col, first = np.zeros(len(of), np.int8), np.cumsum(c) - c
        for k in range(c.max(initial=0)):
            own = np.full(len(n), np.nan)
            own[c > k] = places[first[c > k] + k]
            col += ((own[of] <= x) | np.isnan(x) & (c > k)[of]) & has_x
        text = pc.fill_null(chars.field("text").cast(pa.string()), "")
        keys = [of, col, has_top, line, has_x, x, has_pos, pos]
        keys = [k for k in keys if k.dtype != bool or not k.all()]
        order = np.lexsort(keys[::-1])
        if (alike := np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])).any():
            order = np.lexsort([np.unique(text.to_numpy(zero_copy_only=False), return_inverse=True)[1], *keys[::-1]])
        del alike
        differs = lambda k: (k[order[1:]] != k[order[:-1]])
        other_line = differs(line) & ~(np.isnan(line[order[1:]]) & np.isnan(line[order[:-1]])) | differs(has_top)
        breaks = np.flatnonzero(~differs(of) & (differs(col) | other_line)) + 1
        pieces = pa.concat_arrays([text, pa.array(["\n"])]).take(pa.array(np.insert(order, breaks, len(of))))
        ends = np.concatenate([[0], np.cumsum(n + np.bincount(of[order[breaks]], minlength=len(n)))])
        at = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1) if len(pieces) else np.zeros(1, np.int32)
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(at[ends].astype(np.int32).tobytes()), pieces.buffers()[2] or pa.py_buffer(b""))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            past = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("chars")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(past):
                to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + _AT_ONCE, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("page"), texts(part)], ["doc", "page", "text"])
                at = to

    return run


def reconstruct_lines(chars: DataFrame, tolerance: int = 5) -> DataFrame:
    """(doc, text) of characters (doc, page, pos, x0, top, text, page_width) or of pages: the
    pages' texts one after the other. Gaps, columns and lines are told within a page's row,
    lines in batches of whole pages, and only finished texts are shuffled by document."""
    pages = with_dividers(page_arrays(chars)).select("doc", "page", "chars", "dividers")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    texts = pages.mapInArrow(_page_texts(tolerance), f"doc {kinds['doc']}, page {kinds['page']}, text string").select("doc", F.struct("page", "text").alias("p"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["text"]), "\n")
    return texts.groupBy("doc").agg(whole.alias("text"))
