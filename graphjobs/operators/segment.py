"""Texts to cleaned, relevant paragraphs with seasons.

Everything that concerns one text happens within its row, in time that grows with the
text: runs of lines, sentences and blocks are told by marks in one string, not by folds
that copy arrays. Rows are made of finished paragraphs only, so that no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import text as X
from ..sources.scratch import broadcast_if_small, written

#: Marks that part pieces of a text; cleaning drops them from texts before.
_PART, _END = "\x01", "\x02"


def section_patterns(cfg: C.TextConfig) -> tuple[str, str]:
    """Expressions for what follows a line of references, to the end, and for a line of
    an abstract or keywords with all lines up to a blank one; both start at a line's
    break, so the text gets one in front. The repeated parts are possessive: they step
    from line to line and never go back, however many lines there are."""
    refs = rf"(?s)\n[^\n]*(?:{X.in_any_case(cfg.reference_marks)}).*"
    filled = rf"\n[{X.WS.replace(chr(92) + 'x09-' + chr(92) + 'x0d', chr(92) + 'x09' + chr(92) + 'x0b-' + chr(92) + 'x0d')}]*+[^{X.WS}][^\n]*+"
    abstract = rf"\n[^\n]*(?:{X.in_any_case(cfg.abstract_marks)})[^\n]*+(?:{filled})*+"
    return refs, abstract


def filter_sections(text: Column, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> Column:
    """The lines that are left of a text without its references, abstract, keywords and
    front matter. Null is empty."""
    refs, abstract = section_patterns(cfg)
    body = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), refs, "")
    body = F.regexp_replace(body, abstract, "\n")
    lines = F.transform(F.split(body, "\n"), X.strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~X.skip_line(x, cfg, raw)), "\n")


def _kept(paragraph: Column, cfg: C.TextConfig) -> Column:
    return X.valid_paragraph(paragraph, cfg) & X.relevant(paragraph, cfg)


def chunk_sentences(text: Column, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> Column:
    """array of chunks: sentences are joined until they reach the target length; chunks
    that aren't valid and relevant are dropped."""
    sentences = F.transform(F.split(X.clean_paragraph_text(text, raw=raw), cfg.sentence_marks), X.strip)
    whole = F.array_join(F.filter(sentences, lambda s: s != ""), _PART)
    # so many characters and what is left of the sentence; at the end whatever there is
    chunk = rf"(?s)(?:{_PART}?[^{_PART}]){{{cfg.target}}}[^{_PART}]*+|{_PART}?[^{_PART}].*"
    chunks = F.transform(F.regexp_extract_all(whole, F.lit(chunk), F.lit(0)), lambda c: F.replace(c, F.lit(_PART), F.lit("")))
    return F.filter(chunks, lambda c: _kept(c, cfg))


def split_paragraphs(text: Column, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> Column:
    """array of paragraphs from blocks between blank lines. Short blocks, and blocks after
    one without a closing mark, are joined to it; fewer than three kept paragraphs give
    way to chunks of sentences."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda b: X.clean_paragraph_text(X.strip(b), raw=raw))
    blocks = F.filter(blocks, lambda b: b != "")

    def paragraphs(blocks: Column) -> Column:
        def begins(block: Column, i: Column) -> Column:
            closed = F.contains(F.lit(cfg.closing_marks), F.substring(F.get(blocks, i - 1), -1, 1))
            return (i > 0) & (F.length(block) >= 100) & closed

        marked = F.transform(blocks, lambda b, i: F.when(begins(b, i), F.concat(F.lit(_END), b)).otherwise(b))
        return F.filter(F.split(F.array_join(marked, ""), _END), lambda p: _kept(p, cfg))

    # bound to variables, as the blocks would be cleaned again for each mention
    found = F.transform(F.array(blocks), paragraphs)
    pick = F.transform(found, lambda f: F.when(F.size(f) < 3, chunk_sentences(text, cfg, raw)).otherwise(f))
    return F.get(pick, F.lit(0))


def document_paragraphs(docs: DataFrame, cfg: C.TextConfig = C.TextConfig(), raw: bool = False) -> DataFrame:
    """(doc, full_text, paragraphs array<string>) of documents (doc, text)."""
    rows = docs.select("doc", F.coalesce("text", F.lit("")).alias("full_text"))
    # bound to a variable, as the text would be filtered again for each mention
    bodies = F.array(filter_sections(F.col("full_text"), cfg, raw))
    return rows.select("doc", "full_text", F.get(F.transform(bodies, lambda b: split_paragraphs(b, cfg, raw)), F.lit(0)).alias("paragraphs"))


def in_rows(docs: DataFrame, *keep: str, items: str) -> DataFrame:
    """A row for each struct of the array `items`, with its fields. An inner explode would
    also ask each scanned row for the size of the array, and so compute it twice."""
    rows = docs.select(*keep, F.explode_outer(items).alias("_item")).filter("_item is not null")
    return rows.select(*keep, "_item.*")


def whole_parts(paragraphs: Column) -> Column:
    """array<struct<pos,segment,paragraph,season>> of paragraphs without headings."""
    none = F.lit(None).cast("string")
    return F.transform(paragraphs, lambda p, i: F.struct(i.alias("pos"), F.lit(0).alias("segment"), p.alias("paragraph"), none.alias("season")))


def split_headings(paragraphs: Column, cfg: C.TextConfig = C.TextConfig(), min_chars: int = 20) -> Column:
    """array<struct<pos,segment,paragraph,season>> of a document's paragraphs, whose
    headings `01 term LETTERS` tell the season of what follows, across paragraphs.

    A paragraph that begins with a heading is dropped, but sets the season. Headings
    within one cut it; pieces of more than min_chars stay. season is null before the
    first heading of a document.
    """
    gap = r"[\s\x{3000}]+"
    named = rf"\p{{Nd}}{{1,2}}{gap}({X.alternatives(cfg.terms)}){gap}[A-Z]+"
    any_heading = rf"\p{{Nd}}{{1,2}}{gap}[\x{{4e00}}-\x{{9fff}}]{{2,3}}{gap}[A-Z]+"
    none = F.lit(None).cast("string")

    def part(pos: Column, segment: Column, text: Column, heading: Column, cut: Column) -> Column:
        return F.struct(pos.alias("pos"), segment.alias("segment"), text.alias("text"), heading.alias("heading"), cut.alias("cut"))

    def parts(p: Column, pos: Column) -> Column:
        opening = F.regexp_extract(X.strip(p), rf"\A{named}", 1)
        pieces, terms = F.split(p, named, -1), F.regexp_extract_all(p, F.lit(named), F.lit(1))
        cut = F.transform(pieces, lambda x, i: part(pos, i, X.strip(x), F.when(i > 0, F.get(terms, i - 1)), F.lit(True)))
        first = lambda text, heading: F.array(part(pos, F.lit(0), text, heading, F.lit(False)))
        return F.when(opening != "", first(none, opening)).when(~p.rlike(any_heading), first(p, none)).otherwise(cut)

    def carried(rows: Column) -> Column:
        places = F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["heading"].alias("heading")))
        start = F.array(F.struct(F.lit(0).alias("at"), none.alias("heading")))
        bounds = F.concat(start, F.filter(places, lambda h: h["heading"].isNotNull()))

        def under(bounds: Column) -> Column:
            def stretch(b: Column, k: Column) -> Column:
                until = F.coalesce(F.get(bounds, k + 1)["at"], F.size(rows))
                own = F.slice(rows, b["at"] + 1, until - b["at"])
                return F.transform(own, lambda r: F.struct(r["pos"].alias("pos"), r["segment"].alias("segment"), r["text"].alias("paragraph"), b["heading"].alias("season"), r["cut"].alias("cut")))

            return F.flatten(F.transform(bounds, stretch))

        return F.get(F.transform(F.array(bounds), under), F.lit(0))

    rows = F.transform(F.array(F.flatten(F.transform(paragraphs, parts))), carried)
    kept = F.filter(F.get(rows, F.lit(0)), lambda r: r["paragraph"].isNotNull() & (~r["cut"] | (F.length(r["paragraph"]) > min_chars)))
    return F.transform(kept, lambda r: r.dropFields("cut"))


def with_seasons(parts: Column, full_text: Column, cfg: C.TextConfig = C.TextConfig()) -> Column:
    """array<struct<pos,segment,context,season>>: the carried season or the detected one;
    line breaks become two spaces."""
    return F.transform(
        parts,
        lambda r: F.struct(
            r["pos"].alias("pos"),
            r["segment"].alias("segment"),
            F.replace(r["paragraph"], F.lit("\n"), F.lit("  ")).alias("context"),
            F.coalesce(r["season"], X.detect_season(r["paragraph"], full_text, cfg)).alias("season"),
        ),
    )


def paragraph_lists(docs: DataFrame, cfg: C.TextConfig = C.TextConfig(), raw: bool = False, headings: bool = False) -> DataFrame:
    """(doc, parts: array<struct<pos,segment,context,season>>) of documents (doc, text)."""
    rows = document_paragraphs(docs, cfg, raw)
    parts = split_headings(F.col("paragraphs"), cfg) if headings else whole_parts(F.col("paragraphs"))
    return rows.select("doc", with_seasons(parts, F.col("full_text"), cfg).alias("parts"))


def paragraphs_of(docs: DataFrame, cfg: C.TextConfig = C.TextConfig(), raw: bool = False, headings: bool = False) -> DataFrame:
    """(doc, pos, segment, context, season) of documents (doc, text); seasons are told in
    the document's row, before it becomes many."""
    return in_rows(paragraph_lists(docs, cfg, raw, headings), "doc", items="parts")


def number_paragraphs(lists: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(id, title, context, season) of documents (doc, parts): ids from 1 in the order of
    documents' names, then of their parts. Documents of one name go one after the other.

    An id is its document's offset and the place in its list. Offsets are a sum over
    (doc, number of parts) in two levels: within ranges of names, and over the ranges, whose
    sums reach the driver. Texts are a table first, as they are needed after their number is
    known; they are not sorted, nor moved while there are `most` documents at most. Beyond,
    the join with the offsets moves each list once.
    """
    kept = written(lists.select(F.monotonically_increasing_id().alias("_row"), "doc", "parts", F.coalesce(F.size("parts"), F.lit(0)).alias("_n")), "parts")
    ranged = kept.select("_row", "doc", "_n").filter("_n > 0").repartitionByRange("doc", "_row")
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "part-counts")
    before, sums = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect()):
        sums.append((r["_range"], before))
        before += r.n
    starts = ranged.sparkSession.createDataFrame(sums, "_range int, _start long")
    earlier = Window.partitionBy("_range").orderBy("doc", "_row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.join(F.broadcast(starts), "_range").select("_row", (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_before"))
    placed = kept.join(broadcast_if_small(written(offsets, "offsets"), most), "_row")
    title = X.normalize_title(F.col("doc"))
    rows = placed.select("_before", title.alias("title"), F.posexplode_outer("parts").alias("_pos", "_item")).filter("_item is not null")
    return rows.select((F.col("_before") + F.col("_pos") + 1).alias("id"), "title", "_item.context", "_item.season")


def paragraph_stats(paragraphs: DataFrame) -> DataFrame:
    n, titles = F.count("*"), F.count_distinct("title")
    return paragraphs.agg(titles.alias("titles"), n.alias("paragraphs"), F.when(titles > 0, n / titles).alias("avg_per_title"))
