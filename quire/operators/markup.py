"""Edits of blocks in the markup of pages that leave every other byte as it is.

A page is cut at the blocks that a pattern finds and at what lies between them;
both lists together are the page, so what is not taken out stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.titles import let
from quire.operators import segment

#: Elements that can hold a running header, and the headings of a page.
BLOCK = r"(?is)<(?:p|h[1-6]|div)\b[^>]*>.*?</(?:p|h[1-6]|div)>"
HEADING, FIRST_HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>", r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"
#: Words that open the heading of a chapter; a Roman or a short number alone is one too.
CHAPTER_WORDS = ("chapter", "stave", "part", "book", "letter", "canto", "act", "scene", "prologue", "epilogue", "volume")
CHAPTER_LIKE = rf"(?i)^\s*((?:{'|'.join(CHAPTER_WORDS)})\b|[ivxlcdm]{{1,7}}\.?\s*$|\d{{1,3}}\.?\s*$)"


def visible(block: Column) -> Column:
    """Text of a block as a header is compared: no tags, straight quotes, single spaces."""
    plain = F.translate(F.regexp_replace(block, r"(?s)<[^>]*>", ""), "‘’“”", "''\"\"")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^ | $", "")


def _woven(html: Column, pattern: str) -> Column:
    """Parts of a page in order: what lies before a match, the match, and so on, what lies after the last."""
    found = F.struct(F.split(html, pattern, -1).alias("between"), F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("found"))
    return let(found, lambda x: F.flatten(F.zip_with(x["between"], x["found"], lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def block_spans(pages: DataFrame, keys: list[str], html: str, pattern: str = BLOCK) -> DataFrame:
    """Blocks of pages by place (OTH24): keys, n (from 0), start and stop in characters, text."""
    parts = pages.select(*keys, F.posexplode(_woven(F.col(html), pattern)).alias("i", "part"))
    size = F.length("part")
    stop = F.sum(size).over(Window.partitionBy(*keys).orderBy("i"))
    spans = parts.select(*keys, "i", (stop - size).alias("start"), stop.alias("stop"), visible(F.col("part")).alias("text")).where("i % 2 = 1 and stop > start")
    return spans.select(*keys, F.floor(F.col("i") / 2).cast("int").alias("n"), "start", "stop", "text")


def header_blocks(pages: DataFrame, work: str, page: str, html: str, **limits) -> DataFrame:
    """Blocks that are running headers of their work (AGG13): work, line; limits as for lines."""
    shown = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(0)), visible), "\n")
    return segment.running_headers(pages.select(work, page, shown.alias("shown")), work, page, "shown", **limits).select(work, "line")


def without_blocks(html: Column, unwanted: Column) -> Column:
    """A page without the blocks whose whole text is one of ``unwanted`` (OTH24)."""
    kept = lambda part, i: F.when((i % 2 == 1) & F.array_contains(unwanted, visible(part)), "").otherwise(part)
    return F.when(F.size(unwanted) > 0, F.array_join(F.transform(_woven(html, BLOCK), kept), "")).otherwise(html)


def without_header_blocks(pages: DataFrame, headers: DataFrame, work: str, html: str) -> DataFrame:
    """``pages`` without the blocks that are headers of their work (OTH24); ``headers``: work, line."""
    listed = headers.groupBy(work).agg(F.collect_set("line").alias("__headers"))
    none = F.array().cast("array<string>")
    return pages.join(listed, work, "left").withColumn(html, without_blocks(F.col(html), F.coalesce("__headers", none))).drop("__headers")


def first_heading(html: Column) -> Column:
    """Text of the first heading of the three upper ranks, empty if none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(html, FIRST_HEADING, 1), r"<[^>]*>", ""), r"^\s+|\s+$", "")


def chapters_of_page(html: Column) -> Column:
    """Parts of a page cut before each chapter heading (SCA27): array of (title, html) that joined give the page.

    What stands before the first is a part of its own; a page with fewer than two chapter headings is one part.
    """

    def cut(parts: Column) -> Column:
        like = lambda i: F.regexp_replace(F.get(parts, i), r"(?s)<[^>]+>", "").rlike(CHAPTER_LIKE)
        starts = F.filter(F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))), like)
        lead = F.when(F.get(parts, 0) != "", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return let(F.when(F.size(starts) >= 2, F.concat(F.when(F.get(starts, 0) > 1, F.array(F.lit(0))).otherwise(lead), starts)).otherwise(F.array(F.lit(0))), lambda at: joined(parts, at))

    def joined(parts: Column, at: Column) -> Column:
        until = lambda i: F.coalesce(F.get(at, i + 1), F.size(parts))
        htmls = F.transform(at, lambda a, i: F.array_join(F.slice(parts, a + 1, until(i) - a), ""))
        return F.transform(htmls, lambda h: F.struct(first_heading(h).alias("title"), h.alias("html")))

    return let(_woven(html, HEADING), cut)
