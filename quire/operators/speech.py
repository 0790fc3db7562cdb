"""Texts made ready to be spoken: front matter dropped by regions of lines, headings and pauses written out.

Whether a line belongs to a region, and what stands ahead of it, follows from
the last marker and the last empty line before it: windows over the lines of a
chapter in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import segment

#: What opens a region that is skipped up to the next empty line; the case counts.
REGION_OPENS = (
    "*** START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG",
    "The Project Gutenberg eBook", "Produced by", "This eBook is for the use of",
)
#: Lines and titles that are no part of the work, in any case.
SKIPPED_LINES = ("project gutenberg", "www.gutenberg.org", "produced by", "transcriber's note", "end of the project")
SKIPPED_TITLES = ("project gutenberg", "table of contents", "contents", "the full project", "license")
#: The list of editions with its two kinds of lines, and the label of an editor's note.
EDITIONS = "(?i)^There are several editions of this ebook in the Project Gutenberg"
EDITION_LINE = r"(?i)^Click on any of the file ?numbers|^\d{2,6}\s*\(|^$"
EDITORS_NOTE = "(?i)Project Gutenberg('?s)? Editor'?s Note"
#: Bytes from which a line in capitals is no heading, and words of a title that are compared.
HEADING_BYTES, TITLE_WORDS = 80, 24


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def all_capitals(text: Column) -> Column:
    """Whether a text has letters and none of them is small (SCA50)."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}")


def title_cased(text: Column) -> Column:
    """Every word of plain letters with a capital, all else small."""
    words = F.split(F.lower(text), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w)), "")


def opening_words(text: Column, most: int = TITLE_WORDS) -> Column:
    """The first words of plain letters and digits (OTH23)."""
    return F.slice(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""), 1, most)


def opens_with(content: Column, title: Column) -> Column:
    """Whether a text starts with the words of its title, as far as twenty-four go (OTH23); a title without words opens nothing."""
    t = opening_words(title)
    return (F.size(t) > 0) & (F.slice(opening_words(content), F.lit(1), F.greatest(F.size(t), F.lit(1))) == t)


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    found = text.contains(marks[0])
    for m in marks[1:]:
        found |= text.contains(m)
    return found


def _in_order(keys: list[str]):
    w = Window.partitionBy(*keys).orderBy("line_idx")
    last = lambda cond, w: F.max(F.when(cond, F.col("line_idx"))).over(w)
    return w, last, w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def without_skipped_regions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines outside the regions that a marker opens and the next empty line closes (SEG15); the lines at either end are in it."""
    _, last, upto, before = _in_order(keys)
    t = trimmed(F.col("line"))
    seen = lines.withColumn("__open", last(_any_of(t, REGION_OPENS), upto)).withColumn("__shut", last(t == "", before))
    return seen.where("__open is null or __shut >= __open").drop("__open", "__shut")


def without_apparatus(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without lists of editions and editors' notes (SCA25).

    A list goes from its first line through empty lines, entries and the line that
    tells to click.  A note's label that ends in a colon takes the next line along,
    whatever that is; of labels in a row every other one is such a next line.
    """
    w, last, upto, before = _in_order(keys)
    t = trimmed(F.col("line"))
    marked = lines.withColumn("__label", t.rlike(EDITORS_NOTE) & ~t.rlike(EDITIONS)).withColumn("__takes", F.col("__label") & t.endswith(":"))
    # A line is taken if an odd number of labels that take stand in a row right before it.
    marked = marked.withColumn("__i", F.row_number().over(w))
    marked = marked.withColumn("__run", F.col("__i") - 1 - F.coalesce(F.max(F.when(~F.col("__takes"), F.col("__i"))).over(before), F.lit(0)))
    marked = marked.withColumn("__taken", F.col("__run") % 2 == 1)
    own = ~F.col("__taken")
    opens = own & t.rlike(EDITIONS)
    marked = marked.withColumn("__open", last(opens, upto)).withColumn("__shut", last(own & ~t.rlike(EDITIONS) & ~t.rlike(EDITION_LINE), upto))
    listed = F.col("__open").isNotNull() & (F.col("__shut").isNull() | (F.col("__shut") < F.col("__open")))
    return marked.where(~(listed | F.col("__taken") | F.col("__label"))).select(*lines.columns)


def prepared(chapters: DataFrame, keys: list[str], title: str, text: str) -> DataFrame:
    """Chapters as they are to be spoken (SEG15): keys and speech.

    Regions that are no part of the work go first, then lines that only say so or
    repeat the title.  Headings in capitals are written as titles and end in a full
    stop; an empty line is a pause, lines without one between them are one
    paragraph.  A heading after an empty line follows at once what was before it.
    The title comes first, unless the text opens with it.
    """
    named = chapters.select(*keys, trimmed(F.coalesce(title, F.lit(""))).alias("__title"), F.coalesce(text, F.lit("")).alias("__text"))
    lines = segment.lines(named, [*keys, "__title"], "__text")
    _, last, _, before = _in_order(keys)
    inside = without_skipped_regions(lines, keys)
    t = trimmed(F.col("line"))
    skip = (F.lower(t) == F.lower("__title")) | _any_of(F.lower(t), SKIPPED_LINES)
    heading = all_capitals(t) & (F.octet_length(t) < HEADING_BYTES)
    kind = F.when(t == "", "gap").when(skip, "skip").when(heading, "head").otherwise("body")
    k = inside.withColumn("t", t).withColumn("kind", kind)
    said = F.col("kind").isin("head", "body")
    k = k.withColumn("prev", last(said, before)).withColumn("gap", last(F.col("kind") == "gap", before)).withColumn("prev_head", last(F.col("kind") == "head", before))
    paused = (F.col("gap").isNotNull() & (F.col("prev").isNull() | (F.col("gap") > F.col("prev")))) | F.coalesce(F.col("prev_head") == F.col("prev"), F.lit(False))
    ahead = F.when(F.col("kind") == "head", F.when(paused, "").otherwise("\n\n")).when(F.col("kind") == "body", F.when(paused, "\n\n").otherwise(" "))
    titled = title_cased(F.col("t"))
    words = F.when(F.col("kind") == "head", F.concat(titled, F.when(titled.rlike("[.!?]$"), "").otherwise("."), F.lit("\n\n"))).when(F.col("kind") == "body", F.col("t"))
    row = F.struct("line_idx", "line", ahead.alias("ahead"), words.alias("words"), (said & F.col("prev").isNull()).alias("first"))
    whole = k.select(*keys, row.alias("row")).groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    whole = named.join(whole, keys, "left").withColumn("rows", F.coalesce("rows", F.array().cast(whole.schema["rows"].dataType)))
    content = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    wanted = (F.col("__title") != "") & ~_any_of(F.lower("__title"), SKIPPED_TITLES) & ~opens_with(content, F.col("__title"))
    shown = F.when(wanted, F.concat(F.when(all_capitals(F.col("__title")), title_cased(F.col("__title"))).otherwise(F.col("__title")), F.lit(".\n\n"))).otherwise("")
    spoken = F.transform("rows", lambda r: F.concat(F.when(r["first"] & ~F.col("__wanted"), "").otherwise(F.coalesce(r["ahead"], F.lit(""))), F.coalesce(r["words"], F.lit(""))))
    return whole.withColumn("__wanted", wanted).withColumn("__shown", shown).select(*keys, trimmed(F.concat("__shown", F.array_join(spoken, ""))).alias("speech"))
