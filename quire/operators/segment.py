"""Chunks, paragraphs, sentences and headers of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

CHUNK, OVERLAP = 200, 40
HEADER_WORDS, HEADER_LEAST, HEADER_SHARE = 12, 4, 0.5
PACK = 60


def chunks(df: DataFrame, keys: list[str], text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of words for retrieval (SEG1): ``keys``, chunk_idx, start_word, end_word, content.

    A window starts every ``size - overlap`` words while a word is left, so the last one can lie inside the one before.
    """
    step = size - overlap
    words = df.select(*keys, tx.fields(text).alias("w")).where("size(w) > 0")
    starts = words.select(*keys, "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("start_word"))
    end = F.least(F.col("start_word") + size, F.col("n"))
    return starts.select(*keys, (F.col("start_word") / step).cast("int").alias("chunk_idx"), "start_word", end.alias("end_word"), F.array_join(F.slice("w", F.col("start_word") + 1, size), " ").alias("content"))


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines of texts with their place (``line_idx`` from 0)."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_idx", "line"))


def paragraphs(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Non-empty lines with half-open word ranges over the text (SEG3)."""
    ls = lines(df, keys, text).withColumn("n", tx.word_count("line")).where("n > 0")
    w = Window.partitionBy(*keys).orderBy("line_idx")
    end = F.sum("n").over(w)
    return ls.select(*keys, (F.row_number().over(w) - 1).alias("paragraph_idx"), (end - F.col("n")).alias("word_start"), end.alias("word_end"), F.trim("line").alias("text"))


def packed_sentences(df: DataFrame, keys: list[str], text: str = "text", budget: int = PACK) -> DataFrame:
    """Sentences packed in order into parts of at most ``budget`` words; a longer sentence is a part of its own (SEG5)."""
    empty = F.struct(F.array().cast("array<struct<text:string,n:int>>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(acc, s):
        n = F.size(tx.fields(s))
        flush = (acc["n"] > 0) & (acc["n"] + n > budget)
        done = F.when(flush, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("text"), acc["n"].alias("n"))))).otherwise(acc["done"])
        kept = F.when(flush | (acc["n"] == 0), s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(done.alias("done"), kept.alias("open"), F.when(flush, n).otherwise(acc["n"] + n).alias("n"))

    finish = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("text"), acc["n"].alias("n"))))).otherwise(acc["done"])
    packed = df.select(*keys, F.aggregate(tx.sentences(text), empty, add, finish).alias("parts"))
    return packed.select(*keys, F.posexplode("parts").alias("part_idx", "p")).select(*keys, "part_idx", F.col("p.n").alias("words"), F.col("p.text").alias("text"))


def line_frequency(df: DataFrame, work: str, chapter: str, text: str = "text", most_words: int = HEADER_WORDS) -> DataFrame:
    """In how many chapters of a work each short line stands (AGG13)."""
    short = lines(df, [work, chapter], text).withColumn("line", F.trim("line")).where((F.col("line") != "") & (tx.word_count("line") <= most_words))
    return short.select(work, chapter, "line").distinct().groupBy(work, "line").agg(F.count("*").alias("chapters"))


def running_headers(df: DataFrame, work: str, chapter: str, text: str = "text", least: int = HEADER_LEAST, share: float = HEADER_SHARE) -> DataFrame:
    """Short lines in at least ``least`` chapters and ``share`` of them (AGG13)."""
    total = df.groupBy(work).agg(F.countDistinct(chapter).alias("of"))
    seen = line_frequency(df, work, chapter, text)
    return seen.join(total, work).where((F.col("of") >= least) & (F.col("chapters") >= F.greatest(F.lit(least), F.ceil(F.col("of") * share))))


def without_headers(df: DataFrame, headers: DataFrame, work: str, chapter: str, text: str = "text") -> DataFrame:
    """Texts without the lines that are headers of their work; lines keep their order."""
    ls = lines(df, [work, chapter], text).withColumn("key", F.trim("line"))
    kept = ls.join(headers.select(work, F.col("line").alias("key")), [work, "key"], "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(work, chapter).agg(joined.alias(text))


#: Words below which a section is dropped, and from which what stands ahead of the first is a preface.
SECTION_WORDS, PREFACE_WORDS = 5, 20


def text_chapters(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Chapters of plain texts (SRC8, SEG16): keys, chapter_idx, title, content, word_count.

    They start at headings like "Chapter 7" if there are two or more, else at lines
    of capitals after a blank line, else after two or more blank lines; a text
    without two of either is one chapter.  Short sections fall away; enough words
    ahead of the first start make a preface.
    """
    ls = lines(df, keys, text).withColumn("t", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    w = Window.partitionBy(*keys).orderBy("line_idx")
    blank = F.col("t") == ""
    named = F.col("t").rlike(r"^(?i:chapter|part|book|section)\s+(\d+|[IVXLCivxlc]+)([\s.:—\-].*)?$")
    shouted = ~blank & F.coalesce(F.lag(blank).over(w), F.lit(True)) & F.col("t").rlike(r"^[A-Z][A-Z\s.,;:!?'-]{5,}$")
    parted = ~blank & F.coalesce(F.lag(blank).over(w), F.lit(False)) & F.coalesce(F.lag(blank, 2).over(w), F.lit(False))
    whole = Window.partitionBy(*keys)
    m = ls.withColumn("a", named).withColumn("b", shouted).withColumn("c", parted)
    m = m.withColumn("na", F.count_if("a").over(whole)).withColumn("nb", F.count_if("b").over(whole)).withColumn("nc", F.count_if("c").over(whole))
    start = F.when(F.col("na") >= 2, F.col("a")).when(F.col("nb") >= 2, F.col("b")).when(F.col("nc") >= 2, F.col("c")).otherwise(F.lit(False))
    m = m.withColumn("start", start).withColumn("section", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(w)).withColumn("some", F.greatest(F.when(F.col("na") >= 2, 1).otherwise(0), F.when(F.col("nb") >= 2, 1).otherwise(0), F.when(F.col("nc") >= 2, 1).otherwise(0)))
    numbered = (F.col("na") < 2) & (F.col("nb") < 2)
    title = F.min_by(F.when(numbered, F.concat(F.lit("Section "), F.col("section").cast("string"))).otherwise(F.col("t")), "line_idx")
    first = F.min_by("t", F.when(F.col("t") != "", F.col("line_idx")))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]), "\n"))
    parts = m.groupBy(*keys, "section").agg(title.alias("title"), first.alias("first"), F.max("some").alias("some"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content")).withColumn("word_count", tx.word_count("content"))
    kept = F.when(F.col("some") == 0, F.lit(True)).when(F.col("section") == 0, F.col("word_count") >= PREFACE_WORDS).otherwise(F.col("word_count") >= SECTION_WORDS)
    named_ = F.when(F.col("some") == 0, F.left(F.coalesce("first", F.lit("")), F.lit(80))).when(F.col("section") == 0, "Preface").otherwise(F.col("title"))
    out = parts.where(kept).withColumn("title", named_)
    return out.withColumn("chapter_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("section")) - 1).drop("section", "some", "first")
