"""Queries over word-by-word alignment.

A document is an ebook and each of its lines a chapter; its transcript is the
same line as a narrator might read it: of the words counted from 0, those at 4
of each 11 are left out, after those at 6 of each 13 comes "um", and those at 9
of each 17 become "uh".  Ten words are a paragraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import forced, segment
from quire.plans.base import query, table
from quire.plans.upkeep import _checkpoints

KEYS = ["doc_id", "line_idx"]


def spoken(words: str):
    """The words of a chapter as they are read."""
    said = lambda w, i: F.when(i % 11 == 4, F.array().cast("array<string>")).when(i % 13 == 6, F.array(w, F.lit("um"))).when(i % 17 == 9, F.array(F.lit("uh"))).otherwise(F.array(w))
    return F.flatten(F.transform(words, said))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines(table(spark, sf_dir, "documents"), ["doc_id"]).select(*KEYS, forced.comparable("line").alias("a"))
    _checkpoints(spark)
    return forced.aligned_chapters(lines.withColumn("b", spoken("a")), KEYS, "a", "b").checkpoint()


@query()
def forced_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN7: where each paragraph of ten words lies in the transcript of its chapter, with the chapter's confidence; tested against a full table."""
    aligned = chapters(spark, sf_dir)
    p = aligned.select(*KEYS, "words", F.explode(F.sequence(F.lit(0), F.col("words") - 1, F.lit(10))).alias("word_start"))
    p = p.select(*KEYS, "word_start", F.least(F.col("word_start") + 10, "words").alias("word_end"))
    return forced.paragraph_pairs(aligned, p, KEYS).withColumn("confidence", F.round("confidence", 6))


@query()
def forced_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN7: aligned and skipped chapters of each book and their mean confidence; tested against a full table."""
    return forced.work_confidence(chapters(spark, sf_dir), "doc_id").withColumn("confidence", F.round("confidence", 6))
