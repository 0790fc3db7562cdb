"""Derived tables of a library kept in partitions, and works that come anew.

A table is dealt to partitions by a hash of its work.  A re-import writes only
the partitions that hold one of the works that came anew: what other works have
there stays, what these had is replaced.  Spark puts the new partitions in place
when all of them are written, and running it again gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import segment

PART = "part"
#: Partitions of a table; a few thousand works share one.
PARTS = 64


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def store(tables: dict[str, DataFrame], root: str, key: str, parts: int = PARTS) -> None:
    """Write tables for the first time; a partition is one task's, so it is few files."""
    for name, df in tables.items():
        df.withColumn(PART, part_of(key, parts)).repartition(PART).write.partitionBy(PART).parquet(f"{root}/{name}")


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def reimport(fresh: dict[str, DataFrame], works: DataFrame, root: str, key: str, parts: int = PARTS) -> None:
    """Replace all that ``works`` (key) have in the stored tables by ``fresh`` (OTH20, SET6); a work without fresh rows has none afterwards.

    The parts are read by their partition column alone, so files of other parts
    are neither read nor written.  Parts that are left without a row are removed.
    """
    spark = works.sparkSession
    named = works.select(key).distinct()
    touched = sorted(r[0] for r in named.select(part_of(key, parts)).distinct().collect())  # at most ``parts``
    for name, rows in fresh.items():
        old = stored(spark, root, name)
        rest = old.where(F.col(PART).isin(touched)).join(named, key, "left_anti").drop(PART)
        now = rest.unionByName(rows.join(named, key, "left_semi").select(*rest.columns)).withColumn(PART, part_of(key, parts))
        now.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{root}/{name}")
        _drop_stale(spark, f"{root}/{name}", rows.join(named, key, "left_semi"), named, touched, key, parts)


def _drop_stale(spark: SparkSession, folder: str, rows: DataFrame, named: DataFrame, touched: list[int], key: str, parts: int) -> None:
    """Remove parts that were not written because they have no row now: they still hold rows of a work that has none any more."""
    written = {r[0] for r in rows.select(part_of(key, parts)).distinct().collect()}  # at most ``parts``
    doubtful = [p for p in touched if p not in written]
    if not doubtful:
        return
    left = spark.read.parquet(folder).where(F.col(PART).isin(doubtful)).join(named, key, "left_semi").select(PART).distinct()
    for (part,) in left.collect():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{PART}={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def derived(books: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """What is made anew when a work is imported: its chapters (lines with words), paragraphs and chunks."""
    lines = segment.lines(books, [key], text).withColumn("words", F.size(segment.tx.fields("line"))).where("words > 0")
    return {
        "chapters": lines.select(key, F.col("line_idx").alias("chapter_idx"), "words"),
        "paragraphs": segment.paragraphs(books, [key], text).drop("text"),
        "chunks": segment.chunks(books, [key], text).drop("content"),
    }
