"""Changes that go through all tables of a library, seen whole or not at all.

A library is a set of tables by name.  ``DEPENDENTS`` tells which columns of a
table name works, books or rows of another table; merging, splitting, deleting
and sweeping are driven by it.  ``publish`` writes every table under one new
folder and gives it its final name last; readers take the newest folder with a
final name, so a run that breaks off leaves what was there.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relational as rel

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Dependent:
    """What a table hangs on: the work, books (two of them are an edge between books), or rows of another table by ``child``.

    ``unique`` columns hold once a work; where two works become one, the row that was there stays.
    """

    work: str | None = None
    books: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    parent: str | None = None
    child: str | None = None


#: Tables that hang on works and books, parents before children.
DEPENDENTS = {
    "books": Dependent(work="work_id"),
    "chapters": Dependent(books=("book_id",)),
    "chunks": Dependent(books=("book_id",)),
    "paragraphs": Dependent(books=("book_id",)),
    "summaries": Dependent(books=("book_id",)),
    "alignments": Dependent(work="work_id", books=("from_book_id", "to_book_id")),
    "chapter_links": Dependent(work="work_id", books=("audio_book_id", "text_book_id")),
    "sync_data": Dependent(work="work_id", books=("audio_book_id",), unique=("audio_book_id", "chapter_idx")),
    "bookmarks": Dependent(work="work_id", books=("book_id",)),
    "playback_positions": Dependent(work="work_id", unique=("user_id",)),
    "playback_events": Dependent(work="work_id"),
    "qa_sessions": Dependent(work="work_id"),
    "jobs": Dependent(work="work_id"),
    "characters": Dependent(work="work_id", books=("book_id",), unique=("book_id", "name")),
    "character_mentions": Dependent(parent="characters", child="character_id"),
}
#: Columns of works that point at a book to show.
SHOWN = ("display_text_book_id", "display_audio_book_id")


def _of(tables: Tables) -> list[tuple[str, DataFrame, Dependent]]:
    return [(name, tables[name], d) for name, d in DEPENDENTS.items() if name in tables]


def _mapped(df: DataFrame, column: str, moves: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with ``column`` moved from ``source`` to ``target``, and ``__moved``."""
    m = moves.select(F.col(source).alias(column), F.col(target).alias("__to"))
    j = df.join(m, column, "left")
    return j.withColumn("__moved", F.col("__to").isNotNull()).withColumn(column, F.coalesce("__to", column)).drop("__to")


def _settled(df: DataFrame, d: Dependent, columns: list[str]) -> DataFrame:
    """Rows without those that moved to where another of the same unique columns stood; among moved ones the first in all columns stays."""
    if d.unique:
        rest = [F.col(c) for c in columns if c != d.work and c not in d.unique]
        df = rel.first_by(df, [d.work, *d.unique], F.col("__moved").asc(), *rest)
    return df.select(*columns)


def merged(tables: Tables, moves: DataFrame, version: str) -> Tables:
    """All that belongs to works ``source`` under their works ``target`` (SET3); ``moves``: source, target.

    The sources go from ``works``, the targets get ``version``.  A target may not itself be a source, nor a source have two targets.
    """
    clash = moves.join(moves.select(F.col("source").alias("target")), "target", "left_semi").select("target")
    twice = moves.groupBy("source").count().where("count > 1").select(F.col("source").alias("target"))
    if bad := clash.unionByName(twice).limit(1).collect():
        raise ValueError(f"work {bad[0][0]} is to be merged and to be a target, or has two targets")
    out = dict(tables)
    for name, df, d in _of(tables):
        if d.work:
            out[name] = _settled(_mapped(df, d.work, moves, "source", "target"), d, df.columns)
    works = tables["works"].join(moves.select(F.col("source").alias("id")), "id", "left_anti")
    out["works"] = _stamped(works, moves.select(F.col("target").alias("id")), version)
    return out


def _stamped(works: DataFrame, changed: DataFrame, version: str) -> DataFrame:
    """``works`` with the content version of those that changed (OTH8)."""
    now = changed.distinct().withColumn("__changed", F.lit(True))
    return works.join(now, "id", "left").withColumn("content_version", F.when(F.col("__changed"), F.lit(version)).otherwise(F.col("content_version"))).select(*works.columns)


def split(tables: Tables, moves: DataFrame, titles: DataFrame, version: str) -> Tables:
    """Books moved to new works (SET4); ``moves``: book, new_work; ``titles``: id, title of the new works.

    What hangs on one book goes with it.  An edge between a book that moves and
    one that stays, or between two that part, is gone.  A shown book that left is no longer shown.
    """
    out = dict(tables)
    to = moves.select(F.col("book").alias("id"), "new_work")
    out["books"] = tables["books"].join(to, "id", "left").withColumn("work_id", F.coalesce("new_work", "work_id")).select(*tables["books"].columns)
    for name, df, d in _of(tables):
        if not d.work or not d.books:
            continue
        j = df
        for i, c in enumerate(d.books):
            j = j.join(moves.select(F.col("book").alias(c), F.col("new_work").alias(f"__to{i}")), c, "left")
        to = [F.col(f"__to{i}") for i in range(len(d.books))]
        for other in to[1:]:
            j = j.where(to[0].eqNullSafe(other))
        out[name] = j.withColumn(d.work, F.coalesce(to[0], F.col(d.work))).select(*df.columns)
    works, old = tables["works"], tables["books"].join(moves.select(F.col("book").alias("id")), "id", "left_semi").select(F.col("work_id").alias("id"))
    for c in SHOWN:
        if c in works.columns:
            gone = moves.select(F.col("book").alias(c), F.lit(True).alias("__gone"))
            works = works.join(gone, c, "left").withColumn(c, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(c))).select(*tables["works"].columns)
    works = works.unionByName(titles, allowMissingColumns=True)
    out["works"] = _stamped(works, old.unionByName(moves.select(F.col("new_work").alias("id"))), version)
    return out


def without_books(tables: Tables, gone: DataFrame) -> Tables:
    """The library without the books ``id`` of ``gone`` and all that names them (OTH7)."""
    out = dict(tables)
    out["books"] = tables["books"].join(gone.select("id"), "id", "left_anti")
    for name, df, d in _of(tables):
        out[name] = reduce(lambda x, c: x.join(gone.select(F.col("id").alias(c)), c, "left_anti"), d.books, out[name]).select(*df.columns)
    return _followed(out)


def without_works(tables: Tables, gone: DataFrame) -> Tables:
    """The library without the works ``id`` of ``gone``, their books and all that hangs on either (OTH7)."""
    books = tables["books"].join(gone.select(F.col("id").alias("work_id")), "work_id", "left_semi").select("id")
    out = without_books(tables, books)
    for name, df, d in _of(out):
        if d.work:
            out[name] = df.join(gone.select(F.col("id").alias(d.work)), d.work, "left_anti").select(*df.columns)
    out["works"] = tables["works"].join(gone.select("id"), "id", "left_anti")
    return _followed(out)


def _followed(tables: Tables) -> Tables:
    """Without rows whose parent row of another table is gone."""
    out = dict(tables)
    for name, df, d in _of(tables):
        if d.parent and d.parent in out:
            out[name] = df.join(out[d.parent].select(F.col("id").alias(d.child)), d.child, "left_semi").select(*df.columns)
    return out


def swept(tables: Tables) -> Tables:
    """The library without rows whose work, book or parent row is not there (JOI3); a null counts as not there, but for works of books."""
    out = dict(tables)
    for name, df, d in _of(tables):
        if name == "books":
            continue
        if d.work:
            df = df.join(tables["works"].select(F.col("id").alias(d.work)), d.work, "left_semi")
        for c in d.books:
            df = df.join(tables["books"].select(F.col("id").alias(c)), c, "left_semi")
        out[name] = df.select(*tables[name].columns)
    return _followed(out)


def publish(tables: Tables, root: str) -> str:
    """Write all tables under a new folder of ``root`` and return it.

    The folder has a name of its own while it is written and is renamed last, to
    the number after the newest.  If another run has taken the number meanwhile, or
    a table fails, the new folder is removed and the error raised.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, at = _file_system(spark, root)
    building = f"{root.rstrip('/')}/.building-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{building}/{name}")
        final = f"{root.rstrip('/')}/v{(_numbers(fs, at) or [0])[-1] + 1:08d}"
        if fs.exists(_path(spark, final)) or not fs.rename(_path(spark, building), _path(spark, final)):
            raise FileExistsError(f"{final} was published by another run")
        return final
    except BaseException:
        fs.delete(_path(spark, building), True)
        raise


def newest(spark: SparkSession, root: str) -> str | None:
    """The folder that was published last, None where there is none."""
    fs, at = _file_system(spark, root)
    found = _numbers(fs, at)
    return f"{root.rstrip('/')}/v{found[-1]:08d}" if found else None


def opened(spark: SparkSession, root: str) -> Tables:
    """The tables that were published last."""
    folder = newest(spark, root)
    if folder is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    fs, at = _file_system(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in sorted(names)}


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(fs, at) -> list[int]:
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x[1:]) for x in names if re.fullmatch(r"v\d{8,}", x))
