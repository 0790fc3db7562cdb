"""Queries over changes that go through all tables of a library.

Customers are works and orders are books; what hangs on them is made of orders,
their lines and events by the statements below, which both engines read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import changes as ch
from quire.plans.base import query, shared_folder, table

BASE = ("customer", "orders", "lineitem", "events")
LIBRARY = {
    "works": "SELECT c_custkey AS id, c_name AS title, 'old' AS content_version, b.last AS display_text_book_id FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM {orders} GROUP BY o_custkey) b ON o_custkey = c_custkey",
    "books": "SELECT o_orderkey AS id, o_custkey AS work_id FROM {orders}",
    "chapters": "SELECT l_orderkey AS book_id, l_linenumber AS chapter_idx, count(*) AS words FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "alignments": "SELECT o_custkey AS work_id, o_orderkey AS from_book_id, other AS to_book_id FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM {orders}) WHERE other IS NOT NULL",
    "chapter_links": "SELECT o_custkey AS work_id, o_orderkey AS audio_book_id, other AS text_book_id FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM {orders}) WHERE other IS NOT NULL",
    "sync_data": "SELECT o_custkey AS work_id, l_orderkey AS audio_book_id, l_linenumber AS chapter_idx, count(*) AS words FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' GROUP BY o_custkey, l_orderkey, l_linenumber",
    "bookmarks": "SELECT o_custkey AS work_id, o_orderkey AS book_id FROM {orders} WHERE o_orderstatus = 'F'",
    "playback_positions": "SELECT o_custkey AS work_id, o_orderkey % 3 AS user_id, max(o_orderkey) AS word FROM {orders} GROUP BY o_custkey, o_orderkey % 3",
    "playback_events": "SELECT user_id AS work_id, event_id FROM {events}",
    "characters": "SELECT l_orderkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS id, o_custkey AS work_id, l_orderkey AS book_id, l_returnflag AS name FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_returnflag, o_custkey",
    "character_mentions": "SELECT l_orderkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS character_id, l_linenumber AS chapter_idx, count(*) AS times FROM {lineitem} GROUP BY l_orderkey, l_returnflag, l_linenumber",
}
#: What is summed of each table, and by which work.
MARKS = {
    "works": ("id", "id + length(content_version) * 3 + coalesce(display_text_book_id, 0) * 5"), "books": ("work_id", "id"), "chapters": ("-1", "book_id * 31 + chapter_idx * words"), "alignments": ("work_id", "from_book_id * 31 + to_book_id"),
    "chapter_links": ("work_id", "audio_book_id * 31 + text_book_id"), "sync_data": ("work_id", "audio_book_id * 31 + chapter_idx * words"), "bookmarks": ("work_id", "book_id"), "playback_positions": ("work_id", "user_id * 31 + word"),
    "playback_events": ("work_id", "event_id"), "characters": ("work_id", "id"), "character_mentions": ("-1", "character_id * 31 + chapter_idx * times"),
}
_BASE = ", ".join(f"{n} AS ({s.format(**{b: b for b in BASE})})" for n, s in LIBRARY.items())


def _digests(of: dict[str, str]) -> str:
    """SQL of the digest of every table, each under the name that stands for its changed form."""
    return " UNION ALL ".join(f"SELECT '{n}' AS tbl, CAST({w} AS BIGINT) AS work, count(*) AS n, CAST(sum({m}) AS BIGINT) AS mark FROM {of.get(n, n)} GROUP BY 2" for n, (w, m) in MARKS.items())


def library(spark: SparkSession, sf_dir: str) -> ch.Tables:
    base = {n: table(spark, sf_dir, n) for n in BASE}
    return {name: spark.sql(s, **base) for name, s in LIBRARY.items()}


def digests(tables: ch.Tables) -> DataFrame:
    out = None
    for name, (work, mark) in MARKS.items():
        one = tables[name].groupBy(F.expr(work).cast("long").alias("work")).agg(F.count("*").alias("n"), F.sum(F.expr(mark).cast("long")).alias("mark")).select(F.lit(name).alias("tbl"), "work", "n", "mark")
        out = one if out is None else out.unionByName(one)
    return out


def published(tables: ch.Tables) -> DataFrame:
    """Digests of the tables as they are read after they were published."""
    spark = next(iter(tables.values())).sparkSession
    root = f"{shared_folder(spark)}/library-{uuid.uuid4().hex[:12]}"
    ch.publish(tables, root)
    return digests(ch.opened(spark, root))


_TO = "CASE WHEN work_id % 10 = 3 THEN work_id - 1 ELSE work_id END"
_MERGED = ", ".join(f"m_{n} AS (SELECT * EXCLUDE (work_id), {_TO} AS work_id FROM {n})" for n in ("books", "alignments", "chapter_links", "bookmarks", "playback_events", "sync_data", "characters"))


@query(f"""WITH {_BASE}, {_MERGED}, m_playback_positions AS (SELECT {_TO} AS work_id, user_id, word FROM playback_positions QUALIFY row_number() OVER (PARTITION BY {_TO}, user_id ORDER BY work_id % 10 = 3, word) = 1),
m_works AS (SELECT id, title, CASE WHEN id % 10 = 2 AND id + 1 IN (SELECT id FROM works) THEN 'merged' ELSE content_version END AS content_version, display_text_book_id FROM works WHERE id % 10 <> 3)
{_digests({n: f"m_{n}" for n in ("works", "books", "alignments", "chapter_links", "bookmarks", "playback_events", "sync_data", "characters", "playback_positions")})}""")
def merged_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3: every work whose number ends in 3 merged into the one before, over all tables, published and read again."""
    tables = library(spark, sf_dir)
    moves = tables["works"].where("id % 10 = 3").select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    return published(ch.merged(tables, moves, "merged"))


_GOES = "({0} % 7 = 2)"


def _split_sql() -> str:
    new = "1000000000 + work_id"
    one = {n: f"m_{n} AS (SELECT * EXCLUDE (work_id), CASE WHEN {_GOES.format(c)} THEN {new} ELSE work_id END AS work_id FROM {n})" for n, c in (("books", "id"), ("bookmarks", "book_id"), ("sync_data", "audio_book_id"), ("characters", "book_id"))}
    two = {n: f"m_{n} AS (SELECT * EXCLUDE (work_id), CASE WHEN {_GOES.format(a)} THEN {new} ELSE work_id END AS work_id FROM {n} WHERE {_GOES.format(a)} = {_GOES.format(b)})" for n, a, b in (("alignments", "from_book_id", "to_book_id"), ("chapter_links", "audio_book_id", "text_book_id"))}
    parted = f"(SELECT DISTINCT work_id FROM books WHERE {_GOES.format('id')})"
    works = f"m_works AS (SELECT id, CASE WHEN id IN {parted} THEN 'split' ELSE content_version END AS content_version, CASE WHEN {_GOES.format('display_text_book_id')} THEN NULL ELSE display_text_book_id END AS display_text_book_id FROM works UNION ALL SELECT {new}, 'split', NULL FROM {parted})"
    return f"WITH {_BASE}, {', '.join([*one.values(), *two.values()])}, {works} {_digests({n: f'm_{n}' for n in [*one, *two, 'works']})}"


@query(_split_sql())
def split_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: books whose number leaves 2 by 7 parted from their works, edges across gone, published and read again."""
    tables = library(spark, sf_dir)
    leaving = tables["books"].where("id % 7 = 2")
    moves = leaving.select(F.col("id").alias("book"), (F.col("work_id") + 1_000_000_000).alias("new_work"))
    titles = moves.select(F.col("new_work").alias("id")).distinct().withColumn("title", F.concat(F.lit("Part of "), (F.col("id") - 1_000_000_000).cast("string")))
    return published(ch.split(tables, moves, titles, "split"))


_KEPT = "SELECT id FROM d_books"


def _deleted_sql(books: str, works: str) -> str:
    """Tables without rows that name a book or work that is not in these two."""
    held = lambda *c: " AND ".join(f"{x} IN ({_KEPT})" for x in c)
    own = "work_id IN (SELECT id FROM d_works)"
    rest = {"chapters": held("book_id"), "alignments": f"{own} AND {held('from_book_id', 'to_book_id')}", "chapter_links": f"{own} AND {held('audio_book_id', 'text_book_id')}", "sync_data": f"{own} AND {held('audio_book_id')}", "bookmarks": f"{own} AND {held('book_id')}", "playback_positions": own, "playback_events": own, "characters": f"{own} AND {held('book_id')}"}
    made = ", ".join(f"d_{n} AS (SELECT * FROM {n} WHERE {c})" for n, c in rest.items())
    return f"WITH {_BASE}, d_works AS ({works}), d_books AS ({books}), {made}, d_character_mentions AS (SELECT * FROM character_mentions WHERE character_id IN (SELECT id FROM d_characters)) {_digests({n: f'd_{n}' for n in MARKS})}"


@query(_deleted_sql("SELECT * FROM books WHERE id % 13 <> 1 AND work_id % 11 <> 5", "SELECT * FROM works WHERE id % 11 <> 5").replace("work_id IN (SELECT id FROM d_works)", "work_id % 11 <> 5"))
def deleted_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH7: books and whole works deleted with all that hangs on them, published and read again."""
    tables = library(spark, sf_dir)
    less = ch.without_books(tables, tables["books"].where("id % 13 = 1").select("id"))
    return published(ch.without_works(less, tables["works"].where("id % 11 = 5").select("id")))


@query(_deleted_sql("SELECT * FROM books WHERE id % 13 <> 1", "SELECT * FROM works WHERE id % 11 <> 5"))
def swept_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI3: works and books went without what hangs on them; every table swept of rows that name them."""
    tables = library(spark, sf_dir)
    broken = tables | {"books": tables["books"].where("id % 13 <> 1"), "works": tables["works"].where("id % 11 <> 5")}
    return published(ch.swept(broken))
