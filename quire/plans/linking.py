"""Queries over chapter links, narrations and checks of derived data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import alignment as al
from quire.operators import linking, paths
from quire.plans import synchrony
from quire.plans.base import query, table
from quire.plans.entities import _NORM
from quire.plans.synchrony import _BAKED, _CHAPTERS
from quire.plans.timelines import _PLACED
from quire.plans.timelines import files as placed_files

#: Parts of a brand as chapters: even ones heard, odd ones written; every seventh has a number.
_TITLE = "CASE WHEN p_partkey % 7 = 0 THEN 'Chapter ' || (p_size % 20 + 1) WHEN p_partkey % 7 = 1 THEN 'Part ' || ['I','IV','IX','XII','XX'][1 + p_size % 5] ELSE p_name || ' ' || p_type END"
_CH = f"(SELECT p_brand AS work, p_partkey AS id, {_TITLE} AS title, CASE WHEN p_partkey % 7 = 0 THEN p_size % 20 + 1 WHEN p_partkey % 7 = 1 THEN [1, 4, 9, 12, 20][1 + p_size % 5] END AS number FROM part)"
_A, _T = f"(SELECT *, {_NORM.format(c='title')} AS norm FROM {_CH} WHERE id % 2 = 0)", f"(SELECT *, {_NORM.format(c='title')} AS norm FROM {_CH} WHERE id % 2 = 1)"
_CASCADE = f"""(SELECT a.work, a.id AS audio_index, coalesce(n.id, t.id, w.id) AS text_index, CASE WHEN n.id IS NOT NULL THEN 0.9 WHEN t.id IS NOT NULL THEN 0.8 ELSE least(0.7, w.n * 0.2) END::DOUBLE AS confidence FROM {_A} a
LEFT JOIN (SELECT work, number, max(id) AS id FROM {_T} WHERE number > 0 GROUP BY 1, 2) n USING (work, number) LEFT JOIN (SELECT work, norm, max(id) AS id FROM {_T} GROUP BY 1, 2) t ON t.work = a.work AND t.norm = a.norm
LEFT JOIN (SELECT work, aid, arg_max(id, (n, -id)) AS id, max(n) AS n FROM (SELECT x.work, x.id AS aid, y.id, count(*) AS n FROM (SELECT work, id, unnest(string_split(norm, ' ')) AS w FROM {_A}) x JOIN (SELECT DISTINCT work, id, unnest(string_split(norm, ' ')) AS w FROM {_T}) y USING (work, w) WHERE length(w) > 2 GROUP BY 1, 2, 3) WHERE n >= 2 GROUP BY 1, 2) w ON w.work = a.work AND w.aid = a.id
WHERE coalesce(n.id, t.id, w.id) IS NOT NULL)"""


def chapters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    roman = F.get(F.array(*[F.lit(x) for x in ("I", "IV", "IX", "XII", "XX")]), F.col("p_size") % 5)
    title = F.when(k == 0, F.concat(F.lit("Chapter "), (F.col("p_size") % 20 + 1).cast("string"))).when(k == 1, F.concat(F.lit("Part "), roman)).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    c = p.select(F.col("p_brand").alias("work"), F.col("p_partkey").alias("id"), title.alias("title"))
    return c.where("id % 2 = 0").withColumnRenamed("id", "audio_index"), c.where("id % 2 = 1").withColumnRenamed("id", "text_index")


@query(f"SELECT work, audio_index, text_index, round(confidence, 6) AS confidence FROM {_CASCADE} WHERE work NOT IN (SELECT work FROM {_CASCADE} GROUP BY 1 HAVING count(*) >= 2 AND min(text_index) = max(text_index))")
def chapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI18, SEG14, SCA16: audio chapters linked to text chapters by number, title or shared words."""
    links = linking.spread_links(linking.title_links(*chapters(spark, sf_dir), "work"), "work")
    return links.withColumn("confidence", F.round("confidence", 6))


_HEARD = f"(SELECT work, chapter, min(start_sec) AS sec FROM {_BAKED} JOIN {_CHAPTERS} USING (work) WHERE kind = 'aligned' AND start_sec > 0 AND es >= start AND es < start + len GROUP BY 1, 2)"
_STARTS = "(SELECT l_orderkey AS work, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS n, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem)"


@query(f"""SELECT f.work, f.n, coalesce(c.chapter, z.first) AS text_index, 0.85::DOUBLE AS confidence FROM (SELECT work, n, 12.0::DOUBLE * (n - 1) AS t FROM {_STARTS} WHERE k > 1) f ASOF LEFT JOIN {_HEARD} c ON c.work = f.work AND f.t >= c.sec
JOIN (SELECT work, arg_min(chapter, sec) AS first FROM {_HEARD} GROUP BY 1) z ON z.work = f.work""")
def links_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG14, JOI14: the chapter that plays when each file starts."""
    s = synchrony.segments(spark, sf_dir)
    files = placed_files(spark, sf_dir).select("work", "n", ((F.col("n") - 1) * 12.0).alias("start_sec"))
    return linking.timed_links(files, al.baked(s, synchrony.spoken(s), ["work"]), synchrony.chapter_spans(s), "work")


@query(f"""WITH RECURSIVE f AS (SELECT work, n AS id, start_sec, duration FROM {_PLACED}), x AS (SELECT a.work, a.id AS prev, min(b.id) AS next FROM f a JOIN f b ON a.work = b.work AND b.start_sec > a.start_sec AND abs(b.start_sec - (a.start_sec + a.duration)) <= 2 GROUP BY 1, 2),
up AS (SELECT work, next AS id, min(prev) AS up FROM x GROUP BY 1, 2), r(work, id, head) AS (SELECT work, id, id FROM f WHERE (work, id) NOT IN (SELECT work, id FROM up) UNION ALL SELECT u.work, u.id, r.head FROM r JOIN up u ON u.work = r.work AND u.up = r.id)
SELECT work, head, count(*) AS files, round(max(start_sec + duration), 3) AS end_sec FROM r JOIN f USING (work, id) GROUP BY 1, 2""")
def narration_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: files that continue one another, as narrations with their end."""
    f = placed_files(spark, sf_dir).withColumnRenamed("n", "id")
    return linking.narrations(f, "work").groupBy("work", "head").agg(F.count("*").alias("files"), F.round(F.max(F.col("start_sec") + F.col("duration")), 3).alias("end_sec"))


_LINKS = "(SELECT l_orderkey AS work, l_suppkey AS audio_book, l_partkey % 50 AS text_book, l_linenumber AS text_index FROM lineitem)"
_BOOKS = "(SELECT work, book, max(chapters) AS chapters FROM (SELECT l_orderkey AS work, l_suppkey AS book, 5 AS chapters FROM lineitem WHERE l_suppkey % 9 <> 0 UNION ALL SELECT l_orderkey, l_partkey % 50, 4 FROM lineitem WHERE l_partkey % 11 <> 0) GROUP BY 1, 2)"


@query(f"""WITH k AS {_LINKS}, b AS {_BOOKS}, w AS (SELECT o_orderkey AS work FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT l_orderkey AS work, l_suppkey AS book, max(l_quantity) AS reach, max(l_quantity * (1 + l_discount * 2)) AS end_sec FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT work, 'links_collapsed' AS kind, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2 AND min(text_index) = max(text_index) UNION ALL
SELECT work, 'link_dangling', count(*) FROM (SELECT work FROM k WHERE text_book <> 0 AND (work, text_book) NOT IN (SELECT work, book FROM b) UNION ALL SELECT work FROM k WHERE audio_book <> 0 AND (work, audio_book) NOT IN (SELECT work, book FROM b)) GROUP BY 1 UNION ALL
SELECT k.work, 'link_out_of_range', count(*) FROM k JOIN b ON b.work = k.work AND b.book = k.text_book WHERE chapters > 0 AND text_index >= chapters GROUP BY 1 UNION ALL
SELECT work, 'display_dangling', count(*) FROM (SELECT o_orderkey AS work, o_custkey % 3 AS book FROM orders) WHERE book <> 0 AND (work, book) NOT IN (SELECT work, book FROM b) GROUP BY 1 UNION ALL
SELECT work, 'sync_missing', 1 FROM w WHERE work NOT IN (SELECT work FROM s) UNION ALL SELECT work, 'sync_partial', count(*) FROM s WHERE work IN (SELECT work FROM w) AND end_sec > 0 AND reach < 0.9 * end_sec GROUP BY 1""")
def derivation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ3: links, shown books and word times of each work that do not hold."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    w = F.col("l_orderkey").alias("work")
    links = li.select(w, F.col("l_suppkey").alias("audio_book"), (F.col("l_partkey") % 50).alias("text_book"), F.col("l_linenumber").alias("text_index"))
    books = li.where("l_suppkey % 9 <> 0").select(w, F.col("l_suppkey").alias("book"), F.lit(5).alias("chapters")).unionByName(li.where("l_partkey % 11 <> 0").select(w, (F.col("l_partkey") % 50).alias("book"), F.lit(4).alias("chapters")))
    books = books.groupBy("work", "book").agg(F.max("chapters").alias("chapters"))
    shown = o.select(F.col("o_orderkey").alias("work"), (F.col("o_custkey") % 3).alias("book"))
    aligned = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("work"))
    s = li.where("l_returnflag <> 'A'").groupBy(w, F.col("l_suppkey").alias("book")).agg(F.max("l_quantity").alias("reach"), F.max(F.col("l_quantity") * (1 + F.col("l_discount") * 2)).alias("end_sec"))
    return linking.derivation_issues(links, books, shown, aligned, s.select("work", "book", "reach"), s.select("work", "book", "end_sec"), "work")


@query("""WITH f AS (SELECT l_orderkey AS work, l_partkey AS book, CASE WHEN l_tax > 0.04 THEN '' ELSE 'file ' || l_partkey END AS title, 'f' || l_partkey || '.mp3' AS filename FROM (SELECT l_orderkey, l_partkey, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)), one AS (SELECT work, min(book) AS book FROM f GROUP BY 1 HAVING count(*) = 1),
d AS (SELECT p_partkey AS book, unnest(range(0, p_size % 3)) AS idx FROM part) SELECT work, book, CAST(idx AS INT) AS audio_index, 'Chapter ' || (idx + 1) AS title FROM one JOIN d USING (book) UNION ALL
SELECT work, book, CAST(row_number() OVER (PARTITION BY work ORDER BY book) - 1 AS INT), coalesce(nullif(title, ''), filename) FROM f WHERE work NOT IN (SELECT work FROM one JOIN d USING (book))""")
def audio_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH18: detected chapters of single files, else the files themselves."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("book")).agg(F.max("l_tax").alias("tax"))
    n = F.col("book").cast("string")
    f = f.select("work", "book", F.when(F.col("tax") > 0.04, "").otherwise(F.concat(F.lit("file "), n)).alias("title"), F.concat(F.lit("f"), n, F.lit(".mp3")).alias("filename"))
    d = table(spark, sf_dir, "part").where("p_size % 3 > 0").select(F.col("p_partkey").alias("book"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 3 - 1)).alias("idx"))
    return linking.flattened(f, d.withColumn("title", F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string"))), "work")


#: Lines of an order as alignments between the books of a work, of two units.
_LINKS = "(SELECT l_orderkey AS work, CASE l_returnflag WHEN 'N' THEN 'word' ELSE 'paragraph' END AS unit, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS id, CAST(l_partkey % 6 AS INT) AS from_book, CAST(l_suppkey % 6 AS INT) AS to_book FROM lineitem)"
_EITHER = f"(SELECT work, unit, id, from_book AS src, to_book AS dst, false AS reversed FROM {_LINKS} WHERE from_book <> to_book UNION ALL SELECT work, unit, id, to_book, from_book, true FROM {_LINKS} WHERE from_book <> to_book)"


def book_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    unit = F.when(F.col("l_returnflag") == "N", "word").otherwise("paragraph")
    return li.select(F.col("l_orderkey").alias("work"), unit.alias("unit"), place.alias("id"), (F.col("l_partkey") % 6).cast("int").alias("from_book"), (F.col("l_suppkey") % 6).cast("int").alias("to_book"))


@query(f"""WITH RECURSIVE s AS {_EITHER}, w(work, unit, a, b, hops, ids, reversed, books) AS (SELECT work, unit, src, dst, 1, [id], [reversed], [src, dst] FROM s UNION ALL SELECT w.work, w.unit, w.a, s.dst, w.hops + 1, list_append(w.ids, s.id), list_append(w.reversed, s.reversed), list_append(w.books, s.dst) FROM w JOIN s ON s.work = w.work AND s.unit = w.unit AND s.src = w.b WHERE w.hops < 6 AND NOT list_contains(w.books, s.dst))
SELECT work, unit, a, b, hops, array_to_string(ids, ',') AS ids, array_to_string(list_transform(reversed, lambda x: CASE WHEN x THEN 'back' ELSE 'on' END), ',') AS turns FROM w QUALIFY row_number() OVER (PARTITION BY work, unit, a, b ORDER BY hops, w.ids, reversed) = 1""")
def alignment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN13: the shortest way between any two books of a work over alignments of one unit, with the way itself."""
    found = paths.alignment_paths(book_links(spark, sf_dir))
    turns = F.array_join(F.transform("reversed", lambda x: F.when(x, "back").otherwise("on")), ",")
    return found.select("work", "unit", "a", "b", "hops", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), turns.alias("turns"))


@query(f"SELECT work, unit, a, b, min(id) AS id, arg_min(reversed, (id, reversed)) AS reversed FROM (SELECT l.work, l.unit, l.a, l.b, s.id, s.reversed FROM (SELECT DISTINCT work, unit, 0 AS a, CAST(k AS INT) AS b FROM {_LINKS}, unnest(range(1, 6)) x(k)) l JOIN {_EITHER} s ON s.work = l.work AND s.unit = l.unit AND s.src = l.a AND s.dst = l.b) GROUP BY ALL")
def alignment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH12: the alignment between the first book of a work and each other, in whichever direction it is kept."""
    links = book_links(spark, sf_dir)
    asked = links.select("work", "unit").distinct().select("work", "unit", F.lit(0).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("b"))
    return paths.direct(links, asked)
