"""Titles, authors, duplicates, editions and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import entity
from quire.operators import relational as rel
from quire.plans.base import query, table

_KEY = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), '[(\\[{{].*$', ''), '\\b(unabridged|audiobook|ebook|hd|remastered)\\b', ' ', 'g')), '^(the|an|a) ', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_P = "(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || ' (Unabridged)' WHEN p_partkey % 3 = 1 THEN p_name || ' [Retail]' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS author, p_brand, p_type, p_size FROM part)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works, with titles in several renderings and some authors blank."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("The "), "p_name", F.lit(" (Unabridged)"))).when(k == 1, F.concat("p_name", F.lit(" [Retail]"))).otherwise(F.col("p_name"))
    return p.withColumn("title", title).withColumn("author", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")))


@query(f"SELECT p_partkey, {_KEY.format(c='title')} AS title_key, {_NORM.format(c='title')} AS title_norm FROM {_P}")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA5, SCA6: comparable titles."""
    return works(spark, sf_dir).select("p_partkey", tx.title_key("title").alias("title_key"), tx.normalize_title("title").alias("title_norm"))


@query(f"SELECT {_KEY.format(c='title')} AS title_key, count(*) AS n, min(p_partkey) AS first_id FROM {_P} GROUP BY 1 HAVING count(*) > 1")
def title_key_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11 by title alone."""
    return works(spark, sf_dir).groupBy(tx.title_key("title").alias("title_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query(f"""WITH k AS (SELECT p_partkey AS id, {_KEY.format(c='title')} AS title_key, lower(regexp_replace(author, '^.* ', '')) AS author_key FROM {_P}),
o AS (SELECT title_key, count(DISTINCT author_key) AS authors, min(author_key) AS sole FROM k WHERE author_key <> '' GROUP BY 1)
SELECT title_key, CASE WHEN author_key = '' AND authors = 1 THEN sole ELSE author_key END AS author_key, count(*) AS n, min(id) AS first_id FROM k LEFT JOIN o USING (title_key) GROUP BY 1, 2 HAVING count(*) >= 2""")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: duplicates by title and author; a blank author joins only where one author is known."""
    c = entity.duplicate_clusters(works(spark, sf_dir), "p_partkey", "title", "author")
    return c.select("title_key", "author_key", "n", F.get("ids", 0).alias("first_id"))


@query("SELECT p_name, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: titles that occur again, with their identifiers."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


_FULL = "p_name || ' ' || p_type || ' ' || substr(p_brand, 7)"


@query(f"""WITH t AS (SELECT {_FULL} AS title, min(p_partkey) AS id FROM part GROUP BY 1), w AS (SELECT DISTINCT id, unnest(string_split({_NORM.format(c='title')}, ' ')) AS w FROM t)
SELECT a.id AS a, b.id AS b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.id < b.id WHERE length(a.w) > 3 GROUP BY 1, 2 HAVING count(*) >= 3""")
def suspect_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI7, SCA10: titles that share three words."""
    full = F.concat_ws(" ", "p_name", "p_type", F.substring("p_brand", 7, 9))
    t = table(spark, sf_dir, "part").groupBy(full.alias("title")).agg(F.min("p_partkey").alias("id"))
    return entity.shared_word_pairs(t, "id", "title", least=3)


@query("SELECT p_partkey, p_size AS series_index, lower(regexp_replace(title, '^(?i)(the|an|a) ', '')) AS filing FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name ELSE p_name END AS title FROM part) ORDER BY p_brand, p_size, filing, p_partkey LIMIT 100")
def filing_title_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1: the first hundred works in filing order."""
    t = table(spark, sf_dir, "part").withColumn("title", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name")))
    return t.withColumn("filing", tx.filing_title("title")).orderBy("p_brand", "p_size", "filing", "p_partkey").limit(100).select("p_partkey", F.col("p_size").alias("series_index"), "filing")


@query("""SELECT edition_key, count(*) AS files, round(sum(p_retailprice), 4) AS duration, min(p_partkey) AS default_id FROM (SELECT *, coalesce(nullif(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END, ''), nullif(CASE WHEN p_partkey % 5 = 1 THEN p_type ELSE '' END, ''), nullif(CASE WHEN p_partkey % 5 = 2 THEN p_name ELSE '' END, ''), nullif(CASE WHEN p_partkey % 5 = 3 THEN 'upload' ELSE '' END, ''), CAST(p_partkey AS VARCHAR)) AS edition_key FROM part) GROUP BY 1""")
def edition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: files by edition."""
    k = F.col("p_partkey") % 5
    only = lambda i, c: F.when(k == i, c).otherwise("")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), only(0, F.col("p_brand")).alias("edition"), only(1, F.col("p_type")).alias("album"), only(2, F.col("p_name")).alias("folder"), only(3, F.lit("upload")).alias("origin"), "p_retailprice")
    return entity.edition_key(p).groupBy("edition_key").agg(F.count("*").alias("files"), F.round(F.sum("p_retailprice"), 4).alias("duration"), F.min("id").alias("default_id"))


#: Authority of a text by origin.
AUTHORITY = (("publisher_epub", 100), ("publisher_mobi", 95), ("publisher_pdf", 90), ("author_recording", 100), ("narrator_recording", 80), ("librivox", 60), ("user_upload", 50), ("unknown", 50), ("tts_kokoro", 30), ("whisper_transcript", 20), ("tts_preprocessed", 10))
_AUTH = "CASE origin " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY) + " ELSE 50 END"
_ORIG = "(SELECT doc_id, source, ['publisher_epub','whisper_transcript','user_upload','tts_kokoro','librivox'][1 + doc_id % 5] AS origin FROM documents)"


@query(f"SELECT source, doc_id, CAST({_AUTH} AS INT) AS authority FROM {_ORIG} QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_AUTH} DESC, doc_id) = 1")
def top_authority_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: the text shown for each work, by authority of its origin; the first of equals."""
    names = F.array(*[F.lit(x) for x in ("publisher_epub", "whisper_transcript", "user_upload", "tts_kokoro", "librivox")])
    rank = F.create_map(*[F.lit(x) for p in AUTHORITY for x in p])
    d = table(spark, sf_dir, "documents").withColumn("authority", F.coalesce(F.try_element_at(rank, F.get(names, (F.col("doc_id") % 5).cast("int"))), F.lit(50)))
    return rel.first_by(d, ["source"], F.desc("authority"), F.asc("doc_id")).select("source", "doc_id", "authority")


@query("SELECT source, 100 * CAST(count(*) FILTER (lang = 'en') > 0 AS INT) + 100 * CAST(count(*) FILTER (lang <> 'en') > 0 AS INT) + count(*) AS score FROM documents GROUP BY 1")
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: how complete a work is."""
    some = lambda c: F.when(F.count_if(c) > 0, 100).otherwise(0)
    return table(spark, sf_dir, "documents").groupBy("source").agg((some(F.col("lang") == "en") + some(F.col("lang") != "en") + F.count("*")).alias("score"))


@query("SELECT c_custkey, lower(CASE WHEN contains(n, ',') THEN split_part(n, ',', 1) ELSE regexp_replace(n, '^.* ', '') END) AS author_key FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', ' || c_name ELSE c_mktsegment || ' ' || c_name END AS n FROM customer)")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA7: family names in either order."""
    n = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", "), "c_name")).otherwise(F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.author_key(n).alias("author_key"))


@query("SELECT l_orderkey, l_linenumber, title, TRY_CAST(regexp_extract(title, '(?i)(?:chapter|ch\\.?|letter|part)\\s*([0-9]+)', 1) AS INT) AS number FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'Chapter ' || l_linenumber || ': ' || l_returnflag ELSE 'Notes ' || l_linenumber END AS title FROM lineitem)")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA16: numbers of chapter titles."""
    n = F.col("l_linenumber").cast("string")
    title = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Chapter "), n, F.lit(": "), "l_returnflag")).otherwise(F.concat(F.lit("Notes "), n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", title.alias("title"), tx.chapter_number(title).alias("number"))


@query()
def cast_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24, AGG25: names of the cast of each work."""
    return entity.cast_names(table(spark, sf_dir, "documents"), "source", "doc_id")
