"""Queries over paths, formats and roots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import relational as rel
from quire.plans.base import query, shared_folder, table
from quire.sources import bookfiles, readers

_EXT = "['epub','azw3','pdf','txt','mp3','ogg','zip'][CAST(1 + doc_id % 7 AS INT)]"
_PATH = f"(SELECT doc_id, '/library/' || source || '/' || lang || '/The_Book-' || doc_id || '.' || {_EXT} AS path, {_EXT} AS ext FROM documents)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a library with stated paths."""
    ext = F.get(F.array(*[F.lit(x) for x in ("epub", "azw3", "pdf", "txt", "mp3", "ogg", "zip")]), (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("/library/"), "source", F.lit("/"), "lang", F.lit("/The_Book-"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(f"""SELECT doc_id, CASE ext WHEN 'azw3' THEN 'mobi' WHEN 'txt' THEN 'text' WHEN 'ogg' THEN 'opus' ELSE ext END AS format, CASE WHEN ext IN ('mp3', 'ogg') THEN 'audio' ELSE 'text' END AS media_type,
CASE ext WHEN 'epub' THEN 'publisher_epub' WHEN 'azw3' THEN 'publisher_mobi' WHEN 'pdf' THEN 'publisher_pdf' ELSE 'user_upload' END AS origin, 'The Book ' || doc_id AS title FROM {_PATH} WHERE ext <> 'zip'""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC3, SRC4: formats, origins and titles of files."""
    return readers.classify(paths(spark, sf_dir)).select("doc_id", "format", "media_type", "origin", "title")


@query(f"SELECT doc_id, CASE WHEN path LIKE '/library/src1/en/%' THEN '/library/src1/en' WHEN path LIKE '/library/src1/%' THEN '/library/src1' WHEN path LIKE '/library/src2/%' THEN '/library/src2' END AS root FROM {_PATH}")
def root_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: the longest root above each file."""
    roots = spark.createDataFrame([("/library/src1",), ("/library/src1/en",), ("/library/src2",)], "root string")
    return rel.longest_prefix(paths(spark, sf_dir), F.col("path"), roots, "root").select("doc_id", "root")


@query(f"SELECT doc_id FROM {_PATH} WHERE starts_with(path, '/library/src3/') ORDER BY doc_id LIMIT 1")
def work_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL6: one work under a folder."""
    return paths(spark, sf_dir).where(F.startswith("path", F.lit("/library/src3/"))).orderBy("doc_id").limit(1).select("doc_id")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host, regexp_replace(regexp_replace(url, '^.*/', ''), '[?#].*$', '') AS leaf FROM pages")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and last part of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/?#].*$", "").alias("host"), F.regexp_replace(F.regexp_replace("url", "^.*/", ""), "[?#].*$", "").alias("leaf"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS series, CASE WHEN p_size % 2 = 0 THEN p_size END AS idx FROM part")
def series_from_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: series and place from titles."""
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(", Book "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    s = table(spark, sf_dir, "part").select("p_partkey", tx.series_of(title).alias("s"))
    return s.select("p_partkey", F.col("s.name").alias("series"), F.col("s.index").alias("idx"))


@query("""SELECT doc_id // 100 AS work, 'text/chapter-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS VARCHAR), 3, '0') || '.html' AS member, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256, 'ok' AS state FROM (SELECT doc_id, '<h1>' || doc_id || '</h1><p>' || coalesce(text, '') || '</p>' AS html FROM documents)""")
def archived_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC14, SRC15: every hundred documents packed as a book's archive, read again as a source and held against the manifest."""
    root = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex[:12]}"
    html = F.concat(F.lit("<h1>"), F.col("doc_id").cast("string"), F.lit("</h1><p>"), F.coalesce("text", F.lit("")), F.lit("</p>"))
    chapters = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("work"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("title"), html.alias("html"))
    bookfiles.pack(chapters, root, "work").write.format("noop").mode("overwrite").save()
    found = bookfiles.read(spark, "archive", root).where("state <> 'manifest'")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.abook$", 1).cast("long").alias("work"), "member", "size", "sha256", "state")
