"""Queries over what comes in: probes, transcript files, drop folders, positions and stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.base import query, table
from quire.sources import readers
from quire.streaming import events as ev


@query("SELECT p_partkey, idx, CASE WHEN (p_partkey + idx) % 3 = 0 THEN 'Chapter ' || (idx + 1) ELSE p_name || ' ' || idx END AS title, idx * 12.5::DOUBLE AS start_sec, CASE WHEN p_partkey % 5 = 0 AND idx = 1 THEN 0 ELSE idx * 12.5 + 10 END::DOUBLE AS end_sec FROM (SELECT p_partkey, p_name, CAST(unnest(range(0, p_size % 4)) AS INT) AS idx FROM part)")
def embedded_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, OTH17: chapter marks inside files."""
    p = table(spark, sf_dir, "part").where("p_size % 4 > 0").select("p_partkey", "p_name", F.sequence(F.lit(0), F.col("p_size") % 4 - 1).alias("i"))
    title = lambda i: F.when((F.col("p_partkey") + i) % 3 == 0, "").otherwise(F.concat("p_name", F.lit(" "), i.cast("string")))
    end = lambda i: F.when((F.col("p_partkey") % 5 == 0) & (i == 1), "n/a").otherwise((i * 12.5 + 10).cast("string"))
    one = lambda i: F.struct(i.alias("id"), (i * 12.5).cast("string").alias("start_time"), end(i).alias("end_time"), F.struct(title(i).alias("title")).alias("tags"))
    probed = p.select("p_partkey", F.to_json(F.struct(F.transform("i", one).alias("chapters"))).alias("json"))
    return readers.embedded_chapters(probed, "p_partkey", "json")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '/a/' || p_brand || '.stt.json' WHEN p_partkey % 2 = 0 THEN '/a/' || p_brand || '/' || p_partkey || '.stt.json' WHEN p_partkey % 3 = 0 THEN '/a/' || p_brand || '/' || p_partkey || '.mp3.stt.json' END AS sidecar FROM part")
def sidecar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH19: the transcript file of each audio file, by the first name that exists."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    files = p.select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("/a/"), "p_brand", F.lit("/"), n, F.lit(".mp3"))).otherwise(F.concat(F.lit("/b/"), "p_brand", F.lit("/"), n, F.lit(".mp3"))).alias("path"))
    present = p.where("p_partkey % 6 = 0").select(F.concat(F.lit("/a/"), "p_brand", F.lit(".stt.json")).alias("path"))
    bare = F.concat(F.lit("/b/"), "p_brand", F.lit("/"), n)
    present = present.unionByName(p.where("p_partkey % 2 = 0").select(F.concat(bare, F.lit(".stt.json")).alias("path"))).unionByName(p.where("p_partkey % 3 = 0").select(F.concat(bare, F.lit(".mp3.stt.json")).alias("path"))).distinct()
    found = readers.sidecar_of(files, present)
    return found.select("p_partkey", F.regexp_replace("sidecar", "^/b/", "/a/").alias("sidecar"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'audiobooks' WHEN 1 THEN 'ebooks' WHEN 2 THEN 'audiobooks' WHEN 3 THEN 'ebooks' END AS kind, CASE WHEN p_partkey % 7 < 3 THEN 'waiting' WHEN p_size % 5 = 4 OR p_partkey % 5 >= 3 THEN 'failed' ELSE 'ready' END AS state FROM part WHERE p_partkey % 11 <> 0")
def drop_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4, FIL15: where dropped files go."""
    p = table(spark, sf_dir, "part")
    ext = F.get(F.array(*[F.lit(x) for x in (".MP3", ".epub", ".stt.json", ".txt", ".zip")]), F.col("p_size") % 5)
    name = F.concat(F.when(F.col("p_partkey") % 11 == 0, ".").otherwise(""), F.col("p_partkey").cast("string"), ext)
    jobs = p.select(F.concat(F.lit("/in/"), name).alias("path"), (F.col("p_partkey") % 7).alias("age_sec"), (F.col("p_partkey") % 5).alias("tries"))
    return ev.sorted_drops(jobs).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("p_partkey"), "kind", "state")


@query("SELECT user_id, work, arg_max(event_id, (t, event_id)) AS id, arg_max(value, (t, event_id)) AS value FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS work, event_id, value, ts - INTERVAL 3 HOUR * (event_id % 4) AS t FROM events) GROUP BY 1, 2")
def device_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8: positions of devices by their own time, whatever order they came in."""
    late = F.make_interval(hours=(F.col("event_id") % 4 * 3).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).alias("work"), F.col("event_id").alias("id"), "value", (F.col("ts") - late).alias("ts"))
    return ev.newest_writes(e, ["user_id", "work"]).select("user_id", "work", "id", "value")


@query("SELECT o_orderkey AS work, CAST(o_orderdate AS VARCHAR)[1:10] AS version FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 2 = 0")
def works_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9, OTH8: works whose content changed since the last look."""
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_orderdate").cast("date").cast("string").alias("version"), "o_custkey")
    seen = now.where("work % 3 = 0").withColumn("version", F.when(F.col("o_custkey") % 2 == 0, "old").otherwise(F.col("version")))
    return ev.changed_works(now.drop("o_custkey"), seen)


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_partkey % 4 <> 0")
def vanished_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3, OTH13: files that are gone since the last look, made ones aside."""
    p = table(spark, sf_dir, "part").withColumn("path", F.concat(F.when(F.col("p_partkey") % 4 == 0, "generated://").otherwise("/lib/"), F.col("p_partkey").cast("string")))
    return ev.vanished(p.select("p_partkey", "path"), p.where("p_size % 3 <> 0").select("path")).select("p_partkey")


@query("SELECT vec_id, len(embedding) * 4 AS bytes, CAST(len(embedding) AS INT) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA35, SRC16: vectors as blobs and back, with their size by length."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", readers.float_blob(F.col("embedding")).alias("b"))
    back = e.select("vec_id", F.length("b").cast("long").alias("bytes"), readers.blob_floats(F.col("b")).alias("v"))
    return back.select("vec_id", "bytes", F.size("v").alias("size"), F.round(F.get("v", 0).cast("double"), 6).alias("first"))
