"""Streaming queries, run over what the event table holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.base import query, shared_folder, table
from quire.streaming import dropfolder
from quire.streaming import events as ev


def work_folder(spark: SparkSession, name: str) -> str:
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/quire-stream/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS seconds, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY 1")
def streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1, AGG1 as a stream: days that the watermark (a day behind) has closed."""
    folder = work_folder(spark, "daily")
    path = f"{sf_dir}/events.parque[t]"  # a pattern, so that a single file is taken as well as a folder
    stream = ev.daily(ev.deduplicated(ev.read_events(spark, path, table(spark, sf_dir, "events").schema), late="1 day"))
    ev.run_available(stream, f"{folder}/out", f"{folder}/state")
    done = spark.read.schema("day date, seconds double, n long").parquet(f"{folder}/out")
    return done.select(F.col("day").cast("string").alias("day"), "seconds", "n")


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def streamed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7: newest position of each user, kept by a stream."""
    folder = work_folder(spark, "positions")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "event_id", "value")
    ev.upsert_latest(stream, f"{folder}/out", f"{folder}/state", ["user_id"], "event_id")
    return ev.read_latest(spark, f"{folder}/out", "user_id long, event_id long, value double")


_DROPS = "(SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, event_type = 'purchase' AS done, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type = 'purchase', event_id) AS next, (SELECT max(epoch_us(ts) // 1000) FROM events) - 60000 AS passed FROM events)"


@query(f"SELECT user_id, CASE WHEN user_id % 5 = 4 THEN 'dead' ELSE 'ready' END AS action, CASE user_id % 5 WHEN 0 THEN 'audiobooks' WHEN 1 THEN 'ebooks' WHEN 2 THEN 'audiobooks' WHEN 3 THEN 'ebooks' END AS shelf, ms + 3000 AS ms FROM {_DROPS} WHERE NOT done AND ms + 3000 <= coalesce(next, passed) AND ms + 3000 <= passed")
def drop_folder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4, STR1: files of a drop folder as they come to rest, by timers of a stream; an event is a write of its user's file, a purchase says that it was handled."""
    folder = work_folder(spark, "drops")
    schema = table(spark, sf_dir, "events").schema
    ending = F.get(F.array(*[F.lit(x) for x in (".mp3", ".epub", ".stt.json", ".txt", ".zip")]), (F.col("user_id") % 5).cast("int"))
    what = F.when(F.col("event_type") == "purchase", "done").otherwise("written")
    seen = ev.read_events(spark, f"{sf_dir}/events.parque[t]", schema).select(F.concat(F.lit("/in/"), F.col("user_id").cast("string"), ending).alias("path"), F.col("ts").alias("at"), what.alias("what"), F.col("event_id").alias("size"), F.lit(None).cast("string").alias("error"))
    ev.run_available(dropfolder.arrivals(seen), f"{folder}/out", f"{folder}/state")
    out = spark.read.schema("path string, action string, shelf string, tries int, at timestamp, error string").parquet(f"{folder}/out")
    return out.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("user_id"), "action", "shelf", F.unix_millis("at").alias("ms"))
