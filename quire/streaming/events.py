"""Structured Streaming over listening events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream of event files; times are given a zone so they can carry a watermark.

    With ``per_trigger`` files a batch, files must come in order of time: a later
    batch's rows behind the watermark of an earlier one are dropped.
    """
    s = spark.readStream.schema(schema)
    s = (s if per_trigger is None else s.option("maxFilesPerTrigger", per_trigger)).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, with state kept for as long as it may come again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily(events: DataFrame) -> DataFrame:
    """Seconds and events a day, of a stream with a watermark; a day is given out when the watermark has passed it."""
    w = events.groupBy(F.window("ts", "1 day").alias("w"))
    return w.agg(F.round(F.sum("value"), 4).alias("seconds"), F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "seconds", "n")


def settled_positions(events: DataFrame, quiet_ms: int = 3000) -> DataFrame:
    """The last event of each user once no other has come for a while of processing time (debounce)."""

    def settle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            user, (event, value) = key[0], state.get
            state.remove()
            yield pd.DataFrame({"user_id": [user], "event_id": [event], "value": [value]})
            return
        best = state.get if state.exists else (-1, 0.0)
        for pdf in batches:
            i = pdf["event_id"].idxmax()
            if pdf.at[i, "event_id"] > best[0]:
                best = (int(pdf.at[i, "event_id"]), float(pdf.at[i, "value"]))
        state.update(best)
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("user_id").applyInPandasWithState(settle, "user_id long, event_id long, value double", "event_id long, value double", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Milliseconds of quiet after which a file is taken to be whole, looks after which it is taken anyway, and failed tries after which it is set aside.
QUIET_MS, LOOKS, TRIES = 1000, 15, 3


def settled_files(changes: DataFrame, quiet_ms: int = QUIET_MS, looks: int = LOOKS) -> DataFrame:
    """Files that have stopped growing (STR1, STR2): path, size, forced.

    ``changes``: path and size, a row whenever a folder is looked at.  A file is
    given out once its size has stayed the same for a while of processing time,
    or after many changes; state goes with it.
    """

    def settle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, seen = state.get if state.exists else (-1, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "size": [size], "forced": [False]})
            return
        for pdf in batches:
            for now in pdf["size"]:
                if int(now) != size:
                    size, seen = int(now), seen + 1
        if seen > looks:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"path": [key[0]], "size": [size], "forced": [True]})
            return
        state.update((size, seen))
        state.setTimeoutDuration(quiet_ms)

    return changes.groupBy("path").applyInPandasWithState(settle, "path string, size long, forced boolean", "size long, seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def vanished(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Files that were there at the last look and no longer are (STR3, OTH13); those that were made here have no file."""
    return before.where(~F.startswith(key, F.lit("generated://"))).join(now.select(key), key, "left_anti")


def sorted_drops(jobs: DataFrame) -> DataFrame:
    """Where files of a drop folder go (STR4, FIL15): path, kind, state.

    ``jobs``: path, age_sec (since the last write) and tries.  Hidden files are
    passed over; files written to within three seconds wait; unknown kinds and
    those that failed three times are set aside.
    """
    name = F.substring_index("path", "/", -1)
    kind = F.when(F.col("path").rlike(r"(?i)\.(mp3|m4b|m4a|flac|aac|opus|ogg)$|\.stt\.json$"), "audiobooks").when(F.col("path").rlike(r"(?i)\.(epub|pdf|mobi|azw3|txt)$"), "ebooks")
    state = F.when(F.col("age_sec") < 3, "waiting").when(kind.isNull() | (F.col("tries") >= TRIES), "failed").otherwise("ready")
    return jobs.where(~F.startswith(name, F.lit("."))).select("path", kind.alias("kind"), state.alias("state"))


def kept_logs(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Log rows of a stream that are not older than its retention (STR6): later ones push the watermark, which drops the rest."""
    return rows.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["id"])


def newest_writes(positions: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """The write of each key with the latest time of its own (STR8), whatever order they came in; of equal times the larger identifier."""
    rest = [c for c in positions.columns if c not in keys]
    return positions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, "id")).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest])


def changed_works(versions: DataFrame, seen: DataFrame) -> DataFrame:
    """Works to be checked again (STR9, OTH8): those whose content has another stamp than when they were last looked at."""
    return versions.join(seen.select("work", F.col("version").alias("was")), "work", "left").where(~F.col("version").eqNullSafe(F.col("was"))).select("work", "version")


def append_playback(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Listening events added to a table by day (STR12); an event that comes again within an hour is one."""
    rows = deduplicated(stream).withColumn("day", F.to_date("ts"))
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).outputMode("append").start().awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there and append its rows as Parquet under ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 16) -> None:
    """Keep the newest row of each key as a table of versions ``path/v=N`` (STR7).

    Keys are dealt to ``buckets`` by hash; a batch writes only the buckets it
    has rows of, as new versions of those.  A batch that runs again after a
    failure writes the same version anew.
    """
    spread = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", spread)
        old = newest_buckets(spark, path, fresh.schema, before=n)
        rows = fresh if old is None else fresh.unionByName(old.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi"))
        newest = rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r"))
        newest.select(*keys, "bucket", "r.*").select(*batch.columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_buckets(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame | None:
    """The newest version of each bucket under ``path`` (of those before a version); None where there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    newest: dict[str, int] = {}
    for version in files.listStatus(root):
        name = version.getPath().getName()
        if not name.startswith("v=") or (before is not None and int(name[2:]) >= before):
            continue
        for bucket in files.listStatus(version.getPath()):
            b = bucket.getPath().getName()
            if b.startswith("bucket="):
                newest[b] = max(newest.get(b, -1), int(name[2:]))
    if not newest:
        return None
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/v={v}/{b}" for b, v in sorted(newest.items())])
    return rows.select(*schema.fieldNames())


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``upsert_latest`` keeps under ``path``."""
    kind = StructType.fromDDL(f"{schema}, bucket int")
    rows = newest_buckets(spark, path, kind)
    return (spark.createDataFrame([], kind) if rows is None else rows).drop("bucket")
