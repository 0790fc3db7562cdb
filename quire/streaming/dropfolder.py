"""A drop folder as a stream: files are handed on once they are at rest, tried again when handling fails, and set aside in the end.

Each path has state of its own: what was last seen of the file, how often
handling failed, and a timer of event time that goes off when the file is to be
handed on.  Results of handling come back in the same stream, so a restart goes
on where the last batch ended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds at rest after which a file is whole, milliseconds until a failed one is tried again, and failures after which it is set aside.
REST_MS, AGAIN_MS, TRIES = 3000, 5000, 3
#: Endings of files by the shelf they go to.
SHELVES = (("audiobooks", r"(?i)\.(mp3|m4b|m4a|flac|aac|opus|ogg|stt\.json)$"), ("ebooks", r"(?i)\.(epub|pdf|mobi|azw3|txt)$"))
ROW = "path string, action string, shelf string, tries int, ms long, error string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shelf_of(path: str) -> str | None:
    return next((shelf for shelf, ending in SHELVES if re.search(ending, path)), None)


class Arrival:
    """What is known of one path: its size, when it is to be handed on (-1: not), and failures since it was last at rest elsewhere."""

    def __init__(self, path: str, size: int = -1, due: int = -1, tries: int = 0):
        self.path, self.size, self.due, self.tries = path, size, due, tries

    def _row(self, action: str, ms: int, error: str | None) -> tuple:
        return self.path, action, shelf_of(self.path), self.tries, ms, error

    def _clear(self) -> None:
        self.size, self.due, self.tries = -1, -1, 0

    def advance(self, ms: int) -> list[tuple]:
        """What falls due by a moment: the file is handed on, or set aside if no shelf takes it."""
        if not 0 <= self.due <= ms:
            return []
        due, self.due = self.due, -1
        if shelf_of(self.path) is not None:
            return [self._row("ready", due, None)]
        row = self._row("dead", due, "unsupported file type")
        self._clear()
        return [row]

    def step(self, ms: int, what: str, size: int, error: str | None) -> list[tuple]:
        """One row of the stream: ``written``, ``failed`` or ``done``."""
        out = self.advance(ms)
        if what == "written":
            if self.due < 0 or size != self.size:
                self.size, self.due = size, ms + REST_MS
        elif what == "failed":
            self.tries += 1
            if self.tries >= TRIES:
                out.append(self._row("dead", ms, error))
                self._clear()
            else:
                self.due = ms + AGAIN_MS
        elif what == "done":
            self._clear()
        return out


class DropFolder(StatefulProcessor):
    """`Arrival` by path, kept between batches in two variables of state and a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "size long, due long")
        self.failures = handle.getValueState("failures", "tries int")

    def _load(self, key) -> Arrival:
        size, due = self.file.get() if self.file.exists() else (-1, -1)
        return Arrival(key[0], size, due, self.failures.get()[0] if self.failures.exists() else 0)

    def _keep(self, a: Arrival) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if a.due >= 0:
            self.handle.registerTimer(a.due)
        for state, value, held in ((self.file, (a.size, a.due), a.size >= 0 or a.due >= 0), (self.failures, (a.tries,), a.tries > 0)):
            if held:
                state.update(value)
            elif state.exists():
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        a, out = self._load(key), []
        for row in pd.concat(list(rows)).sort_values(["ms", "what", "size"]).itertuples():
            out += a.step(int(row.ms), row.what, int(row.size), row.error if isinstance(row.error, str) else None)
        self._keep(a)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        a = self._load(key)
        out = a.advance(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(a)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"path": object, "action": object, "shelf": object, "tries": "int32", "ms": "int64", "error": object}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def arrivals(seen: DataFrame, late: str = "1 minute") -> DataFrame:
    """Files that are ready or set aside (STR4, STR1, FIL15): path, action (ready, dead), shelf, tries, at, error.

    ``seen``: path, at, what (written, failed, done), size, error.  A file is ready
    three seconds after its size last changed, and again five seconds after handling
    it failed; the third failure sets it aside, and so does an ending that no shelf
    takes.  Names that start with a dot are passed over.  Rows more than ``late``
    behind the newest are not seen.
    """
    spark = seen.sparkSession
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)  # the only one that has timers and several variables
    shown = seen.where(~F.startswith(F.substring_index("path", "/", -1), F.lit("."))).withWatermark("at", late)
    rows = shown.select("path", "at", "what", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "error", F.unix_millis("at").alias("ms"))
    found = rows.groupBy("path").transformWithStateInPandas(DropFolder(), ROW, "Append", "EventTime")
    return found.select("path", "action", "shelf", "tries", F.timestamp_millis("ms").alias("at"), "error")


def deal(seen: DataFrame, ready: str, dead: str, checkpoint: str, late: str = "1 minute") -> None:
    """Run ``arrivals`` over what is there; the ready and the dead are written apart, by batch, so that a batch that runs again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        for action, folder in (("ready", ready), ("dead", dead)):
            batch.where(F.col("action") == action).drop("action").write.mode("overwrite").parquet(f"{folder}/batch={n}")
        batch.unpersist()

    arrivals(seen, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dealt(spark, folder: str) -> DataFrame:
    """What ``deal`` has written to a folder."""
    return spark.read.schema("path string, shelf string, tries int, at timestamp, error string").option("recursiveFileLookup", "true").parquet(folder)
