"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
#: Bytes of rows that Spark hands to a Python worker at once; long texts make batches by row count very large.
BATCH_BYTES = 4_000_000
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_set_for: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Where the setting is absent, a session on a single machine (tests) uses a
    temporary folder; on a cluster the setting must name a shared store.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        _roots[app] = f"{base.rstrip('/')}/quire-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        if root.startswith("file:"):
            import shutil

            shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
        return
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage as a checkpoint does and survives lost executors,
    but is columnar and compressed, and the optimizer knows its size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_hash(text: Column) -> Column:
    """128 bits that tell rows of one identifier apart by their text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, once an application, unless it was started with a bound of its own."""
    app = spark.sparkContext.applicationId
    if app not in _set_for:
        _set_for.add(app)
        if not spark.sparkContext.getConf().contains(_BATCH_KEY):
            spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def trimmed(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` over Arrow batches; at its end the Python worker gives freed memory back.

    Workers wait for further tasks, several a core, and each would go on holding what its largest task took.
    """

    @wraps(run)
    def mapped(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            give_back()

    return mapped


def give_back() -> None:
    """Return memory that this process has freed to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
