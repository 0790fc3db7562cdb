"""Makes the package known to Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

import quire

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once a session."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(quire.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(f):
    """The query with its package sent first."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return f(spark, sf_dir)

    return run
