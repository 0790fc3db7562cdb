"""Relational building blocks over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in ``order``; add a unique column last, so equals are settled (AGG7, AGG8, SET9).

    The rank limit is applied before the shuffle too, so a large group sends one row a task.
    """
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_by(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1 (WIN21, TOP5)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def orphans(df: DataFrame, parent: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows without a parent (JOI2 to JOI5)."""
    return df.join(parent, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` on top: a non-empty new value wins in each column (SRC17)."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return old.join(fresh, list(keys), "full_outer").select(*keys, *[F.coalesce(filled(f"__{c}"), F.col(c)).alias(c) for c in values])


def rekey(df: DataFrame, column: str, source: Column, target: Column, unique: Sequence[str]) -> DataFrame:
    """Move rows of key ``source`` to ``target``; where both have a row of the same ``unique`` columns, the target's stays (SET3)."""
    moved = df.withColumn("__moved", F.col(column) == source).withColumn(column, F.when(F.col(column) == source, target).otherwise(F.col(column)))
    rest = [F.col(c) for c in df.columns if c not in unique and c != column]
    return first_by(moved, unique, F.col("__moved").asc(), *rest).drop("__moved")


def replace_keys(df: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of ``fresh`` and those of ``df`` whose key it does not have (SET2, SET6)."""
    return df.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def changed(now: DataFrame, before: DataFrame, key: str, version: str) -> DataFrame:
    """Keys whose version is new or differs from before (SET8)."""
    old = before.select(key, F.col(version).alias("__old"))
    return now.join(old, key, "left").where(~F.col(version).eqNullSafe(F.col("__old"))).drop("__old")


def longest_prefix(df: DataFrame, path: Column, roots: DataFrame, root: str) -> DataFrame:
    """``df`` with the longest of ``roots`` that each path starts with, null if none (SRC18).

    Every prefix of a path that ends before a slash is a key, so this is an
    equality join on path depth times rows, not a comparison with every root.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = df.withColumn("__id", F.xxhash64(path)).withColumn("__path", path).withColumn("__prefix", F.explode(prefixes))
    known = roots.select(F.col(root).alias("__root")).distinct()
    best = keyed.join(known, F.col("__prefix") == F.col("__root")).groupBy("__path").agg(F.max_by("__root", F.length("__root")).alias(root))
    return df.withColumn("__path", path).join(best, "__path", "left").drop("__path")


def up_to_here(keys: Sequence[str], *order: Column | str):
    """The rows of a group up to the current one in ``order``: a frame that grows by one row at a time."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str], forward: bool = False) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before its time (JOI14 to JOI16).

    ``forward`` takes the first at or after it.  Both sides are merged in one
    sort by key and time, so cost does not depend on how many rows precede.
    Forward, that sort is backwards: a frame up to the end of a group would be
    read anew for each row.
    """
    pick = F.struct(F.col(right_time).alias("t"), *values)
    a = left.select(F.struct(*left.columns).alias("__l"), *keys, F.col(time).alias("__t"), F.lit(None).cast(right.select(pick).schema[0].dataType).alias("__r"), F.lit(1 if not forward else 0).alias("__side"))
    b = right.select(F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), *keys, F.col(right_time).alias("__t"), pick.alias("__r"), F.lit(0 if not forward else 1).alias("__side"))
    order = ["__t", "__side"] if not forward else [F.desc("__t"), F.desc("__side")]
    found = F.last("__r", True).over(up_to_here(keys, *order))
    out = a.unionByName(b).withColumn("__f", found).where("__l is not null")
    return out.select("__l.*", *[F.col(f"__f.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the half-open spans that hold them (JOI13, JOI17), by equal buckets of ``width``."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def span_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, c: str, d: str, width: float) -> DataFrame:
    """Half-open spans ``a`` to ``b`` with the spans ``c`` to ``d`` that they meet (JOI11): both end after the other starts.

    Each side is dealt to the buckets of ``width`` that it touches, so that a key
    with many spans is shared by tasks; a pair is kept in the bucket of the later
    start only, where both are.  Spans with a null end meet nothing.
    """
    floor = lambda x: F.floor(F.col(x) / width)
    dealt = lambda df, x, y: df.withColumn("__b", F.explode(F.sequence(floor(x), F.greatest(floor(x), floor(y)))))
    both = dealt(left, a, b).join(dealt(right, c, d), [*keys, "__b"])
    return both.where((F.col(c) < F.col(b)) & (F.col(d) > F.col(a)) & (F.col("__b") == F.greatest(floor(a), floor(c)))).drop("__b")


def overlapping(df: DataFrame, start: str, end: str, a: str, b: str) -> DataFrame:
    """Rows whose span meets ``a`` to ``b``; where that is empty, every row (FIL12)."""
    return df.where((F.col(b) <= F.col(a)) | (F.col(end) > F.col(a)) & (F.col(start) < F.col(b)))


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """Rows where ``flag`` holds, numbered by unbroken run (WIN3, WIN6): the gap between two row numbers is constant in a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__all", F.row_number().over(w)).where(flag)
    return marked.withColumn(name, F.col("__all") - F.row_number().over(w)).drop("__all")


def reachable(edges: DataFrame, start: DataFrame, steps: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and the least number of ``hops`` to it from ``start`` (node), in at most ``steps`` rounds of joins.

    Each round is written to the checkpoint folder, which must be set, so none is computed again by the next.
    """
    both = edges.select(src, dst).unionByName(edges.select(F.col(dst).alias(src), F.col(src).alias(dst))).distinct()
    seen = start.select("node").distinct().withColumn("hops", F.lit(0)).checkpoint()
    front = seen
    for i in range(1, steps + 1):
        front = front.join(both, F.col("node") == F.col(src)).select(F.col(dst).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(i)).checkpoint()
        seen = seen.unionByName(front)
    return seen
