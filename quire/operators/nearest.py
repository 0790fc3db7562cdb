"""Nearest vectors among the rows of the same keys, by blocks.

All pairs of a key have to be looked at, so the work grows with the square of a
key's rows.  Both sides are dealt to blocks of at most about ``BLOCK`` rows, and
a task has two blocks at a time, whatever the size of a key: one matrix product
tells which pairs can be among the nearest, and only these are measured in the
order of additions that the column functions of ``functions.vector`` have, so
that scores and ties are theirs.  Each pair of blocks gives ``k`` rows a question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, cells of a product that are held at once, and what rounding can add to a product of vectors of length 1.
BLOCK, CELLS, SLACK = 4096, 1 << 22, 1e-9


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; null elements and those beyond a vector's end are zero."""
    out = np.zeros((len(lists), width))
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, within] = np.asarray(whole.flatten().cast(pa.float64()).fill_null(0.0))
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first element on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As ``in_order`` for the rows ``i`` of ``a`` with the rows ``j`` of ``b``, which are never copied whole."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d] * b[j, d]
    return out


def block_nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, measure: str, least: float | None, places: int | None, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``v``, score) of the ``k`` nearest of each row of ``q``; of equals the smallest of ``ids``, or the ``last``; ``measure`` as in ``nearest``."""
    qn, vn = np.sqrt(in_order(q, q)), np.sqrt(in_order(v, v))
    with np.errstate(all="ignore"):
        unit = lambda x, n: x / np.where(n == 0, 1.0, n)[:, None]
        near_q, near_v = unit(q, qn), unit(v, vn)
        if measure == "unit":
            q, v = near_q, near_v
        slack = SLACK + (0.0 if places is None else 10.0**-places)
        found = []
        step = max(1, CELLS // max(1, len(v)))
        for at in range(0, len(q), step):
            rough = near_q[at : at + step] @ near_v.T
            rough[np.isnan(rough)] = np.inf  # settled by the exact measure
            if measure == "unit":
                rough[qn[at : at + step] == 0], rough[:, vn == 0] = -np.inf, -np.inf
            bar = rough.max(axis=1) if k == 1 else np.partition(rough, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
            bar = np.where(np.isfinite(bar), bar - slack, bar)
            if least is not None:
                bar = np.maximum(bar, least - slack)
            i, j = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
            del rough
            i += at
            score = _paired(q, i, v, j)
            if measure == "cosine":
                size = qn[i] * vn[j]
                score = np.where(size == 0, 0.0, score / np.where(size == 0, 1.0, size))
            if least is not None:
                keep = ~(score < least)
                i, j, score = i[keep], j[keep], score[keep]
            rank = np.where(np.isnan(score), np.inf, score if places is None else np.round(score, places))
            by = np.lexsort((-ids[j] if last else ids[j], -rank, i))
            i, j, score = i[by], j[by], score[by]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]])))
            keep = place < k
            found.append((i[keep], j[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def nearest(asked: DataFrame, rows: DataFrame, keys: list[str], k: int, measure: str, *, least: float | None = None, places: int | None = None, last: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest ``rows`` of each of ``asked`` with the same keys: keys, asked, id, score, rank from 1.

    ``asked``: keys, asked (a long, once a key) and q; ``rows``: keys, id (a long)
    and v.  ``measure``: the cosine, 0 with a zero vector, or the inner product of
    unit vectors, where zero vectors have no partner.  ``least`` is needed; scores count as equal when they are to ``places`` digits; of
    equals the smallest identifier is first, or the ``last``.  Null keys and vectors have no partner.
    """
    asked, rows = asked.where("q is not null").select(*keys, "asked", "q"), rows.where("v is not null").select(*keys, "id", "v")
    kinds = {c: t for c, t in asked.dtypes}
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    both = blocks(asked, "__na").join(blocks(rows, "__nb"), keys)
    dealt = lambda df, id_, own, other: df.join(both, keys).withColumn(own, F.pmod(F.xxhash64(id_), F.col(f"__n{own[2:]}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"__n{other[2:]}") - 1))).drop("__na", "__nb")
    by = [*keys, "__a", "__b"]
    # Blocks are small and work on them is not, so their number, not their bytes, decides how they are shared.
    fresh = lambda df: df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])  # noqa: E731  # both sides can be of one table
    a, b = dealt(asked, "asked", "__a", "__b").repartition(n, *by), fresh(dealt(rows, "id", "__b", "__a")).repartition(n, *[f"r_{c}" for c in by])
    names = ["asked", "id", "score"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = [left.column(c) for c in keys]
        if not left.num_rows or not right.num_rows:
            return pa.table([c.slice(0, 0) for c in kept] + [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=[*keys, *names])
        widest = lambda x: int(np.asarray(x.combine_chunks().value_lengths()).max())
        width = max(widest(left.column("q")), widest(right.column("r_v")))
        ids, own = np.asarray(right.column("r_id")), np.asarray(left.column("asked"))
        i, j, score = block_nearest(matrix(left.column("q"), width), matrix(right.column("r_v"), width), ids, k, measure, least, places, last)
        return pa.table([c.take(pa.array(i)) for c in kept] + [pa.array(own[i]), pa.array(ids[j]), pa.array(score)], names=[*keys, *names])

    found = a.groupBy(*by).cogroup(b.groupBy(*[f"r_{c}" for c in by])).applyInArrow(search, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "asked long, id long, score double"]))
    w = Window.partitionBy(*keys, "asked").orderBy(*_order(places, last))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _order(places: int | None, last: bool) -> list[Column]:
    return [F.desc("score") if places is None else F.desc(F.round("score", places)), F.desc("id") if last else F.asc("id")]
