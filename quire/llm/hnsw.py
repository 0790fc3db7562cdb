"""Nearest neighbours by inner product from one small-world graph per shard.

Equal vectors count once: a distinct vector stands for its rows, of which the
``k + 1`` smallest identifiers can ever be among a query's ``k`` nearest (ties
go to smaller identifiers, and one may be the query itself).  Distinct vectors
are dealt to shards of about ``SHARD`` by a hash.

A shard's graph is hierarchical: a node's level is geometric in its hash, every
layer links nodes to at most ``M`` (layer 0: twice that) neighbours chosen by
the usual heuristic (a candidate is taken if it is nearer to the node than to
any neighbour taken before), and links are mutual before they are pruned.
Since a shard is bounded, candidates for the heuristic come from blocked
matrix products rather than from greedy insertion.  Neighbours are stored as
flat arrays.  Largest inner product becomes smallest distance through one more
coordinate that gives all vectors of the shard the same length.

A query descends the layers greedily and searches layer 0 with a beam of
``EF``; all queries of a block move in step.  Every shard gives its nearest,
which are scored in double precision on the original vectors, and the shards'
results are merged.

Defined results: vectors that are null, empty, zero, of another length than
most of the table's, or hold null or non-finite components take no part;
rows with a null identifier take no part either; equal rows (identifier and
vector) count once.  Rows that share an identifier but not the vector are rows
of their own: each is searched by itself and can be found by the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.scratch import materialize, partitions, trimmed

SHARD, M, CANDIDATES, EF = 4096, 16, 64, 96
QUERY_BLOCK = 512


def build_layer(x: np.ndarray, m: int, candidates: int = CANDIDATES) -> np.ndarray:
    """Neighbours of each row of ``x`` within it: an array of (rows, m), -1 where there are fewer."""
    n = len(x)
    links = np.full((n, m), -1, dtype=np.int32)
    if n < 2:
        return links
    c = min(candidates, n - 1)
    square = (x * x).sum(axis=1)
    near, apart = np.empty((n, c), dtype=np.int32), np.empty((n, c), dtype=np.float32)
    for a in range(0, n, 512):
        d = square[None, :] - 2 * (x[a : a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        part = np.argpartition(d, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(d, part, axis=1)
        by = np.argsort(value, axis=1, kind="stable")
        near[a : a + 512] = np.take_along_axis(part, by, axis=1)
        apart[a : a + 512] = np.take_along_axis(value, by, axis=1)
    apart += square[:, None]
    chosen = select(x, square, near, apart, max(1, m // 2))
    # Mutual links: each node offers itself to those it chose; a node keeps its own and the nearest offers.
    source, target = np.repeat(np.arange(n, dtype=np.int32), chosen.shape[1]), chosen.ravel()
    real = target >= 0
    source, target = np.concatenate([source[real], target[real]]), np.concatenate([target[real], source[real]])
    own = np.concatenate([np.zeros(real.sum()), np.ones(real.sum())])
    pair = source.astype(np.int64) * n + target
    by = np.lexsort((own, pair))
    once = by[np.concatenate([[True], pair[by][1:] != pair[by][:-1]])]
    source, target, own = source[once], target[once], own[once]
    distance = ((x[source] - x[target]) ** 2).sum(axis=1)
    by = np.lexsort((distance, own, source))
    source, target = source[by], target[by]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    kept = place < m
    links[source[kept], place[kept]] = target[kept]
    return links


def select(x: np.ndarray, square: np.ndarray, near: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """The heuristic over candidates in order of distance, for all nodes in step."""
    n, c = near.shape
    out = np.full((n, most), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    for j in range(c):
        cand = near[:, j]
        ok = count < most
        for i in range(most):
            taken = out[:, i]
            has = ok & (taken >= 0)
            if not has.any():
                break
            rows = np.flatnonzero(has)
            between = square[cand[rows]] + square[taken[rows]] - 2 * np.einsum("ij,ij->i", x[cand[rows]], x[taken[rows]])
            ok[rows[between < apart[rows, j]]] = False
        rows = np.flatnonzero(ok)
        out[rows, count[rows]] = cand[rows]
        count[rows] += 1
    return out


class Graph:
    """Layers of flat neighbour arrays over the vectors of a shard."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels, self.layers = x, levels, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seeds: np.ndarray, m: int = M) -> Graph:
        """``seeds``: an integer of each vector from which its level follows."""
        x = vectors.astype(np.float32)
        norm = (x * x).sum(axis=1)
        x = np.hstack([x, np.sqrt(np.maximum(0, norm.max(initial=0) - norm))[:, None]])
        u = ((seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2**53
        levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 12)
        layers = [(np.arange(len(x)), build_layer(x, 2 * m))]
        for level in range(1, int(levels.max(initial=0)) + 1):
            members = np.flatnonzero(levels >= level)
            if len(members) < 2:
                break
            layers.append((members, build_layer(x[members], m)))
        return cls(x, levels, layers)

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Up to ``ef`` nodes near each query, -1 where there are fewer."""
        q = np.hstack([queries.astype(np.float32), np.zeros((len(queries), 1), dtype=np.float32)])
        n, rows = len(self.x), np.arange(len(q))
        members, _ = self.layers[-1]
        here = np.full(len(q), members[0])
        for members, links in self.layers[:0:-1]:
            position = np.full(n, -1)
            position[members] = np.arange(len(members))
            at = position[here]
            best = np.einsum("ij,ij->i", q, self.x[members[at]])
            while True:
                near = links[at]
                score = np.einsum("ij,ikj->ik", q, self.x[members[np.maximum(near, 0)]])
                score[near < 0] = -np.inf
                top = score.argmax(axis=1)
                better = score[rows, top] > best
                if not better.any():
                    break
                at = np.where(better, near[rows, top], at)
                best = np.maximum(best, score[rows, top])
            here = members[at]
        links = self.layers[0][1]
        seen = np.zeros((len(q), n + 1), dtype=bool)
        seen[:, n] = True
        seen[rows, here] = True
        beam, score, open_ = np.full((len(q), ef), n), np.full((len(q), ef), -np.inf, dtype=np.float32), np.zeros((len(q), ef), dtype=bool)
        beam[:, 0], score[:, 0], open_[:, 0] = here, np.einsum("ij,ij->i", q, self.x[here]), True
        live = rows
        while len(live):
            waiting = np.where(open_[live], score[live], -np.inf)
            pick = waiting.argmax(axis=1)
            more = np.isfinite(waiting[np.arange(len(live)), pick])
            live, pick = live[more], pick[more]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[beam[live, pick]]
            near = np.where(near < 0, n, near)
            new = np.where(seen[live[:, None], near], n, near)
            seen[live[:, None], near] = True
            value = np.einsum("ij,ikj->ik", q[live], self.x[np.minimum(new, n - 1)])
            value[new == n] = -np.inf
            all_beam, all_score = np.hstack([beam[live], new]), np.hstack([score[live], value])
            all_open = np.hstack([open_[live], new < n])
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            beam[live], score[live], open_[live] = (np.take_along_axis(v, top, axis=1) for v in (all_beam, all_score, all_open))
        return np.where(np.isfinite(score), beam, -1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def _build_shard(width: int, m: int):
    def run(table: pa.Table) -> pa.Table:
        rep, least, vectors = table.column("rep").to_numpy(), table.column("least").to_numpy(), _matrix(table.column("raw").combine_chunks(), width)
        by = np.lexsort((rep, least))
        rep, least, vectors = rep[by], least[by], np.ascontiguousarray(vectors[by])
        graph = Graph.build(vectors, least, m)
        members = np.concatenate([a for a, _ in graph.layers]).astype("<i4")
        links = np.concatenate([b.ravel() for _, b in graph.layers]).astype("<i4")
        sizes = np.array([len(a) for a, _ in graph.layers], dtype="<i4")
        parts = [rep.astype("<i8"), least.astype("<i8"), vectors, graph.levels.astype("<i4"), sizes, members, links]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(_PARTS, parts, strict=True)})

    return run


_PARTS = ("reps", "leasts", "vectors", "levels", "sizes", "members", "links")


def _load(row: dict, width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    get = lambda k, kind: np.frombuffer(row[k], dtype=kind)
    vectors = get("vectors", "<f8").reshape(-1, width)
    x = vectors.astype(np.float32)
    norm = (x * x).sum(axis=1)
    x = np.hstack([x, np.sqrt(np.maximum(0, norm.max(initial=0) - norm))[:, None]])
    layers, at, to = [], 0, 0
    for level, size in enumerate(get("sizes", "<i4").tolist()):
        wide = m if level else 2 * m
        layers.append((get("members", "<i4")[at : at + size], get("links", "<i4")[to : to + size * wide].reshape(size, wide)))
        at, to = at + size, to + size * wide
    return get("reps", "<i8"), get("leasts", "<i8"), vectors, Graph(x, get("levels", "<i4"), layers)


def _search_batches(width: int, m: int, ef: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, loaded = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names) if name in ("shard", "ids", "raws")}
                if row["shard"] != shard:
                    shard = row["shard"]
                    loaded = _load({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names) if name in _PARTS}, width, m)
                reps, leasts, vectors, graph = loaded
                ids, queries = np.array(row["ids"]), np.frombuffer(b"".join(row["raws"]), dtype="<f8").reshape(-1, width)
                found = graph.search(queries, max(ef, k))
                score = np.einsum("ij,ikj->ik", queries, vectors[np.maximum(found, 0)])
                score[found < 0] = -np.inf
                by = np.lexsort((leasts[np.maximum(found, 0)], -score), axis=1)[:, :k]
                found, score = np.take_along_axis(found, by, axis=1), np.take_along_axis(score, by, axis=1)
                r, c = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(reps[found[r, c]], pa.int64()), pa.array(leasts[found[r, c]], pa.int64()), pa.array(score[r, c])], ["key", "rep", "least", "score"])

    return run


def _raw(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part, and ``w``, the length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("w", F.size("v"))


@F.pandas_udf(T.BinaryType())
def _pack(v):
    return v.map(lambda x: np.asarray(x, dtype="<f8").tobytes() if x is not None else None)


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_size: int = SHARD,
    m: int = M,
    ef: int = EF,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows of each query but itself.

    ``queries`` are rows of ``df`` in the same columns.  Work grows with queries
    times shards; a block of ``QUERY_BLOCK`` queries meets one shard at a time.
    """
    spark = df.sparkSession
    usable = _raw(df, id_col, vector_col)
    common = usable.groupBy("w").count().orderBy(F.desc("count"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    width = common["w"]
    rows = materialize(usable.where(F.col("w") == width).select("id", _pack("v").alias("raw")).distinct(), "vectors")
    first = rows.groupBy("raw").agg(F.min("id").alias("least"))
    # Numbers of distinct vectors and, below, of queries; a written table holds them fixed.
    distinct = materialize(first.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    n = distinct.count()
    shards = max(1, -(-n // shard_size))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("raw"), F.lit(shards)))
    kind = "shard long, " + ", ".join(f"{p} binary" for p in _PARTS)
    index = materialize(dealt.groupBy("shard").applyInArrow(_build_shard(width, m), kind), "graphs")

    asked = _raw(queries, id_col, vector_col).where(F.col("w") == width).select(F.col("id").alias("query_id"), _pack("v").alias("raw")).distinct()
    asked = asked.join(distinct.select("raw", F.col("rep").alias("own")), "raw", "left")
    asked = materialize(asked.withColumn("key", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = asked.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("key", "raw")).alias("q"))
    block = block.select("block", F.col("q.key").alias("ids"), F.col("q.raw").alias("raws"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    pairs = block.repartition(max(partitions(spark), shards), "shard", "block").join(index, "shard").sortWithinPartitions("shard")
    near = pairs.mapInArrow(trimmed(_search_batches(width, m, ef, k + 1)), "key long, rep long, least long, score double")
    by_rep = Window.partitionBy("key").orderBy(F.desc("score"), "least", "rep")
    best = near.withColumn("r", F.row_number().over(by_rep)).where(F.col("r") <= k + 1).drop("r", "least")

    order = Window.partitionBy("raw").orderBy("id")
    members = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).join(distinct, "raw").select("rep", "id")
    expanded = best.join(members, "rep").join(asked.select("key", "query_id", "own"), "key").where((F.col("id") != F.col("query_id")) | ~F.col("rep").eqNullSafe(F.col("own")))
    final = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    ranked = expanded.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
