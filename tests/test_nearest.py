"""Nearest vectors by blocks against all pairs by column functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vector as vec
from quire.operators import search as sr
from quire.operators.nearest import nearest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8)).round(1)
    v[10:16] = v[10]  # copies
    v[20] = 0
    found = [(i, "ab"[i % 2], [float(x) for x in v[i]]) for i in range(60)]
    return spark.createDataFrame([*found, (60, "a", None), (61, None, [1.0] * 8), (62, "a", [1.0, None] + [0.5] * 6)], "id long, book string, v array<float>")


@pytest.mark.parametrize(("k", "least", "last", "block"), [(1, None, True, 7), (3, 0.2, False, 7), (9, None, False, 7), (5, 0.1, True, 4096)])
def test_blocks_give_what_all_pairs_give(spark, rows, k, least, last, block):
    asked = rows.where("id % 3 = 0").select("book", F.col("id").alias("asked"), F.col("v").alias("q"))
    got = nearest(asked, rows, ["book"], k, "cosine", least=least, last=last, block=block).select("asked", "id", "score", "rank").collect()
    s = asked.join(rows, "book").where("q is not null and v is not null").withColumn("score", vec.cosine(F.col("q"), F.col("v"))).where("true" if least is None else f"score >= {least}")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.desc("id") if last else F.asc("id"))
    want = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "id", "score", "rank").collect()
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_unit_vectors_leave_zero_vectors_out(spark, rows):
    asked = rows.where("id % 2 = 0").select("book", F.col("id").alias("asked"), F.col("v").alias("q"))
    got = nearest(asked, rows, ["book"], 1, "unit", least=-2.0, places=12, last=True, block=5).collect()
    assert {r["asked"] for r in got} == {i for i in range(0, 63, 2) if i not in (20, 60)}
    assert {r["id"] for r in got if r["asked"] in (10, 12, 14)} == {14}  # the last of equals


def test_scope_heads_are_enough_for_an_answer(spark):
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("third"), F.col("id").alias("place"), F.when(F.col("id") % 7 < 5, F.array(*[F.lit(x) for x in "abab"])).otherwise(F.array(*[F.lit(x) for x in "abcd"])).alias("tokens"))
    asked = spark.range(0, 60, 5).select(F.col("id").alias("question"), (F.col("id") % 3).alias("third"))
    good = ~tx.is_pure_repetition(F.col("tokens"))
    pairs = lambda df: asked.join(df, "third").where("id <> question").select("question", "id", "place", "tokens")
    scored = spark.createDataFrame([(0, 399, 0.5), (5, 398, 0.5), (5, 4, 0.1)], "question long, id long, score double")
    words = rows.where("id % 10 = 1 and id > 20")
    want = sr.passages(scored, pairs(words).drop("tokens"), pairs(rows), ["question", "id"]).collect()
    near = scored.where("question % 3 = id % 3").join(rows, "id").select("question", "id", "place", "tokens")
    heads = lambda df: sr.scope_heads(df, ["third"], good)
    assert heads(rows).count() <= 33
    few = near.unionByName(pairs(heads(words))).unionByName(pairs(heads(rows))).dropDuplicates(["question", "id"])
    assert sorted(sr.passages(scored, pairs(heads(words)).drop("tokens"), few, ["question", "id"]).collect()) == sorted(want)
