"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import vector as vec
from quire.operators import relational as rel
from quire.operators.nearest import nearest
from quire.plans.base import query, table

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("SELECT count(*) AS total, count(embedding) AS embedded, round(100.0::DOUBLE * count(embedding) / count(*), 4) AS percent FROM embeddings")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: share of rows with a vector, 0 for no rows."""
    e = embeddings(spark, sf_dir).agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    return e.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("embedded"), F.col("total")), F.lit(0.0)), 4))


@query("SELECT CAST(len(embedding) AS INT) AS dimensions, CASE WHEN len(embedding) = 1536 THEN 'text-1536' WHEN len(embedding) = 768 THEN 'text-768' ELSE 'unknown' END AS model, count(*) AS n FROM embeddings GROUP BY 1, 2")
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: vector lengths and the family they tell."""
    d = F.size("embedding")
    return embeddings(spark, sf_dir).groupBy(d.alias("dimensions"), vec.model_of(d).alias("model")).agg(F.count("*").alias("n"))


@query(f"SELECT b.vec_id, round({_COS}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY {_COS} DESC, b.vec_id LIMIT 24")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2, RET3: the 24 rows nearest one question's vector, kept by a bounded heap a task."""
    e = embeddings(spark, sf_dir)
    asked = F.broadcast(e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1))
    scored = e.where("vec_id <> 7").join(asked).select("vec_id", vec.cosine(F.col("embedding"), F.col("q")).alias("raw"))
    return scored.orderBy(F.desc("raw"), "vec_id").limit(24).select("vec_id", F.round("raw", 9).alias("score"))


@query(f"SELECT a.vec_id, max_by(b.vec_id, ({_COS}, b.vec_id)) AS best, round(max({_COS}), 9) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.2 GROUP BY 1")
def embedding_by_label_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI10: the nearest row of the same label for a stated set of questions, the last of equals, if near enough."""
    e = embeddings(spark, sf_dir).withColumn("size", F.size("embedding"))
    asked = e.where("vec_id % 20 = 0").select("label", "size", F.col("vec_id").alias("asked"), F.col("embedding").alias("q"))
    rows = e.select("label", "size", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # A question is among the rows, so it can take one of two places; the other is the nearest of the rest.
    found = nearest(asked, rows, ["label", "size"], 2, "cosine", least=0.2, last=True).where("id <> asked")
    return rel.first_by(found, ["asked"], F.asc("rank")).select(F.col("asked").alias("vec_id"), F.col("id").alias("best"), F.round("score", 9).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS size FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA34: length of each vector."""
    return embeddings(spark, sf_dir).select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("size"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by label."""
    return embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY CAST(embedding[1] AS DOUBLE) DESC, vec_id) AS INT) AS rank FROM embeddings QUALIFY rank <= 3")
def top_by_first_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN21: ranks within groups."""
    return rel.top_by(embeddings(spark, sf_dir), ["label"], 3, F.desc(F.get("embedding", 0)), F.asc("vec_id")).select("label", "vec_id", "rank")
