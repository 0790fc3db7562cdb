"""Quality verdicts and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.plans.base import query, table


def trust_state(words: Column, doubtful: Column) -> Column:
    """State of a transcript by its share of doubtful words in percent (SCA31): three percent or more is significant."""
    share = F.try_divide(100.0 * doubtful, words)
    return F.when(words.isNull() | (words == 0), "unchecked").when(doubtful == 0, "verified").when(share >= 3.0, "significant").otherwise("minor")


def off_by(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two amounts differ by more than a share of the second; false where that is not positive (SCA37)."""
    return F.coalesce((b > 0) & (F.try_divide(F.abs(a - b), b) > tolerance), F.lit(False))


_D = "(SELECT doc_id, source, lang, n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, text FROM documents)"


@query(f"SELECT doc_id, CASE WHEN words = 0 THEN 'unchecked' WHEN bad = 0 THEN 'verified' WHEN 100.0 * bad / words >= 3.0 THEN 'significant' ELSE 'minor' END AS state FROM (SELECT doc_id, words, doc_id % 40 AS bad FROM {_D})")
def trust_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA31: trust in each text, for a stated number of doubtful words."""
    return table(spark, sf_dir, "documents").select("doc_id", trust_state(tx.word_count("text"), F.col("doc_id") % 40).alias("state"))


@query(f"SELECT d.doc_id, abs(d.words - o.words) / o.words > 0.05 AS drifted FROM {_D} d JOIN (SELECT doc_id + 1 AS doc_id, words FROM {_D}) o USING (doc_id) WHERE o.words > 0")
def length_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA37, DQ: texts whose length is off from the one before by over a twentieth."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.word_count("text").alias("words"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("words").alias("was")).where("was > 0")
    return d.join(before, "doc_id").select("doc_id", off_by(F.col("words"), F.col("was"), 0.05).alias("drifted"))


@query(f"""SELECT source, count(*) AS docs, count(*) FILTER (words < 50) AS thin, count(*) FILTER (n_chars <> length(text)) AS miscounted, count(DISTINCT lang) AS langs,
CASE WHEN count(*) FILTER (n_chars <> length(text)) > 0 THEN 2 WHEN count(*) FILTER (words < 50) * 10 > count(*) THEN 1 ELSE 0 END AS rank FROM {_D} GROUP BY 1""")
def coherence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ1, TOP4: issues of each work and its rank, worst first."""
    d = table(spark, sf_dir, "documents").withColumn("words", tx.word_count("text"))
    bad, thin = F.count_if(F.col("n_chars") != F.length("text")), F.count_if(F.col("words") < 50)
    return d.groupBy("source").agg(F.count("*").alias("docs"), thin.alias("thin"), bad.alias("miscounted"), F.countDistinct("lang").alias("langs"), F.when(bad > 0, 2).when(thin * 10 > F.count("*"), 1).otherwise(0).alias("rank"))


@query("SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def labels_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: documents by verdict."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ: texts that occur again."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, regexp_matches(text, '(?i)licen[cs]ed? under|all rights reserved|project gutenberg') AS licensed FROM documents")
def licence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ8: texts with licence wording."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("(?i)licen[cs]ed? under|all rights reserved|project gutenberg").alias("licensed"))


@query(f"SELECT source, doc_id, words, CAST(row_number() OVER (PARTITION BY source ORDER BY words DESC, doc_id) AS INT) AS rank FROM {_D} WHERE words >= 150 QUALIFY rank <= 12")
def largest_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP5: the twelve largest chapters a work that a sync check looks at."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", tx.word_count("text").alias("words")).where("words >= 150")
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("words"), "doc_id"))
    return d.withColumn("rank", r).where("rank <= 12")


def timing_tier(verified: Column, generated: Column, has_text: Column, aligned: Column) -> Column:
    """How far the word times of a narration can be trusted (SCA32); empty where they were not verified."""
    return F.when(~F.coalesce(verified, F.lit(False)), "").when(generated, "verified_construction").when(has_text & aligned, "timing_text_verified").otherwise("timing_self_consistent")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL OR passed < n THEN '' WHEN o_orderpriority LIKE '1%' THEN 'verified_construction' WHEN has_text AND aligned THEN 'timing_text_verified' ELSE 'timing_self_consistent' END AS tier FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity < 45) AS passed, bool_or(l_returnflag = 'N') AS has_text, bool_or(l_linestatus = 'O') AS aligned FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def timing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA32: tier of each work by its probe windows, origin and texts."""
    is_ = lambda c, v: F.bool_or(F.col(c) == v)
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") < 45).alias("passed"), is_("l_returnflag", "N").alias("has_text"), is_("l_linestatus", "O").alias("aligned"))
    j = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", timing_tier(F.col("passed") >= F.col("n"), F.col("o_orderpriority").like("1%"), F.col("has_text"), F.col("aligned")).alias("tier"))
