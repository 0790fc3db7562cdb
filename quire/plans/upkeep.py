"""Upkeep of a library: splits, merges, lookups, audits and verdicts of whole works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import chapters, ngrams
from quire.operators import relational as rel
from quire.plans.base import query, shared_folder, table
from quire.plans.timelines import _W, words


def _checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_linenumber + 1 ELSE l_linenumber END AS idx FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3 FROM lineitem WHERE l_linenumber = 2")
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH2: the second chapter becomes two; later ones move up."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    moved = li.withColumn("idx", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")))
    return moved.unionByName(li.where("l_linenumber = 2").withColumn("idx", F.lit(3)))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25")
def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH6: the newest 25 rows of each user."""
    return rel.top_by(table(spark, sf_dir, "events"), ["user_id"], 25, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 5)")
def cascade_delete_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH7: rows left when those tied to deleted keys of two tables go."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    edges = table(spark, sf_dir, "lineitem").where("l_suppkey = 5")
    o = rel.orphans(table(spark, sf_dir, "orders"), gone, F.col("o_custkey") == F.col("c_custkey"))
    return rel.orphans(o, edges, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'New ' || s_name ELSE s_name END AS s_name FROM supplier")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH9: blanks do not overwrite."""
    new = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("New "), "s_name")).otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.nullif(new, F.lit("")), F.col("s_name")).alias("s_name"))


@query("SELECT o_orderkey, count(l_orderkey) AS files, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS listing FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def nested_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH10: a work with its files nested in order."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("files"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listing = F.array_join(F.transform("files", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",")
    return j.select("o_orderkey", F.when(F.col("files").isNull(), 0).otherwise(F.size("files")).cast("long").alias("files"), F.coalesce(listing, F.lit("")).alias("listing"))


@query(f"""SELECT t.doc_id, c.line_idx, round(t.at_sec - c.a, 3) AS offset_sec FROM (SELECT doc_id, 20.0::DOUBLE AS at_sec FROM documents) t ASOF JOIN (SELECT doc_id, line_idx, min(s) AS a FROM {_W} GROUP BY 1, 2) c ON t.doc_id = c.doc_id AND t.at_sec >= c.a""")
def chapter_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH27, OTH28: chapter, and time within it, at twenty seconds into each work."""
    starts = words(spark, sf_dir).groupBy("doc_id", "line_idx").agg(F.min("s").alias("a"))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.lit(20.0).alias("at"))
    found = rel.as_of(asked, starts, ["doc_id"], "at", "a", ["line_idx", "a"]).where("line_idx is not null")
    return found.select("doc_id", "line_idx", F.round(F.col("at") - F.col("a"), 3).alias("offset_sec"))


@query("""SELECT source, min_by(doc_id, (CASE WHEN doc_id % 3 = 0 AND n_chars > 500 THEN 0 WHEN doc_id % 3 = 0 THEN 1 WHEN n_chars > 500 THEN 2 ELSE 3 END, doc_id)) AS doc_id FROM documents GROUP BY 1""")
def best_metadata_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH15, RET13: the file whose metadata is trusted, by a ladder of preferences."""
    epub, author = F.col("doc_id") % 3 == 0, F.col("n_chars") > 500
    rank = F.when(epub & author, 0).when(epub, 1).when(author, 2).otherwise(3)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(rank.alias("r"), "doc_id")).alias("doc_id"))


@query("SELECT a.doc_id, a.words AS mine, b.words AS other, abs(a.words - b.words) <= greatest(0.05 * b.words, 1) AS safe FROM (SELECT doc_id, count(*) AS words FROM " + _W + " GROUP BY 1) a JOIN (SELECT doc_id + 1 AS doc_id, count(*) AS words FROM " + _W + " GROUP BY 1) b USING (doc_id)")
def karaoke_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ12: whether two word counts are near enough to read along."""
    n = words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("words"))
    j = n.select("doc_id", F.col("words").alias("mine")).join(n.select((F.col("doc_id") + 1).alias("doc_id"), F.col("words").alias("other")), "doc_id")
    return j.withColumn("safe", F.abs(F.col("mine") - F.col("other")) <= F.greatest(0.05 * F.col("other"), F.lit(1)))


@query("""SELECT source, count(*) AS known, count(*) FILTER (doc_id % 7 = 0 OR (source = 'src3' AND doc_id % 2 = 0)) AS missing,
CASE WHEN count(*) FILTER (doc_id % 7 = 0 OR (source = 'src3' AND doc_id % 2 = 0)) > 10 AND count(*) FILTER (doc_id % 7 = 0 OR (source = 'src3' AND doc_id % 2 = 0)) >= 0.4 * count(*) THEN 'stale' ELSE 'delete' END AS action FROM documents GROUP BY 1""")
def root_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ9: a root that misses many files at once is taken to be out of reach, not emptied."""
    d = table(spark, sf_dir, "documents")
    there = d.where("not (doc_id % 7 = 0 or (source = 'src3' and doc_id % 2 = 0))").select("doc_id", F.lit(True).alias("there"))
    j = d.join(there, "doc_id", "left").groupBy("source").agg(F.count("*").alias("known"), F.count_if(F.col("there").isNull()).alias("missing"))
    return j.withColumn("action", F.when((F.col("missing") > 10) & (F.col("missing") >= 0.4 * F.col("known")), "stale").otherwise("delete"))


@query(f"""SELECT doc_id, round(median(d), 6) AS typical, count(*) FILTER (d <= 6) AS matched, count(*) AS asked FROM (
SELECT a.doc_id, a.pos, min(abs(a.s - b.s)) AS d FROM (SELECT * FROM {_W} WHERE pos % 25 = 0) a JOIN (SELECT doc_id, pos, s + ((pos % 3) - 1) * 0.5::DOUBLE AS s, w FROM {_W}) b ON a.doc_id = b.doc_id AND lower(a.w) = lower(b.w) AND abs(a.s - b.s) <= 6 GROUP BY 1, 2) GROUP BY 1""")
def timing_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ11: how near each probed word lies to the same word of another timeline within six seconds; words meet in buckets."""
    w = words(spark, sf_dir).withColumn("k", F.lower("w"))
    probe = w.where("pos % 25 = 0").select("doc_id", "pos", "k", F.col("s").alias("at")).withColumn("b", F.explode(F.expr("array(floor(at / 6) - 1, floor(at / 6), floor(at / 6) + 1)")))
    other = w.withColumn("t", F.col("s") + (F.col("pos") % 3 - 1) * 0.5).select("doc_id", "k", "t", F.floor(F.col("t") / 6).alias("b"))
    d = probe.join(other, ["doc_id", "k", "b"]).withColumn("d", F.abs(F.col("at") - F.col("t"))).where("d <= 6").groupBy("doc_id", "pos").agg(F.min("d").alias("d"))
    return d.groupBy("doc_id").agg(F.round(F.median("d"), 6).alias("typical"), F.count_if(F.col("d") <= 6).alias("matched"), F.count("*").alias("asked"))


@query()
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI8, JOI20: items and documents one to one by shared anchors; a greedy rule has no SQL form."""
    _checkpoints(spark)
    n = ngrams.anchors(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return chapters.greedy_pairs(n, "item_id", "doc_id", "shared")


@query()
def spoken_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG6, WIN19: chapters announced in stated transcripts; the run of numbers is found by dynamic programming."""
    w = words(spark, sf_dir)
    spoken = F.when(F.col("pos") % 40 == 10, F.lit("chapter")).when(F.col("pos") % 40 == 11, ((F.col("pos") / 40).cast("int") + 1).cast("string")).otherwise(F.col("w"))
    said = w.withColumn("w", spoken)
    quiet = said.where("pos % 40 = 10 and pos % 80 <> 10").select("doc_id", F.col("s").alias("end_sec"), F.lit(2.5).alias("duration"))
    return chapters.detected(chapters.announcements(said, quiet))


@query()
def chapter_word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG11, SEG13: words in each spoken chapter."""
    found = spoken_chapters(spark, sf_dir)
    w = words(spark, sf_dir).select("doc_id", "pos", "s")
    return chapters.word_ranges(w, found).groupBy("doc_id", "number").agg(F.count("*").alias("words"), F.min("pos").alias("first_pos"))


_HIT = f"(SELECT DISTINCT doc_id, chunk, w FROM (SELECT doc_id, CAST(floor(pos / 160) AS INT) AS chunk, lower(w) AS w FROM {_W}) WHERE w IN ('tion', 'the', 'with', 'de', 'und'))"


@query(f"SELECT doc_id, chunk, count(*) AS words FROM {_HIT} GROUP BY 1, 2")
def passages_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET6: passages that hold any of a question's words, each once, with how many."""
    w = words(spark, sf_dir).select("doc_id", F.floor(F.col("pos") / 160).cast("int").alias("chunk"), F.lower("w").alias("w"))
    return w.where(F.col("w").isin("tion", "the", "with", "de", "und")).distinct().groupBy("doc_id", "chunk").agg(F.count("*").alias("words"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, min(turn) AS first_turn FROM conversations GROUP BY 1")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH11: messages by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.min("turn").alias("first_turn"))


@query("SELECT event_id, prev || '>' || event_type AS step FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE (prev, event_type) IN (('view', 'click'), ('click', 'purchase'))")
def valid_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH32: steps that a state machine allows."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("prev", prev)
    ok = F.concat_ws(">", "prev", "event_type").isin("view>click", "click>purchase")
    return e.where(F.col("prev").isNotNull() & ok).select("event_id", F.concat("prev", F.lit(">"), "event_type").alias("step"))


@query("SELECT doc_id FROM documents WHERE array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:2], ' ') = 'The and'")
def title_opens_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH23: texts that open with given words."""
    return table(spark, sf_dir, "documents").where(F.array_join(F.slice(tx.fields("text"), 1, 2), " ") == "The and").select("doc_id")
