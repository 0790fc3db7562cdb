"""Listening statistics, logs and relational upkeep over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import relational as rel
from quire.plans.base import query, table
from quire.plans.upkeep import _checkpoints


def listening_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listening: ``work_id`` from the properties, ``seconds`` from the value."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("work_id", F.get_json_object("props", "$.k").cast("int")).withColumn("day", F.to_date("ts")).withColumnRenamed("value", "seconds")


_EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS work_id, CAST(ts AS DATE) AS day, value AS seconds FROM events)"


@query(f"SELECT CAST(day AS VARCHAR) AS day, round(sum(seconds), 4) AS seconds, count(DISTINCT work_id) AS works FROM {_EV} GROUP BY 1")
def listening_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1: seconds and works a day."""
    return listening_events(spark, sf_dir).groupBy(F.col("day").cast("string").alias("day")).agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.countDistinct("work_id").alias("works"))


@query(f"SELECT CAST(day AS VARCHAR) AS day, round(sum(seconds), 4) AS seconds, count(DISTINCT work_id) AS works FROM {_EV} WHERE day >= DATE '2024-01-30' - 7 GROUP BY 1")
def listening_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 with SCA45: the days from a week before a fixed date."""
    recent = listening_events(spark, sf_dir).where(F.col("day") >= F.date_sub(F.lit("2024-01-30").cast("date"), 7))
    return recent.groupBy(F.col("day").cast("string").alias("day")).agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.countDistinct("work_id").alias("works"))


@query("SELECT coalesce(round(sum(value), 3), 0) AS seconds FROM events")
def total_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2: one total, 0 for no rows."""
    return table(spark, sf_dir, "events").agg(F.coalesce(F.round(F.sum("value"), 3), F.lit(0.0)).alias("seconds"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS long_ones FROM events GROUP BY 1")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: counts and conditional counts a type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("long_ones"))


@query("SELECT DISTINCT event_type AS component FROM events WHERE event_type <> ''")
def log_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL3: distinct components."""
    return table(spark, sf_dir, "events").where("event_type <> ''").select(F.col("event_type").alias("component")).distinct()


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'purchase') AND props ILIKE '%5%' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_filter_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL2: the newest 200 rows of chosen levels with a text in the message since a time."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase") & F.col("props").ilike("%5%") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "user_id")


@query("SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL4: what a day's retention keeps."""
    kept = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    return kept.agg(F.count("*").alias("kept"), F.countDistinct("user_id").alias("users"))


@query(f"SELECT user_id, work_id, event_id, seconds FROM {_EV} QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET9: last position of each user in each work."""
    return rel.first_by(listening_events(spark, sf_dir), ["user_id", "work_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "work_id", "event_id", "seconds")


@query("SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2")
def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows a user."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds")).select("user_id", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "seconds")


@query("""WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS seconds FROM s GROUP BY 1, 2""")
def sessionized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, cut where over half an hour passes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    fresh = F.when(before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    s = table(spark, sf_dir, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"))


@query(f"SELECT user_id, work_id, CAST(day AS VARCHAR) AS day, min(event_id) AS event_id FROM {_EV} GROUP BY user_id, work_id, day")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a user, work and day."""
    e = listening_events(spark, sf_dir).groupBy("user_id", "work_id", "day").agg(F.min("event_id").alias("event_id"))
    return e.withColumn("day", F.col("day").cast("string"))


@query("SELECT 'events' AS kind, count(*) AS n FROM events WHERE user_id = 7 UNION ALL SELECT 'works', count(DISTINCT json_extract_string(props, '$.k')) FROM events WHERE user_id = 7 UNION ALL SELECT 'types', count(DISTINCT event_type) FROM events WHERE user_id = 7")
def user_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27, FIL13: what is stored of one user, in one pass."""
    mine = table(spark, sf_dir, "events").where("user_id = 7")
    n = mine.agg(F.count("*").alias("events"), F.countDistinct(F.get_json_object("props", "$.k")).alias("works"), F.countDistinct("event_type").alias("types"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in n.columns])).alias("x")).select("x.*")


@query("SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM events WHERE user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5: rows left when users chosen by a subquery go with all they own."""
    e = table(spark, sf_dir, "events")
    gone = e.where("event_type = 'purchase' and value > 100").select("user_id").distinct()
    return rel.orphans(e, gone, ["user_id"]).agg(F.count("*").alias("kept"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI2: works no book points at."""
    return rel.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI4: documents without a verdict."""
    return rel.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def empty_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI5: keys without a row in a filtered table."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return rel.orphans(table(spark, sf_dir, "customer"), done, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT count(*) AS links, count(*) FILTER (c.c_nationkey <> s.s_nationkey) AS across FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey")
def cross_ref_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI6, JOI21: links whose two ends belong to different owners."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.agg(F.count("*").alias("links"), F.count_if(F.col("c_nationkey") != F.col("s_nationkey")).alias("across"))


@query("SELECT o_orderkey, count(l_orderkey) AS files, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(sum(l_quantity), 0), 4) AS duration FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def work_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: several counts a work in one grouped join instead of correlated subqueries."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("q"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("o_orderkey", zero("files"), zero("returned"), F.round(F.coalesce("q", F.lit(0.0)), 4).alias("duration"))


@query("""SELECT l_orderkey AS work_id, max(CASE WHEN l_quantity > 0 THEN l_quantity END) AS best,
CASE WHEN bool_or(l_returnflag = 'A') THEN 'aligned' WHEN bool_or(l_returnflag = 'R') THEN 'transcript' ELSE 'text-only' END AS kind, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS provenance FROM lineitem GROUP BY 1""")
def work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9, AGG28: best positive alignment, kind of sources and provenance of each work."""
    flag = lambda v: F.bool_or(F.col("l_returnflag") == v)
    kind = F.when(flag("A"), "aligned").when(flag("R"), "transcript").otherwise("text-only")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work_id")).agg(
        F.max(F.when(F.col("l_quantity") > 0, F.col("l_quantity"))).alias("best"), kind.alias("kind"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("provenance")
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def best_line_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, AGG23: the best row of each group."""
    return rel.first_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 3")
def two_narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31: works whose files come from several places."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n > 3")
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query("SELECT c_custkey, coalesce(nullif(n.c_name, ''), o.c_name) AS c_name FROM customer o FULL JOIN (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(c_name) END AS c_name FROM customer) n USING (c_custkey)")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: a scan's rows over the known ones; empty values do not overwrite."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = old.select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.upper("c_name")).alias("c_name"))
    return rel.upsert(old, new, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 OR c_nationkey % 2 = 1")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: files whose (path, size) is not known yet."""
    found = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    known = found.where("c_custkey % 5 = 0 and c_nationkey % 2 = 0")
    return rel.orphans(found, known, ["c_custkey", "c_nationkey"]).select("c_custkey")


@query("""WITH m AS (SELECT CASE WHEN o_custkey = 1 THEN 2 ELSE o_custkey END AS owner, o_custkey = 1 AS moved, o_orderdate, o_orderkey FROM orders)
SELECT owner, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey FROM m QUALIFY row_number() OVER (PARTITION BY owner, CAST(o_orderdate AS DATE) ORDER BY moved, o_orderkey) = 1""")
def merge_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3: rows of one work go to another; where both have one, the target's stays (the intent of the conflict rule)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").cast("string").alias("day"), "o_orderkey")
    return rel.rekey(o, "owner", F.lit(1), F.lit(2), ["owner", "day"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 AND o_orderpriority LIKE '1%' THEN -o_custkey ELSE o_custkey END AS owner FROM orders")
def split_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: chosen rows of a work move to a new one."""
    moves = (F.col("o_custkey") % 10 == 0) & F.col("o_orderpriority").like("1%")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(moves, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("owner"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name FROM nation")
def replace_for_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET6: rows of the keys that come anew replace the old ones."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    fresh = n.where("n_regionkey = 1").withColumn("n_name", F.upper("n_name"))
    return rel.replace_keys(n, fresh, "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT DISTINCT l_orderkey AS work_id FROM lineitem WHERE l_linestatus = 'O'")
def works_with_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET7: distinct works with a row of a kind."""
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("work_id")).distinct()


@query("SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def changed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET8: keys whose version changed since the last look."""
    now = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v"))
    before = now.withColumn("v", F.when(F.col("v") % 7 == 3, F.col("v") + 1).otherwise(F.col("v")))
    return rel.changed(now, before, "p_partkey", "v").select("p_partkey")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, 100 + n_regionkey AS b FROM nation), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, hops) AS (SELECT 0, 0 UNION SELECT b, hops + 1 FROM r JOIN both_ways ON node = a WHERE hops < 2) SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def alignment_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN13: fewest hops from one book over the links between books."""
    _checkpoints(spark)
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))
    return rel.reachable(edges, spark.range(1).select(F.col("id").cast("int").alias("node")), 2)
