"""Time-series queries over the stated word timeline of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import relational as rel
from quire.operators import timeline as tl
from quire.plans.base import query, table

_W = """(SELECT doc_id, pos, line_idx, s, round(s + 0.3, 3) AS e, w, ((pos * 37 + doc_id * 11) % 100) / 100.0::DOUBLE AS conf FROM (
SELECT *, round(pos * 0.4::DOUBLE + line_idx * 3.0::DOUBLE, 3) AS s FROM (SELECT doc_id, CAST(line_idx AS INT) AS line_idx, w, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, k) - 1 AS INT) AS pos FROM (
SELECT doc_id, line_idx, ws[k] AS w, k FROM (SELECT doc_id, line_idx, ws, unnest(range(1, len(ws) + 1)) AS k FROM (
SELECT doc_id, i - 1 AS line_idx, list_filter(regexp_split_to_array(l[i], '\\s+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))))))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.synthetic(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, count(*) AS words, round(max(e), 3) AS duration, CAST(sum(round(conf * 100)) AS BIGINT) AS conf FROM {_W} GROUP BY 1")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and summed confidence (in hundredths) of each timeline."""
    return words(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("words"), F.round(F.max("e"), 3).alias("duration"), F.sum(F.round(F.col("conf") * 100).cast("long")).alias("conf"))


@query(f"SELECT doc_id, pos, gap FROM (SELECT doc_id, pos, round(lead(s) OVER (PARTITION BY doc_id ORDER BY pos) - e, 3) AS gap FROM {_W}) WHERE gap >= 3")
def chapter_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: silences of three seconds or more."""
    return tl.pauses(words(spark, sf_dir), 3.0).select("doc_id", "pos", "gap")


@query(f"""SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN gap >= 3.0 THEN 'chapter' WHEN gap >= 0.6 THEN 'paragraph' WHEN gap >= 0.3 THEN 'sentence' ELSE 'breath' END AS kind
FROM (SELECT doc_id, round(lead(s) OVER (PARTITION BY doc_id ORDER BY pos) - e, 3) AS gap FROM {_W}) WHERE gap >= 0) GROUP BY 1, 2""")
def silence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA38: silences by kind."""
    return tl.pauses(words(spark, sf_dir), 0.0).groupBy("doc_id", tl.silence_kind(F.col("gap")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS words, min(pos) AS first_pos FROM (SELECT doc_id, pos, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS paragraph FROM (
SELECT doc_id, pos, CASE WHEN s - lag(e) OVER w >= 0.6 AND regexp_matches(lag(w) OVER w, '[.!?]["'')”’]*$') THEN 1 ELSE 0 END AS cut FROM {_W} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) GROUP BY 1, 2""")
def timeline_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, SEG9: paragraphs from pauses at sentence ends."""
    return tl.paragraph_ids(words(spark, sf_dir)).groupBy("doc_id", "paragraph").agg(F.count("*").alias("words"), F.min("pos").alias("first_pos"))


_B = f"(SELECT doc_id, b AS bucket, count(s) AS n FROM (SELECT doc_id, unnest(range(0, last + 1)) AS b FROM (SELECT doc_id, CAST(floor(max(s) / 60) AS BIGINT) AS last FROM {_W} GROUP BY 1)) LEFT JOIN (SELECT doc_id AS d, CAST(floor(s / 60) AS BIGINT) AS sb, s FROM {_W}) ON d = doc_id AND sb = b GROUP BY 1, 2)"


@query(f"SELECT doc_id, bucket, n FROM {_B}")
def minute_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: words a minute, empty minutes included."""
    return tl.buckets(words(spark, sf_dir))


_DUR = f"(SELECT doc_id, max(e) + 20 AS duration FROM {_W} GROUP BY 1)"
#: Stated silences: before every 400th word two seconds, and 55 seconds of the third minute of every fifth text.
_SIL = f"(SELECT doc_id, s - 2 AS a, s AS b FROM {_W} WHERE pos % 400 = 200 UNION ALL SELECT doc_id, 122.0::DOUBLE, 177.0::DOUBLE FROM documents WHERE doc_id % 5 = 0)"
#: The stated timeline with holes: no words from 100 to 260 seconds in every second text, and from 300 to 340 in the others.
_HOLED = f"(SELECT * FROM {_W} WHERE NOT (CASE WHEN doc_id % 2 = 0 THEN s >= 100 AND s < 260 ELSE s >= 300 AND s < 340 END))"
_QUIET = f"(SELECT doc_id, bucket, sum(least(b, 60.0 * (bucket + 1)) - greatest(a, 60.0 * bucket)) AS quiet FROM (SELECT *, unnest(range(CAST(floor(a / 60) AS BIGINT), CAST(floor(b / 60) AS BIGINT) + 1)) AS bucket FROM {_SIL}) WHERE least(b, 60.0 * (bucket + 1)) > greatest(a, 60.0 * bucket) GROUP BY 1, 2)"
_GAPS = f"""(SELECT doc_id, start_sec, end_sec, words FROM (SELECT doc_id, min(bucket) * 60.0::DOUBLE AS start_sec, least((max(bucket) + 1) * 60.0::DOUBLE, any_value(duration)) AS end_sec, CAST(sum(n) AS BIGINT) AS words FROM (
SELECT *, bucket - row_number() OVER (PARTITION BY doc_id ORDER BY bucket) AS island FROM (SELECT b.doc_id, b.bucket, b.n, b.duration, coalesce(q.quiet, 0) AS quiet FROM (
SELECT doc_id, bucket, duration, count(s) AS n FROM (SELECT doc_id, duration, unnest(range(0, CAST(ceil(duration / 60) AS BIGINT))) AS bucket FROM {_DUR}) LEFT JOIN (SELECT doc_id AS d, CAST(floor(s / 60) AS BIGINT) AS sb, s FROM {_HOLED}) ON d = doc_id AND sb = bucket GROUP BY 1, 2, 3) b LEFT JOIN {_QUIET} q USING (doc_id, bucket)) WHERE quiet <= 45 AND n < 10) GROUP BY doc_id, island) WHERE end_sec - start_sec >= 30)"""


def stated_track(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words with holes, silences (doc_id, a, b) and durations (doc_id, duration)."""
    w = words(spark, sf_dir)
    hole = F.when(F.col("doc_id") % 2 == 0, (F.col("s") >= 100) & (F.col("s") < 260)).otherwise((F.col("s") >= 300) & (F.col("s") < 340))
    quiet = w.where("pos % 400 = 200").select("doc_id", (F.col("s") - 2).alias("a"), F.col("s").alias("b"))
    quiet = quiet.unionByName(table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(122.0).alias("a"), F.lit(177.0).alias("b")))
    return w.where(~hole), quiet, w.groupBy("doc_id").agg((F.max("e") + 20).alias("duration"))


@query(f"SELECT doc_id, start_sec, round(end_sec, 3) AS end_sec, words FROM {_GAPS}")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, AGG16: stretches of minutes with under ten words that are not mostly silence, cut at the duration, thirty seconds or more."""
    g = tl.transcription_gaps(*stated_track(spark, sf_dir))
    return g.select("doc_id", "start_sec", F.round("end_sec", 3).alias("end_sec"), "words")


_HOLES = f"""(SELECT doc_id, a AS start_sec, b AS end_sec FROM (SELECT h.doc_id, h.a, h.b, d.duration, coalesce(sum(least(s.b, h.b) - greatest(s.a, h.a)) FILTER (s.a IS NOT NULL AND least(s.b, h.b) > greatest(s.a, h.a)), 0) AS cover FROM (
SELECT doc_id, a, b FROM (SELECT doc_id, s AS b, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_HOLED} UNION ALL
SELECT doc_id, duration AS b, last_end AS a FROM {_DUR} JOIN (SELECT doc_id, max(e) AS last_end FROM {_HOLED} GROUP BY 1) USING (doc_id)) WHERE b - a >= 30) h JOIN {_DUR} d USING (doc_id) LEFT JOIN {_SIL} s ON s.doc_id = h.doc_id AND s.a < h.b AND s.b > h.a GROUP BY 1, 2, 3, 4)
WHERE cover / (b - a) < 0.75 AND NOT ((a < 45 OR b > duration - 45) AND b - a <= 90) AND duration > 30)"""


@query(f"SELECT doc_id, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec FROM {_HOLES}")
def timeline_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: stretches of thirty seconds without a word that silence does not explain; short ones at either edge are passed over."""
    return tl.wordless_holes(*stated_track(spark, sf_dir)).select("doc_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


@query(f"""SELECT doc_id, kind, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, words FROM (SELECT doc_id, 'gap' AS kind, start_sec, end_sec, words FROM {_GAPS} UNION ALL
SELECT doc_id, 'hole', start_sec, end_sec, 0 FROM {_HOLES} h WHERE NOT EXISTS (SELECT 1 FROM {_GAPS} g WHERE g.doc_id = h.doc_id AND h.start_sec < g.end_sec AND h.end_sec > g.start_sec))""")
def missing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5, DQ7: gaps, and the holes that no gap covers."""
    track = stated_track(spark, sf_dir)
    m = tl.merged_spans(tl.transcription_gaps(*track), tl.wordless_holes(*track))
    return m.select("doc_id", "kind", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "words")


_RUNS = f"(SELECT doc_id, count(*) AS n, min(pos) AS first_pos, min(s) AS start_sec, max(e) AS end_sec, string_agg(w, ' ' ORDER BY pos) AS text FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_W} WHERE conf < 0.5) GROUP BY doc_id, island)"


@query(f"SELECT doc_id, n, first_pos, start_sec, end_sec FROM {_RUNS} WHERE n >= 2")
def low_conf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: runs of doubtful words (two or more, to suit the table)."""
    return tl.doubtful_runs(words(spark, sf_dir), least=2).drop("text")


@query(f"SELECT doc_id, n, first_pos, left(text, 400) AS text FROM {_RUNS} WHERE n >= 2 ORDER BY n DESC, doc_id, first_pos LIMIT 50")
def low_conf_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: the fifty longest doubtful passages."""
    runs = tl.doubtful_runs(words(spark, sf_dir), least=2).orderBy(F.desc("n"), "doc_id", "first_pos").limit(50)
    return runs.select("doc_id", "n", "first_pos", F.left("text", F.lit(400)).alias("text"))


@query(f"SELECT doc_id, max(n) AS peak, arg_max(s, (n, -s)) AS at_sec FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id ORDER BY CAST(round(s * 1000) AS BIGINT) RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n FROM {_W}) GROUP BY 1")
def peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: fastest minute of each timeline."""
    return tl.peak_rate(words(spark, sf_dir))


_JUMP = f"(SELECT doc_id, pos, CASE WHEN pos % 50 = 17 THEN s - 9 ELSE s END AS s FROM {_W})"


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {_JUMP}) WHERE s < high - 0.5 GROUP BY 1")
def backward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: words out of order, on a timeline with some set back."""
    w = words(spark, sf_dir).withColumn("s", F.when(F.col("pos") % 50 == 17, F.col("s") - 9).otherwise(F.col("s")))
    return tl.backward_steps(w).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, pos, round(CASE WHEN p0 = p1 THEN s0 ELSE coalesce(s0 + (s1 - s0) * ((pos - p0) / (p1 - p0)), s0, s1) END, 3) AS filled FROM (SELECT doc_id, pos,
last_value(CASE WHEN pos % 7 = 0 THEN pos END IGNORE NULLS) OVER b AS p0, last_value(CASE WHEN pos % 7 = 0 THEN s END IGNORE NULLS) OVER b AS s0, first_value(CASE WHEN pos % 7 = 0 THEN pos END IGNORE NULLS) OVER a AS p1, first_value(CASE WHEN pos % 7 = 0 THEN s END IGNORE NULLS) OVER a AS s1
FROM {_W} WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def monotone_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13, WIN15: times between known words."""
    return tl.filled_times(words(spark, sf_dir), F.col("pos") % 7 == 0).select("doc_id", "pos", "filled")


@query(f"SELECT doc_id, pos, CASE WHEN nxt > s THEN nxt ELSE round(s + 0.3, 3) END AS e FROM (SELECT doc_id, pos, s, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {_W})")
def end_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: a word ends where the next starts."""
    nxt = F.lead("s").over(tl.by(["doc_id"]))
    return words(spark, sf_dir).withColumn("nxt", nxt).select("doc_id", "pos", F.when(F.col("nxt") > F.col("s"), F.col("nxt")).otherwise(F.round(F.col("s") + 0.3, 3)).alias("e"))


@query(f"SELECT doc_id, start, count(*) AS n FROM (SELECT doc_id, floor(s / 5) * 5 AS start FROM {_W}) GROUP BY 1, 2 HAVING count(*) > 6")
def instant_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17: starts that many words share (starts cut to five seconds, to suit the table)."""
    w = words(spark, sf_dir).withColumn("start", F.floor(F.col("s") / 5).cast("double") * 5)
    return w.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where("n > 6")


_SRC = "(SELECT doc_id, source, n_chars / 100.0::DOUBLE AS duration FROM documents)"


@query(f"SELECT doc_id, source, round(coalesce(sum(duration) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_sec FROM {_SRC}")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: start of each file on its work's clock."""
    d = table(spark, sf_dir, "documents").withColumn("duration", F.col("n_chars") / 100.0)
    return d.select("doc_id", "source", F.round(tl.offsets(d, ["source"], "doc_id", "duration"), 4).alias("start_sec"))


_FILES = "(SELECT l_orderkey AS work, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS n, l_quantity AS duration, l_partkey % 11 = 0 AS shifted FROM lineitem)"
_PLACED = f"(SELECT work, n, duration, round(coalesce(sum(duration) OVER (PARTITION BY work ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN shifted THEN 5 ELSE 0 END, 3) AS start_sec FROM {_FILES})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the files of a work one after the other, some of which start five seconds late: work, n, duration, start_sec."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.row_number().over(w).alias("n"), F.col("l_quantity").alias("duration"), (F.col("l_partkey") % 11 == 0).alias("shifted"))
    return f.withColumn("start_sec", F.round(tl.offsets(f, ["work"], "n", "duration") + F.when(F.col("shifted"), 5).otherwise(0), 3)).drop("shifted")


@query(f"""SELECT work, min(n) AS n, min_by(off, n) AS off FROM (SELECT work, n, round(start_sec - lag(start_sec + duration) OVER (PARTITION BY work ORDER BY n), 3) AS off FROM {_PLACED}) WHERE abs(off) > 1 GROUP BY 1""")
def source_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: the first file of each work that does not start where the one before it ends, and by how much."""
    return tl.discontinuities(files(spark, sf_dir), ["work"], "n")


@query("""SELECT e.event_id, c.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI14, JOI16: the last view at or before each purchase."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("last_view"))
    return rel.as_of(e.where("event_type = 'purchase'"), views, ["user_id"], "ts", "view_ts", ["last_view"]).select("event_id", "last_view")


@query("""SELECT e.event_id, c.event_id AS next_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.ts <= c.ts""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI15: the first view at or after each purchase."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("next_view"))
    return rel.as_of(e.where("event_type = 'purchase'"), views, ["user_id"], "ts", "view_ts", ["next_view"], forward=True).select("event_id", "next_view")


_CH = f"(SELECT doc_id, line_idx, min(s) AS a, max(e) AS b FROM {_W} GROUP BY 1, 2)"


@query(f"SELECT w.doc_id, c.line_idx, count(*) AS doubtful FROM {_W} w JOIN {_CH} c ON w.doc_id = c.doc_id AND w.s >= c.a AND w.s < c.b WHERE w.conf < 0.2 GROUP BY 1, 2")
def doubtful_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI13, JOI17, AGG26: doubtful words by the chapter whose time span holds them."""
    w = words(spark, sf_dir)
    chapters = w.groupBy("doc_id", "line_idx").agg(F.min("s").alias("a"), F.max("e").alias("b"))
    points = w.where("conf < 0.2").select("doc_id", "s")
    return rel.interval_join(points, chapters, ["doc_id"], "s", "a", "b", 60.0).groupBy("doc_id", "line_idx").agg(F.count("*").alias("doubtful"))


@query(f"SELECT doc_id, pos, greatest(max(s) OVER (PARTITION BY doc_id ORDER BY pos), s) AS s FROM {_JUMP}")
def monotone_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN17: times that never step back."""
    w = words(spark, sf_dir).withColumn("s", F.when(F.col("pos") % 50 == 17, F.col("s") - 9).otherwise(F.col("s")))
    return w.select("doc_id", "pos", F.max("s").over(tl.by(["doc_id"])).alias("s"))


@query(f"SELECT doc_id, pos, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 4 FOLLOWING) AS shown FROM {_W}")
def highlight_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN22: the words shown around the one that is read."""
    frame = tl.by(["doc_id"]).rowsBetween(-1, 4)
    return words(spark, sf_dir).withColumn("shown", F.array_join(F.collect_list("w").over(frame), " ")).select("doc_id", "pos", "shown")


@query(f"SELECT doc_id, count(*) AS n FROM {_W} WHERE e > 10 AND s < 30 GROUP BY 1")
def time_window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL12: words that overlap a span of time."""
    return words(spark, sf_dir).where("e > 10 and s < 30").groupBy("doc_id").agg(F.count("*").alias("n"))
