"""Queries over chapters of transcripts, on the stated timeline and its stated silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import transcripts as tr
from quire.plans.base import query, table
from quire.plans.timelines import _PLACED, _W, words
from quire.plans.timelines import files as placed_files

#: Stated silences: four seconds before every 150th word, one second before every 40th.
_Q = f"(SELECT doc_id, s - 4 AS a, s AS b FROM {_W} WHERE pos % 150 = 100 UNION ALL SELECT doc_id, s - 1, s FROM {_W} WHERE pos % 40 = 20)"


def quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of silence in one pass over the words."""
    cut = lambda cond, n: F.when(F.expr(cond), F.struct((F.col("s") - n).alias("a"), F.col("s").alias("b")))
    both = F.array_compact(F.array(cut("pos % 150 = 100", 4), cut("pos % 40 = 20", 1)))
    return words(spark, sf_dir).where("pos % 150 = 100 or pos % 40 = 20").select("doc_id", F.inline(both))


_SIL_CH = f"(SELECT doc_id, pos, start_sec, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS number FROM (SELECT doc_id, min(pos) AS pos, 0.0::DOUBLE AS start_sec FROM {_W} GROUP BY 1 UNION ALL SELECT doc_id, pos, s FROM {_W} WHERE pos % 150 = 100))"


@query(f"SELECT * FROM {_SIL_CH}")
def silence_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG8: chapters at long silences."""
    return tr.silence_chapters(words(spark, sf_dir), quiet(spark, sf_dir))


@query(f"""WITH p AS (SELECT doc_id, pos, s AS start_sec, CAST(pos // 300 + 1 AS INT) AS number FROM (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {_W}) WHERE pos % 300 = 100 AND nxt IS NOT NULL),
b AS (SELECT *, 'part' AS src FROM p UNION ALL SELECT *, 'chapter' FROM {_SIL_CH}) SELECT doc_id, pos, round(start_sec, 3) AS start_sec, number, src FROM (SELECT *, lag(src) OVER w AS ps, lag(start_sec) OVER w AS pt FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY start_sec, src DESC)) WHERE NOT (src = 'chapter' AND coalesce(ps, '') = 'part' AND start_sec - pt < 5)""")
def parts_and_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG8: spoken parts near long silences, merged with the chapters."""
    w, q = words(spark, sf_dir), quiet(spark, sf_dir)
    spoken = F.when(F.col("pos") % 300 == 100, "Part").when(F.col("pos") % 300 == 101, (F.floor(F.col("pos") / 300) + 1).cast("string")).otherwise(F.lit("so"))
    parts = tr.silence_parts(w.withColumn("w", spoken), q)
    return tr.with_parts(tr.silence_chapters(w, q), parts).withColumn("start_sec", F.round("start_sec", 3))


#: Stated sources of chapters: own titles, announced ones every 90 words from the 30th, silences and pauses.
_OWN = "(SELECT doc_id, line_idx, min(s) AS start_sec, min(pos) AS pos, 'L' || CASE WHEN doc_id % 3 = 0 AND line_idx = 2 THEN 1 ELSE line_idx END AS title FROM " + _W + " WHERE doc_id % 2 = 0 AND line_idx >= doc_id % 5 GROUP BY 1, 2)"
_ANN = f"(SELECT doc_id, s AS start_sec, pos, 'Chapter ' || (pos // 90 + 1) AS title FROM {_W} WHERE pos % 90 = 30 AND doc_id % 7 <> 0)"
_SILT = f"(SELECT doc_id, start_sec, pos, 'Chapter ' || number AS title FROM {_SIL_CH})"
_PAU = f"(SELECT doc_id, start_sec, pos, 'Chapter ' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS title FROM (SELECT doc_id, 0.0::DOUBLE AS start_sec, min(pos) AS pos FROM {_W} GROUP BY 1 UNION ALL SELECT doc_id, s, pos FROM (SELECT doc_id, s, pos, round(s - lag(e) OVER (PARTITION BY doc_id ORDER BY pos), 3) AS gap FROM {_W}) WHERE gap >= 3))"
_LEN = f"(SELECT doc_id, max(e) AS duration FROM {_W} GROUP BY 1)"
_CASC = f"""WITH d AS {_LEN}, own AS {_OWN}, ann AS {_ANN}, sil AS {_SILT}, pau AS {_PAU},
g1 AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n, count(DISTINCT lower(title)) AS t, min(start_sec) AS f FROM own GROUP BY 1) JOIN d USING (doc_id) WHERE n = t AND f <= 0.2 * duration AND (duration <= 10800 OR n >= duration // 5400)),
g2 AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n, max(start_sec) AS l FROM ann GROUP BY 1) JOIN d USING (doc_id) WHERE n >= 5 AND (duration < 3600 OR l >= 0.6 * duration) AND doc_id NOT IN (SELECT doc_id FROM g1)),
g3 AS (SELECT doc_id FROM sil GROUP BY 1 HAVING count(*) >= 3 AND doc_id NOT IN (SELECT doc_id FROM g1 UNION SELECT doc_id FROM g2)),
g4 AS (SELECT doc_id FROM pau GROUP BY 1 HAVING count(*) BETWEEN 3 AND 80 AND doc_id NOT IN (SELECT doc_id FROM g1 UNION SELECT doc_id FROM g2 UNION SELECT doc_id FROM g3)),
u AS (SELECT doc_id, start_sec, pos, title, 'supplied' AS method FROM own WHERE doc_id IN (SELECT doc_id FROM g1) UNION ALL SELECT doc_id, start_sec, pos, title, 'announced' FROM ann WHERE doc_id IN (SELECT doc_id FROM g2) UNION ALL
SELECT doc_id, start_sec, pos, title, 'silences' FROM sil WHERE doc_id IN (SELECT doc_id FROM g3) UNION ALL SELECT doc_id, start_sec, pos, title, 'pauses' FROM pau WHERE doc_id IN (SELECT doc_id FROM g4))
SELECT * FROM u UNION ALL SELECT doc_id, 0, 0, 'Prelude', any_value(method) FROM u GROUP BY 1 HAVING min(start_sec) > 60 OR min(pos) > 100 UNION ALL SELECT doc_id, 0, 0, 'Full Transcript', 'whole' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM u)"""


@query(_CASC)
def chapter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG10, SCA40: chapters of each text from the best source it has."""
    w = words(spark, sf_dir)
    line = F.when((F.col("doc_id") % 3 == 0) & (F.col("line_idx") == 2), 1).otherwise(F.col("line_idx"))
    own = w.where("doc_id % 2 = 0 and line_idx >= doc_id % 5").groupBy("doc_id", "line_idx").agg(F.min("s").alias("start_sec"), F.min("pos").alias("pos")).withColumn("title", F.concat(F.lit("L"), line.cast("string")))
    number = lambda c: F.concat(F.lit("Chapter "), c.cast("string")).alias("title")
    announced = w.where("pos % 90 = 30 and doc_id % 7 <> 0").select("doc_id", F.col("s").alias("start_sec"), "pos", number(F.floor(F.col("pos") / 90) + 1))
    # Chapters from silences and from pauses, and lengths, come from one deal of the words.
    found = tr.inferred(tr.starts(w, quiet(spark, sf_dir))).withColumn("title", number(F.col("number"))).drop("number")
    stated = lambda df, method: df.select("doc_id", F.lit(method).alias("method"), "start_sec", "pos", "title", F.lit(None).cast("double").alias("duration"))
    return tr.chapter_cascade(stated(own, "supplied").unionByName(stated(announced, "announced")).unionByName(found))


@query()
def renumbered_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN23: numbers that come twice, set right; the running state is tested by known answers."""
    c = tr.silence_chapters(words(spark, sf_dir), quiet(spark, sf_dir))
    return tr.reconciled(c.select("doc_id", "start_sec", "pos", F.concat(F.lit("Chapter "), (F.col("number") % 4 + 1).cast("string")).alias("title")))


@query()
def filled_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN24: chapters that were not heard, put between the others; tested by known answers."""
    w = words(spark, sf_dir)
    c = w.where("pos % 200 = 50").select("doc_id", (F.floor(F.col("pos") / 200) * 3 + 1).cast("int").alias("number"), F.col("s").alias("start_sec"), F.lit(0.8).alias("confidence"))
    return tr.filled_numbers(c, quiet(spark, sf_dir))


@query(f"""WITH c AS (SELECT work, CAST(i AS INT) AS number, 17.0::DOUBLE * i AS start_sec, 17.0::DOUBLE * i + 15 AS end_sec FROM (SELECT work, unnest(range(0, 8)) AS i FROM (SELECT DISTINCT work FROM {_PLACED})))
SELECT c.work, number, n, round(c.start_sec - f.start_sec, 3) AS local_start, round(least(c.end_sec - f.start_sec, f.duration), 3) AS local_end FROM c JOIN {_PLACED} f ON f.work = c.work AND c.start_sec >= f.start_sec AND c.start_sec < f.start_sec + f.duration""")
def chapters_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG7: chapters of a work's clock as places in its files."""
    f = placed_files(spark, sf_dir)
    c = f.select("work").distinct().select("work", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("number")).withColumn("start_sec", F.col("number") * 17.0).withColumn("end_sec", F.col("start_sec") + 15)
    return tr.in_files(c, f, "work").withColumn("local_start", F.round("local_start", 3)).withColumn("local_end", F.round("local_end", 3))


@query(f"""SELECT doc_id, number, count(*) AS words, md5(regexp_replace(string_agg(w || CASE WHEN cut THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY pos), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM (
SELECT w.doc_id, w.pos, w.w, c.number, coalesce(lead(w.s) OVER (PARTITION BY w.doc_id ORDER BY w.pos) - w.e >= 0.6 AND regexp_matches(w.w, '[.!?]["'')”’]*$'), false) AS cut FROM {_W} w ASOF JOIN (SELECT doc_id, s AS at, CAST(pos // 120 + 1 AS INT) AS number FROM {_W} WHERE pos % 120 = 15) c ON c.doc_id = w.doc_id AND w.s >= c.at) GROUP BY 1, 2""")
def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG12, SEG13: texts of chapters with paragraphs."""
    w = words(spark, sf_dir)
    starts = w.where("pos % 120 = 15").select("doc_id", F.col("s").alias("start_sec"), (F.floor(F.col("pos") / 120) + 1).cast("int").alias("number"))
    return tr.chapter_texts(w, starts).select("doc_id", "number", "words", F.md5("text").alias("text_md5"))


@query(f"""SELECT work, idx, part, CAST(row_number() OVER (PARTITION BY work, part ORDER BY idx) AS INT) AS within FROM (SELECT s.work, s.idx, coalesce(p.n, 1) AS part FROM (SELECT work, CAST(i AS INT) AS idx, 9.0::DOUBLE * i + 4 AS mid FROM (SELECT work, unnest(range(0, CAST(ceil(e / 9) AS BIGINT))) AS i FROM (SELECT work, max(start_sec + duration) AS e FROM {_PLACED} GROUP BY 1))) s
ASOF LEFT JOIN (SELECT work, n, round(coalesce(sum(duration) OVER (PARTITION BY work ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS at FROM {_PLACED}) p ON p.work = s.work AND s.mid >= p.at)""")
def parts_as_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH3: one part a file, and transcript segments numbered within the part that holds their middle."""
    f = placed_files(spark, sf_dir)
    n = f.groupBy("work").agg(F.max(F.col("start_sec") + F.col("duration")).alias("e"))
    s = n.select("work", F.explode(F.sequence(F.lit(0), F.ceil(F.col("e") / 9).cast("int") - 1)).alias("idx")).withColumn("start_sec", F.col("idx") * 9.0).withColumn("end_sec", F.col("start_sec") + 8)
    start = F.coalesce(F.sum("duration").over(Window.partitionBy("work").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return tr.relabelled_segments(s, f.select("work", "n", F.round(start, 3).alias("start_sec")), "work")


_K = "regexp_replace(lower(w), '^[^\\p{L}\\p{Nd}]+|[^\\p{L}\\p{Nd}]+$', '', 'g')"


@query(f"""SELECT doc_id, min(pos) AS pos, round(min(e2), 3) AS end_sec, round(min(s3), 3) AS next_sec FROM (SELECT doc_id, pos, {_K} AS a, lead({_K}) OVER p AS b, lead(e) OVER p AS e2, lead(s, 2) OVER p AS s3 FROM {_W} WINDOW p AS (PARTITION BY doc_id ORDER BY pos)) WHERE a = 'of' AND b = 'the' GROUP BY 1 HAVING count(*) = 1 AND min(s3) IS NOT NULL""")
def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH1: where a phrase is spoken, in texts that hold it once."""
    p = tr.phrase_places(words(spark, sf_dir), ["of", "the"])
    return p.select("doc_id", "pos", F.round("end_sec", 3).alias("end_sec"), F.round("next_sec", 3).alias("next_sec"))


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e, w) - 1 AS INT) AS pos, s, w FROM (SELECT doc_id, s, e, w FROM {_W} WHERE NOT (s >= 10 AND s < 20) AND NOT (s >= 40 AND s < 44) UNION ALL SELECT doc_id, round(10 + i * 0.5, 3), round(10.4 + i * 0.5, 3), 'new' || i FROM documents, unnest(range(0, 6)) AS t(i))""")
def redo_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH5, SET2, TOP7: spans of time replaced by fresh words, in order."""
    w = words(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id")
    spans = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(10.0).alias("a"), F.lit(20.0).alias("b")), F.struct(F.lit(40.0).alias("a"), F.lit(44.0).alias("b")))).alias("x")).select("doc_id", "x.a", "x.b")
    fresh = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("doc_id", F.round(10 + F.col("i") * 0.5, 3).alias("s"), F.round(10.4 + F.col("i") * 0.5, 3).alias("e"), F.concat(F.lit("new"), F.col("i").cast("string")).alias("w"))
    return tr.replaced_spans(w, fresh, spans).select("doc_id", "pos", "s", "w")


@query(f"""WITH f AS (SELECT work, n, 'f' || CAST(duration AS INT) AS name, duration, start_sec FROM {_PLACED}), r AS (SELECT work, n, CASE WHEN work % 13 = 0 AND n = 2 THEN 'x' ELSE name END AS name, CASE WHEN work % 17 = 0 AND n = 3 THEN duration + 2 ELSE duration END AS duration, CASE WHEN work % 19 = 0 AND n = 1 THEN start_sec - 3 ELSE start_sec END AS start_sec FROM f WHERE NOT (work % 11 = 0 AND n = 2)),
u AS (SELECT work FROM (SELECT work, count(*) AS x FROM f GROUP BY 1) JOIN (SELECT work, count(*) AS y FROM r GROUP BY 1) USING (work) WHERE x <> y)
SELECT work, 0 AS n, 'count' AS reason FROM u UNION ALL SELECT work, min(n), arg_min(reason, n) FROM (SELECT f.work, f.n, CASE WHEN f.name <> r.name THEN 'order' WHEN abs(f.duration - r.duration) > 1 THEN 'duration' WHEN abs(f.start_sec - r.start_sec) > 1 THEN 'offset' END AS reason FROM f JOIN r USING (work, n) WHERE f.work NOT IN (SELECT work FROM u)) WHERE reason IS NOT NULL GROUP BY 1""")
def layout_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH4: where a folder is no longer as it was recorded."""
    f = placed_files(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), F.col("duration").cast("int").cast("string")))
    hit = lambda k, n: (F.col("work") % k == 0) & (F.col("n") == n)
    r = f.where(~hit(11, 2)).withColumn("name", F.when(hit(13, 2), "x").otherwise(F.col("name"))).withColumn("duration", F.when(hit(17, 3), F.col("duration") + 2).otherwise(F.col("duration"))).withColumn("start_sec", F.when(hit(19, 1), F.col("start_sec") - 3).otherwise(F.col("start_sec")))
    return tr.layout_breaks(f, r, "work")


@query(f"""SELECT doc_id, pos, round(greatest(s - prev, 0, coalesce(max(d), 0)), 3) AS gap FROM (SELECT w.doc_id, w.pos, w.s, w.prev, q.b - q.a AS d FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {_W}) w LEFT JOIN {_Q} q ON q.doc_id = w.doc_id AND q.a > w.prev - 0.15 AND q.a < w.e WHERE w.prev IS NOT NULL) GROUP BY doc_id, pos, s, prev""")
def effective_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA39: pauses before words, by word times and silences."""
    return tr.effective_gaps(words(spark, sf_dir), quiet(spark, sf_dir)).select("doc_id", "pos", F.round("gap", 3).alias("gap"))
