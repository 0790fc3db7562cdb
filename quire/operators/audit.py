"""Audits: whether what was derived of a work still fits its text, its audio and its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import relational as rel
from quire.operators import timeline as tl

#: Share by which word counts may differ, share of a chapter that its chunks reach, and words at one instant, confidence, run and rate that stand for invented text.
COUNT_SLACK, CHUNK_REACH, AT_ONCE, LOW, LOW_RUN, RATE_MOST = 0.05, 0.9, 6, 0.5, 8, 450.0
#: Share of a narration's words found that is a match, and severities with their order.
MATCH_LEAST, SEVERITY = 99.0, (("HIGH", 0), ("MED", 1), ("LOW", 2))


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def differs(a: Column, b: Column, slack: float = COUNT_SLACK) -> Column:
    return F.coalesce((b > 0) & (F.abs(a - b) > slack * b), F.lit(False))


def stale_chunks(chapters: DataFrame, chunks: DataFrame, keys: list[str], words: str = "w") -> DataFrame:
    """Books whose chunks do not describe their chapters (SEG2): keys, stale.

    Chapters without chunks, chunks without chapters, chunks that end before nine
    tenths of the text, or whose words are no longer those.  ``chapters``: keys,
    chapter and the words; ``chunks``: keys, chapter, start_word, end_word, content.
    """
    c = chapters.where(F.size(words) > 0)
    j = c.join(chunks, [*keys, "chapter"], "full_outer")
    now = F.array_join(F.slice(words, F.col("start_word") + 1, F.greatest(F.col("end_word") - F.col("start_word"), F.lit(0))), " ")
    wrong = F.col(words).isNull() | F.col("content").isNull() | (F.col("end_word") > F.size(words)) | (F.col("content") != now)
    by = j.groupBy(*keys, "chapter").agg(F.bool_or(wrong).alias("wrong"), F.max("end_word").alias("reach"), F.max(F.size(words)).alias("n"))
    return by.groupBy(*keys).agg(F.bool_or(F.col("wrong") | (F.col("reach") < CHUNK_REACH * F.col("n"))).alias("stale"))


def coherence(sources: DataFrame, works: DataFrame) -> DataFrame:
    """Issues of each work's derived data (DQ1): work, surface, severity, n.

    ``sources``: work, book, chapters, chunks, embedded, stale (chapters with a
    chunk of other words); ``works``: work, transcript_words, sync_words, trust_words.
    """
    issue = lambda df, surface, severity, n: df.groupBy("work").agg(n.alias("n")).where("n > 0").select("work", F.lit(surface).alias("surface"), F.lit(severity).alias("severity"), "n")
    count = F.count("*")
    bare = sources.where("chapters > 0 and chunks = 0")
    partly = sources.where("chunks > 0 and embedded > 0 and embedded < chunks")
    read = works.where("transcript_words > 0")
    off = read.where((F.col("sync_words") == 0) | differs(F.col("sync_words"), F.col("transcript_words")))
    old = works.where((F.col("sync_words") > 0) & (F.col("trust_words") > 0) & differs(F.col("trust_words"), F.col("sync_words")))
    return stacked([issue(sources, "qa_chunks", "incoherent", F.sum("stale")), issue(bare, "no_chunks", "degraded", count), issue(partly, "embeddings", "degraded", count), issue(off, "sync", "incoherent", count), issue(old, "text_trust", "degraded", count)])


def worst_first(issues: DataFrame, works: DataFrame) -> DataFrame:
    """Every work with its state, number of issues and place, worst first (DQ2, TOP4)."""
    n = issues.groupBy("work").agg(F.count("*").alias("issues"), F.bool_or(F.col("severity") == "incoherent").alias("bad"))
    j = works.select("work").join(n, "work", "left").withColumn("issues", F.coalesce("issues", F.lit(0).cast("long")))
    rank = F.when(F.col("bad"), 0).when(F.col("issues") > 0, 1).otherwise(2)
    state = F.when(F.col("bad"), "incoherent").when(F.col("issues") > 0, "degraded").otherwise("coherent")
    return j.select("work", "issues", state.alias("state"), rank.alias("rank"))


def timeline_problems(words: DataFrame, durations: DataFrame, sources: DataFrame) -> DataFrame:
    """What is wrong with each word timeline (DQ4): doc_id, kind, n.

    Many words at one instant; words outside the audio; words set back; more
    words a minute than anyone speaks; long runs that the recogniser doubted; and
    files that do not tile the clock.  ``sources``: doc_id, n, start_sec, duration.
    """
    # All that asks for a text's words together sits on one deal of them by text.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = words.join(durations.select("doc_id", "duration"), "doc_id", "left").select("doc_id", "pos", "s", "e", "conf", "duration", F.round(F.col("s") * 1000).cast("long").alias("ms")).repartition(parts, "doc_id")
    order = Window.partitionBy("doc_id").orderBy("pos")
    doubted = F.coalesce(F.col("conf") < LOW, F.lit(False))
    w = w.withColumn("high", F.max("s").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("doubted", doubted)
    w = w.withColumn("island", F.row_number().over(order) - F.sum(F.col("doubted").cast("int")).over(rel.up_to_here(["doc_id"], "pos")))
    w = w.withColumn("rate", F.count("*").over(Window.partitionBy("doc_id").orderBy("ms").rangeBetween(-60_000, 0)))
    w = w.withColumn("together", F.count("*").over(Window.partitionBy("doc_id", "s"))).withColumn("run", F.count("*").over(Window.partitionBy("doc_id", "doubted", "island")))
    counts = {
        "synthesized_word_timings": F.count_if(F.col("together") > AT_ONCE),
        "words_outside_audio": F.count_if((F.col("s") < -0.5) & F.col("duration").isNotNull() | (F.col("e") > F.col("duration") + 1.0)),
        "non_monotonic": F.count_if(F.col("s") < F.col("high") - 0.5),
        "implausible_density": F.when(F.max("rate") > RATE_MOST, F.max("rate")),
        "model_did_not_believe_this": F.when((F.max("conf") > 0) & F.col("doc_id").isNotNull(), F.count_if(F.col("doubted") & (F.col("run") >= LOW_RUN))),
    }
    each = w.groupBy("doc_id").agg(F.array(*[F.struct(F.lit(name).alias("kind"), n.cast("long").alias("n")) for name, n in counts.items()]).alias("found"))
    broken = tl.discontinuities(sources, ["doc_id"], "n").select("doc_id", F.lit("source_discontinuity").alias("kind"), F.col("n").cast("long").alias("n"))
    return each.select("doc_id", F.inline("found")).where("n > 0").unionByName(broken.where("n > 0"))


def drift(editions: DataFrame, transcripts: DataFrame, matches: DataFrame, stale: DataFrame) -> DataFrame:
    """How each work's stored transcripts fit the recordings on disk (DQ5): work, state, percent.

    Each recording answers for one transcript, best matches first; the work is as
    current as its worst edition.  ``editions``: work, edition, readable;
    ``transcripts``: work, book; ``matches``: pairs work, edition, book, percent, one to one;
    ``stale``: books whose chunks are not theirs.
    """
    e = editions.join(matches, ["work", "edition"], "left").join(stale.select("book", F.lit(True).alias("old")), "book", "left")
    worst = F.min_by(F.struct("percent", "book", "old"), F.struct(F.coalesce("percent", F.lit(0.0)), "edition"))
    w = e.groupBy("work").agg(F.bool_and("readable").alias("readable"), worst.alias("m"))
    has = transcripts.select("work").distinct().withColumn("imported", F.lit(True))
    j = w.join(has, "work", "left")
    state = F.when(F.col("imported").isNull(), "not_imported").when(~F.col("readable"), "unreadable").when(F.col("m.book").isNull(), "not_imported").when(F.col("m.percent") < MATCH_LEAST, "stale").when(F.col("m.old"), "chunks_stale").otherwise("ok")
    return j.select("work", state.alias("state"), F.coalesce("m.percent", F.lit(0.0)).alias("percent"))


def gap_causes(books: DataFrame, gaps: DataFrame) -> DataFrame:
    """Why parts of each work are missing (AGG22, OTH21): work, missing_sec, spans, cause.

    A truncated file first, then a damaged one; if all were read and are whole the
    transcription dropped them; else it is not known.  ``books``: work, book,
    scanned, errors, truncated; ``gaps``: work, book, duration.
    """
    g = gaps.groupBy("work").agg(F.sum("duration").alias("missing_sec"), F.count("*").alias("spans"))
    b = books.groupBy("work").agg(F.count("*").alias("n"), F.count_if(F.col("scanned") & F.col("truncated")).alias("cut"), F.count_if(F.col("scanned") & ~F.col("truncated") & (F.col("errors") > 0)).alias("hurt"), F.count_if(F.col("scanned") & ~F.col("truncated") & (F.col("errors") == 0)).alias("whole"))
    j = b.join(g, "work", "left").withColumn("spans", F.coalesce("spans", F.lit(0).cast("long")))
    cause = F.when(F.col("cut") > 0, "truncated_source").when(F.col("hurt") > 0, "damaged_source").when((F.col("spans") > 0) & (F.col("whole") == F.col("n")), "dropped_segment").when(F.col("spans") > 0, "unknown")
    return j.withColumn("cause", cause).where("cause is not null").select("work", F.coalesce("missing_sec", F.lit(0.0)).alias("missing_sec"), "spans", "cause")


def sync_health(sources: DataFrame, chapters: DataFrame, most: int = 12, least: int = 150) -> DataFrame:
    """How much of each source can be followed (TOP5): work, book, chapters, word, paragraph, none, dead, place.

    The twelve largest chapters of 150 words or more are looked at.  ``sources``:
    work, book; ``chapters``: book, chapter, words, mode.
    """
    w = Window.partitionBy("book").orderBy(F.desc("words"), "chapter")
    c = chapters.where(F.col("words") >= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    n = lambda m: F.count_if(F.col("mode") == m).alias(m)
    h = sources.join(c.groupBy("book").agg(F.count("*").alias("chapters"), n("word"), n("paragraph"), n("none")), "book", "left").fillna(0, ["chapters", "word", "paragraph", "none"])
    return h.withColumn("dead", (F.col("chapters") > 0) & (F.col("word") == 0) & (F.col("paragraph") == 0))


def findings(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Findings of several checks in one list (DQ8): severity, check, work, n and the order of severity."""
    order = F.create_map(*[F.lit(x) for p in SEVERITY for x in p])
    rows = [df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.col("work").cast("long").alias("work"), F.col("n").cast("long").alias("n")) for check, (severity, df) in parts.items()]
    return stacked(rows).withColumn("place", F.element_at(order, F.col("severity")))


def findings_of(works: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """As ``findings`` for checks that are columns of one row a work: those with a count above zero; a null count is no finding."""
    order = dict(SEVERITY)
    rows = F.array(*[F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), n.cast("long").alias("n"), F.lit(order[severity]).alias("place")) for check, (severity, n) in checks.items()])
    return works.select(F.col("work").cast("long").alias("work"), F.inline(rows)).where("n > 0").select("severity", "check", "work", "n", "place")
