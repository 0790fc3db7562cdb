"""Word timelines: gaps, holes, doubtful runs and repaired times, as windows over (book, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import relational as rel


def synthetic(docs: DataFrame) -> DataFrame:
    """A stated timeline of documents: word i of line l starts at 0.4 i + 3 l seconds and lasts 0.3, with a confidence that follows from its place.

    Columns: doc_id, pos, line_idx, s, e, w, conf.
    """
    # A word's place is its place in the row's list of words, so that no word has to be ranked.
    placed = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(tx.fields(x), lambda w: F.struct(i.alias("line_idx"), w.alias("w")))))
    words = docs.select("doc_id", F.posexplode(placed).alias("pos", "x")).select("doc_id", "pos", "x.line_idx", "x.w")
    # Times are whole tenths of a second, whose quotient is the double nearest to them.
    tenths = F.col("pos") * 4 + F.col("line_idx") * 30
    return words.select("doc_id", "pos", "line_idx", (tenths / 10.0).alias("s"), ((tenths + 3) / 10.0).alias("e"), "w", (((F.col("pos") * 37 + F.col("doc_id") * 11) % 100) / 100.0).alias("conf"))


def by(keys: list[str], order: str = "pos"):
    return Window.partitionBy(*keys).orderBy(order)


def pauses(words: DataFrame, least: float) -> DataFrame:
    """Words before a silence of at least ``least`` seconds (WIN1)."""
    gap = F.round(F.lead("s").over(by(["doc_id"])) - F.col("e"), 3)
    return words.withColumn("gap", gap).where(F.col("gap") >= least)


def paragraph_ids(words: DataFrame, pause: float = 0.6) -> DataFrame:
    """Words with a paragraph number that grows after a pause at a sentence's end (WIN2)."""
    w = by(["doc_id"])
    cut = (F.col("s") - F.lag("e").over(w) >= pause) & tx.ends_sentence(F.lag("w").over(w))
    return words.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn("paragraph", F.sum("cut").over(w)).drop("cut")


def buckets(words: DataFrame, width: float = 60.0) -> DataFrame:
    """Words in each time bucket, empty ones included (AGG16)."""
    have = words.groupBy("doc_id", F.floor(F.col("s") / width).alias("bucket")).agg(F.count("*").alias("n"))
    span = have.groupBy("doc_id").agg(F.max("bucket").alias("last"))
    every = span.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(have, ["doc_id", "bucket"], "left").select("doc_id", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


#: Width of a bucket, words below which it is a gap, share of silence that explains one, and the shortest span told of.
BUCKET, FEW_WORDS, MOSTLY_SILENT, SHORTEST = 60.0, 10, 0.75, 30.0
#: Seconds at either edge of a track, and the length up to which a hole there is passed over.
EDGE, EDGE_MOST = 45.0, 90.0


def silence_by_bucket(quiet: DataFrame, width: float = BUCKET) -> DataFrame:
    """Seconds of silence in each bucket (AGG16): a silence that spans several is shared out."""
    b = quiet.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    part = F.least(F.col("b"), (F.col("bucket") + 1) * width) - F.greatest(F.col("a"), F.col("bucket") * width)
    return b.withColumn("part", part).where("part > 0").groupBy("doc_id", "bucket").agg(F.sum("part").alias("quiet"))


def transcription_gaps(words: DataFrame, quiet: DataFrame, durations: DataFrame) -> DataFrame:
    """Runs of buckets with few words and little silence, cut at the duration (WIN3): doc_id, start_sec, end_sec, words."""
    every = durations.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / BUCKET) - 1)))
    have = words.groupBy("doc_id", F.floor(F.col("s") / BUCKET).alias("bucket")).agg(F.count("*").alias("n"))
    b = every.join(have, ["doc_id", "bucket"], "left").join(silence_by_bucket(quiet), ["doc_id", "bucket"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    runs = rel.islands(b.withColumn("n", n), ["doc_id"], "bucket", (F.coalesce("quiet", F.lit(0.0)) <= BUCKET * MOSTLY_SILENT) & (n < FEW_WORDS))
    spans = runs.groupBy("doc_id", "island").agg((F.min("bucket") * BUCKET).alias("start_sec"), F.least((F.max("bucket") + 1) * BUCKET, F.first("duration")).alias("end_sec"), F.sum("n").alias("words"))
    return spans.where(F.col("end_sec") - F.col("start_sec") >= SHORTEST).drop("island")


def holes(words: DataFrame, least: float) -> DataFrame:
    """Spans between the latest end so far and the next start: a running maximum, so an early overlap does not open a hole."""
    before = F.coalesce(F.max("e").over(by(["doc_id"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    h = words.withColumn("start_sec", before).where(F.col("s") - F.col("start_sec") >= least)
    return h.select("doc_id", "start_sec", F.col("s").alias("end_sec"))


def wordless_holes(words: DataFrame, quiet: DataFrame, durations: DataFrame) -> DataFrame:
    """Long stretches without a word, up to the end of the track, that are not mostly silence (WIN4); short ones at an edge are passed over."""
    tail = words.groupBy("doc_id").agg(F.max("e").alias("start_sec")).join(durations, "doc_id").select("doc_id", "start_sec", F.col("duration").alias("end_sec")).where(F.col("end_sec") - F.col("start_sec") >= SHORTEST)
    h = holes(words, SHORTEST).unionByName(tail).join(durations, "doc_id").where(F.col("duration") > SHORTEST)
    # Silences and holes meet in equal buckets; each part of a silence is counted in its own bucket once.
    split = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET)))
    low, high = F.col("bucket") * BUCKET, (F.col("bucket") + 1) * BUCKET
    part = F.least("b", "end_sec", high) - F.greatest("a", "start_sec", low)
    met = h.withColumn("bucket", split("start_sec", "end_sec")).join(quiet.withColumn("bucket", split("a", "b")), ["doc_id", "bucket"])
    cover = met.withColumn("part", part).where("part > 0").groupBy("doc_id", "start_sec", "end_sec").agg(F.sum("part").alias("cover"))
    j = h.join(cover, ["doc_id", "start_sec", "end_sec"], "left")
    size = F.col("end_sec") - F.col("start_sec")
    edge = (F.col("start_sec") < EDGE) | (F.col("end_sec") > F.col("duration") - EDGE)
    return j.where((F.coalesce("cover", F.lit(0.0)) / size < MOSTLY_SILENT) & ~(edge & (size <= EDGE_MOST))).select("doc_id", "start_sec", "end_sec")


def merged_spans(gaps: DataFrame, found: DataFrame) -> DataFrame:
    """Gaps, and holes that overlap none (WIN5): doc_id, kind, start_sec, end_sec, words."""
    g = gaps.select("doc_id", F.col("start_sec").alias("ga"), F.col("end_sec").alias("gb"))
    alone = found.join(g, (found["doc_id"] == g["doc_id"]) & (F.col("start_sec") < F.col("gb")) & (F.col("end_sec") > F.col("ga")), "left_anti")
    own = gaps.select("doc_id", F.lit("gap").alias("kind"), "start_sec", "end_sec", "words")
    return own.unionByName(alone.select("doc_id", F.lit("hole").alias("kind"), "start_sec", "end_sec", F.lit(0).cast("long").alias("words")))


def offsets(files: DataFrame, keys: list[str], order: str, size: str) -> Column:
    """Where each file starts when those before it are laid end to end (WIN11)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0.0))


def discontinuities(files: DataFrame, keys: list[str], order: str, slack: float = 1.0) -> DataFrame:
    """The first file of each work that starts over ``slack`` seconds away from the end of the one before (WIN10): keys, order, off."""
    before = F.lag(F.col("start_sec") + F.col("duration")).over(by(keys, order))
    broken = files.withColumn("off", F.round(F.col("start_sec") - before, 3)).where(F.abs("off") > slack)
    return broken.groupBy(*keys).agg(F.min(order).alias(order), F.min_by("off", order).alias("off"))


def doubtful_runs(words: DataFrame, below: float = 0.5, least: int = 8) -> DataFrame:
    """Unbroken runs of at least ``least`` words under a confidence (WIN6, WIN7)."""
    runs = rel.islands(words, ["doc_id"], "pos", F.col("conf") < below)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return runs.groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min("s").alias("start_sec"), F.max("e").alias("end_sec"), text.alias("text")).where(F.col("n") >= least).drop("island")


def peak_rate(words: DataFrame, seconds: int = 60) -> DataFrame:
    """Most words within any trailing window of seconds, and the first end of such a window (WIN8)."""
    w = Window.partitionBy("doc_id").orderBy("ms").rangeBetween(-1000 * seconds, 0)
    rated = words.withColumn("ms", F.round(F.col("s") * 1000).cast("long")).withColumn("n", F.count("*").over(w))
    return rated.groupBy("doc_id").agg(F.max("n").alias("peak"), F.max_by("s", F.struct("n", -F.col("s"))).alias("at_sec"))


def backward_steps(words: DataFrame, slack: float = 0.5) -> DataFrame:
    """Words that start over ``slack`` seconds before a start already reached (WIN9)."""
    high = F.max("s").over(by(["doc_id"]).rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("high", high).where(F.col("s") < F.col("high") - slack)


def filled_times(words: DataFrame, known: Column) -> DataFrame:
    """Start times where ``known`` fails are drawn on the line between the neighbours that are known; ends are carried (WIN13 to WIN15).

    What lies ahead is read backwards: a frame up to the end of a group would be read anew for each word.
    """
    back, ahead = rel.up_to_here(["doc_id"], "pos"), rel.up_to_here(["doc_id"], F.desc("pos"))
    p, s = F.when(known, F.col("pos")), F.when(known, F.col("s"))
    t = words.withColumn("p0", F.last(p, True).over(back)).withColumn("s0", F.last(s, True).over(back)).withColumn("p1", F.last(p, True).over(ahead)).withColumn("s1", F.last(s, True).over(ahead))
    line = F.col("s0") + (F.col("s1") - F.col("s0")) * F.try_divide(F.col("pos") - F.col("p0"), F.col("p1") - F.col("p0"))
    return t.withColumn("filled", F.round(F.when(F.col("p0") == F.col("p1"), F.col("s0")).otherwise(F.coalesce(line, "s0", "s1")), 3)).drop("p0", "s0", "p1", "s1")


def silence_kind(seconds: Column) -> Column:
    """Kind of silence by length (SCA38)."""
    return F.when(seconds >= 3.0, "chapter").when(seconds >= 0.6, "paragraph").when(seconds >= 0.3, "sentence").otherwise("breath")
