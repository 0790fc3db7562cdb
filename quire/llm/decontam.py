"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one
window).  The shingles of a window are ordered by how rare they are among the
documents.  Since a window has to occur whole, the necessary prefix is its
rarest shingle alone.  Documents' shingles join these prefix tokens; the
positional bound places the window, the length bound drops places at which it
would not fit, and the words of the document at that place are compared with
the window's.  Rows are told apart by identifier and a hash of the text.

Only DataFrame functions are used.  Tables of the benchmark's own size are
broadcast while their row count is at most ``BROADCAST_ROWS`` and joined by
shuffle beyond.

Defined results: a null or wordless document has no words and no hits; a null
or wordless item has no windows; an item without an identifier marks words but
is in no list of items; repeated rows repeat; an empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import materialize, text_hash

WINDOW, SHINGLE = 13, 3
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BREAKS), "")


def _shingles(words: Column, k: int) -> Column:
    """Hash of the shingle at each word that has ``k - 1`` words after it."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``key`` (words joined by a space), ``words``, ``len`` and the ``items`` that hold it."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return cut.groupBy(F.array_join("words", " ").alias("key")).agg(F.first("words").alias("words"), F.size(F.first("words")).alias("len"), F.collect_set("item").alias("items"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``hits`` (start and end of each occurring
    window, in words), ``items`` (sorted as strings), ``text_hash``, ``n_hit`` and
    ``contaminated`` (at least a twentieth of the words are hit)."""
    windows = materialize(item_windows(benchmark, item_col, item_text_col, window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE values
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), words_of(F.col(text_col)).alias("words"))
    grams = None
    for k in sizes:
        own = windows.where(F.least("len", F.lit(SHINGLE)) == k).withColumn("grams", _shingles(F.col("words"), k))
        part = own.select("key", "len", "items", F.posexplode("grams").alias("off", "gram")).withColumn("k", F.lit(k))
        grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        found = rows.select("id", "th", F.lit(None).cast("array<struct<s:int,len:int,items:array<bigint>>>").alias("hit")).where("false")
    else:
        found = _occurring(rows, materialize(grams, "grams"), sizes, window)
    return _listed(rows, materialize(found, "occurring"), id_col)


def _occurring(rows: DataFrame, grams: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """Windows that occur in each text: a text's shingle is the prefix token of a window that fits there and whose words are all there.

    Shingles are looked up in the pass that reads the texts; what goes on has
    the words near the shingle with it, so no text is moved between machines.
    """
    n = grams.count()
    seen = None
    for k in sizes:
        own = rows.withColumn("grams", _shingles(F.col("words"), k)).select("id", "th", "words", F.posexplode_outer("grams").alias("pos", "gram"))  # outer: else a filter that computes the array again is pushed to the scan
        own = own.join(_small(grams.where(f"k = {k}").select("gram").distinct(), n), "gram", "left_semi")
        first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = F.slice("words", first + 1, F.col("pos") + window - first)
        own = own.select("id", "th", F.size("words").alias("n"), "pos", "gram", F.lit(k).alias("k"), first.alias("first"), near.alias("near"))
        seen = own if seen is None else seen.unionByName(own)
    seen = materialize(seen, "shingles")
    rarity = seen.groupBy("k", "gram").count()
    ranked = grams.join(rarity, ["k", "gram"], "left").groupBy("key").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "gram", "off", "k", "len", "items")).alias("p"))
    prefix = materialize(ranked.where("p.c > 0").select("key", "p.gram", "p.off", "p.k", "p.len", "p.items"), "prefix")
    placed = seen.join(_small(prefix, n), ["k", "gram"]).withColumn("s", F.col("pos") - F.col("off"))
    fit = placed.where((F.col("s") >= 0) & (F.col("s") + F.col("len") <= F.col("n")))
    same = fit.where(F.array_join(F.slice("near", F.col("s") - F.col("first") + 1, F.col("len")), " ") == F.col("key"))
    return same.groupBy("id", "th").agg(F.collect_list(F.struct("s", "len", "items")).alias("hit"))


def _listed(rows: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    found = found.select(F.col("id").alias("found_id"), F.col("th").alias("found_th"), "hit")
    sized = rows.select("id", "th", F.size("words").cast("long").alias("n_words"))
    hit = sized.join(found, sized["id"].eqNullSafe(found["found_id"]) & (sized["th"] == found["found_th"]), "left")
    spans = F.array_sort(F.array_distinct(F.transform("hit", lambda c: F.struct(c["s"].alias("start"), (c["s"] + c["len"]).alias("end")))))
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hit", lambda c: c["items"])), lambda i: i.cast("string"))))
    listed = hit.select("id", "n_words", F.coalesce(spans, F.array()).alias("hits"), F.coalesce(items, F.array()).alias("items"), F.col("th").alias("text_hash"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    fresh = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    counted = listed.withColumn("n_hit", F.aggregate("hits", zero, fresh, lambda a: a["n"]))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)
