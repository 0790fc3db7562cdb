"""What follows from aligned segments of two renderings: audio times, coverage, differences, reading along.

Segments have the key columns, half-open token ranges ``es``, ``ee`` (ebook) and
``ts``, ``te`` (transcript) and ``kind``: aligned, ebook-only, trans-only or
replace.  Word times have the key columns, ``pos``, ``s`` and ``e``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import ngrams
from quire.operators import relational as rel
from quire.operators.nearest import nearest

#: Length from which a word without a successor ends, the fewest words whose rate is judged, and the most words a second.
LAST_WORD, RATE_WORDS, RATE_MOST = 0.3, 30, 8.0
#: Share of a track that a map has to reach, and the length from which that is asked.
EXTENT, EXTENT_FROM = 0.85, 60.0
#: Words of a difference that are shown.
SHOWN_WORDS = 600
#: Nearness from which two passages can match, and the coverage below which words give way to passages.
PASSAGE_NEAR, WORD_COVERAGE = 0.6, 0.25
#: Digits to which the nearness of passages is compared.
EQUAL_TO = 12
#: Words of a bucket in which segments meet chapters and ranges.
SPAN = 256


def length(a: str, b: str) -> Column:
    return F.col(b) - F.col(a)


def assembled(chapters: DataFrame, keys: list[str], order: str, title: str | None, text: str) -> DataFrame:
    """Where each chapter starts in its book's token stream and how long it is (ALN1): keys, order, start, len; front and back matter is left out."""
    kept = chapters if title is None else chapters.where(~tx.is_boilerplate(title))
    c = kept.select(*keys, order, F.size(tx.tokenize(text)).alias("len"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("int"))


def token_fields(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """For each token of a text the white-space word it comes from: keys, tok, field.  One word can hold several tokens, or none."""
    f = docs.select(*keys, F.transform(tx.fields(text), lambda w, i: F.transform(tx.tokenize(w), lambda t: i)).alias("f"))
    return f.select(*keys, F.posexplode(F.flatten("f")).alias("tok", "field"))


def track(words: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each transcript: keys, ``p0``, the place of its first word, and ``s`` and ``e`` from there on, null where a word is missing.

    What stands elsewhere of a work meets it by the work alone, so that no word is dealt anew.
    """
    t = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "s", "e"))).alias("t")).withColumn("p0", F.get("t", F.lit(0))["pos"])
    last = F.element_at("t", -1)["pos"]
    whole = last - F.col("p0") == F.size("t") - 1
    spread = lambda c: F.when(whole, F.col("t")[c]).otherwise(F.transform(F.sequence("p0", last), lambda p: F.get(F.filter("t", lambda x: x["pos"] == p), F.lit(0))[c]))
    return t.select(*keys, "p0", spread("s").alias("s"), spread("e").alias("e"))


def tracked(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` if it is a ``track`` already, else their track, to be joined by merging: its lists are far larger than its estimated size, by which it would be broadcast."""
    return (words if "p0" in words.columns else track(words, keys)).hint("merge")


def word_at(times: str, pos: Column) -> Column:
    """The time of the word at a place of a ``track``."""
    return F.get(times, pos - F.col("p0"))


def baked(segments: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with ``start_sec`` and ``end_sec``, which only aligned ones have (ALN6): when their first and last transcript words are spoken."""
    aligned = F.col("kind") == "aligned"
    timed = segments.join(tracked(words, keys), keys, "left")
    return timed.select(*segments.columns, F.when(aligned, word_at("s", F.col("ts"))).alias("start_sec"), F.when(aligned, word_at("e", F.col("te") - 1)).alias("end_sec"))


def word_seconds(segments: DataFrame, words: DataFrame, keys: list[str], spans: DataFrame | None = None, chapter: str = "chapter") -> DataFrame:
    """When each ebook word of an aligned segment is spoken (ALN6): keys, w, sec; both sides advance together, in whole tokens.

    With ``spans`` (keys, chapter, start, len) only words in them, with chapter and
    start: segments meet chapters and transcript first, so that words are only
    counted out at the end.
    """
    e = segments.where("kind = 'aligned' and ee > es and te > ts").select(*keys, "es", "ts", "ee", "te").join(tracked(words, keys).drop("e"), keys)
    own = [] if spans is None else [chapter, "start"]
    a, b = F.col("es"), F.col("ee")
    if spans is not None:
        stop = F.col("start") + F.col("len")
        e = e.join(spans.select(*keys, chapter, "start", "len"), keys).where((F.col("es") < stop) & (F.col("ee") > F.col("start")) & (F.col("len") > 0))
        a, b = F.greatest("es", "start"), F.least(F.col("ee"), stop)
    each = e.select(*keys, *own, "es", "ts", "ee", "te", "p0", "s", F.explode(F.sequence(a, b - 1)).alias("w"))
    at = F.col("ts") + F.floor((F.col("w") - F.col("es")) * length("ts", "te") / length("es", "ee")).cast("int")
    return each.select(*keys, *own, "w", word_at("s", at).alias("sec")).where("sec is not null")


def render_timeline(seconds: DataFrame, keys: list[str], chapter: str) -> DataFrame:
    """Places and times within each chapter (WIN17): the earliest second of a word, never stepping back; second 0 is no time.

    ``seconds``: keys, chapter, start, w, sec.
    """
    first = seconds.where("sec > 0").groupBy(*keys, chapter, (F.col("w") - F.col("start")).alias("w")).agg(F.min("sec").alias("sec"))
    return first.withColumn("sec", F.max("sec").over(Window.partitionBy(*keys, chapter).orderBy("w")))


def word_sync(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a chapter with start and end (ALN16): ``sec`` null where unknown is filled from the word before, at the start from the first known.

    Chapters without a known word have none, nor have those of thirty words or more that would be read at over eight words a second.
    """
    w = Window.partitionBy(*keys).orderBy("w")
    start = F.coalesce(F.last("sec", True).over(w), F.first("sec", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    timed = words.withColumn("s", start).where("s is not null")
    after = F.lead("s").over(w)
    out = timed.withColumn("e", F.when(after > F.col("s"), after).otherwise(F.col("s") + LAST_WORD))
    # The rate of a chapter is that of its rows, which are together already.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = out.withColumn("n", F.count("*").over(whole)).withColumn("span", F.last("s").over(whole) - F.first("s").over(whole))
    return rated.where((F.col("n") < RATE_WORDS) | (F.col("span") > 0) & (F.col("n") <= RATE_MOST * F.col("span"))).select(*keys, "w", "s", "e")


def met_chapters(segments: DataFrame, words: DataFrame, keys: list[str], spans: DataFrame, chapter: str, how: str = "inner") -> DataFrame:
    """Chapters with the aligned segments that meet them: keys, chapter, start, len, es, ts, ee, te, end_sec and the transcript's p0 and s; by ``left`` those that none meets too."""
    own = segments.where("kind = 'aligned'").select(*keys, "es", "ts", "ee", "te").join(tracked(words, keys), keys)
    own = own.select(*[F.col(k).alias(f"__{k}") for k in keys], "es", "ts", "ee", "te", "p0", "s", word_at("e", F.col("te") - 1).alias("end_sec"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    met = [F.col("es") < F.col("start") + F.col("len"), F.col("ee") > F.col("start")]
    return spans.select(*keys, chapter, "start", "len").join(own.hint("merge"), [*same, *met], how).drop(*[f"__{k}" for k in keys])


def _spoken_at(w: Column) -> Column:
    """When an ebook word of a segment is spoken: both sides advance together, in whole tokens."""
    return word_at("s", F.col("ts") + F.floor((w - F.col("es")) * length("ts", "te") / length("es", "ee")).cast("int"))


def _readable(n: Column, span: Column) -> Column:
    """Whether a chapter has few words, or is not read at over eight words a second."""
    return (n < RATE_WORDS) | (span > 0) & (n <= RATE_MOST * span)


def synced_words(segments: DataFrame, words: DataFrame, keys: list[str], spans: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Words of chapters with start and end, as ``word_sync`` times them (ALN16): keys, chapter, w, s, e.

    ``spans``: keys, chapter, start, len.  A chapter's times are one list, and
    words are counted out at the end only; where segments overlap, the earliest
    time of a word counts.
    """
    a, b = F.greatest("es", "start"), F.least(F.col("ee"), F.col("start") + F.col("len"))
    m = met_chapters(segments, words, keys, spans, chapter).where("ee > es and te > ts and len > 0")
    # Sides of one length advance word by word: such times are a part of the track as they stand.
    shift = F.col("ts") - F.col("es") - F.col("p0")
    even = (length("es", "ee") == length("ts", "te")) & (shift + a >= 0) & (shift + b <= F.size("s"))
    secs = F.when(even, F.slice("s", shift + a + 1, b - a)).otherwise(F.transform(F.sequence(a, b - 1), _spoken_at))
    own = [*keys, chapter, "start", "len"]
    c = m.select(*own, F.struct((a - F.col("start")).alias("off"), secs.alias("secs")).alias("__x")).groupBy(*own).agg(F.array_sort(F.collect_list("__x")).alias("__p"))
    stop = lambda x: x["off"] + F.size(x["secs"])
    at = lambda i: F.get("__p", i)
    plain = F.forall(F.transform("__p", lambda x, i: F.coalesce(x["off"] >= stop(at(i - 1)), F.lit(True)) & ~F.exists(x["secs"], lambda t: t.isNull())), lambda x: x)
    # A time holds up to the next known word, the first one from the start.
    ahead = lambda x, i: F.array_repeat(F.get(x["secs"], F.lit(0)), F.when(i == 0, x["off"]).otherwise(0))
    held = lambda x, i: F.array_repeat(F.try_element_at(x["secs"], F.lit(-1)), F.coalesce(at(i + 1)["off"], F.col("len")) - stop(x))
    by_piece = F.flatten(F.transform("__p", lambda x, i: F.concat(ahead(x, i), x["secs"], held(x, i))))
    # Where words lack times or segments overlap, each word is looked at.
    each = F.flatten(F.transform("__p", lambda x: F.transform(x["secs"], lambda t, i: F.struct((x["off"] + i).alias("w"), t.alias("sec")))))
    known = F.when(~F.col("__plain"), F.array_sort(F.filter(each, lambda x: x["sec"].isNotNull())))
    c = c.select(*own, "__p", plain.alias("__plain")).select(*own, "__p", "__plain", known.alias("__k"))
    once = F.filter("__k", lambda x, i: (i == 0) | (x["w"] != F.get("__k", i - 1)["w"]))
    c = c.select(*own, "__p", "__plain", once.alias("__k")).where(F.col("__plain") | (F.size("__k") > 0))
    until = lambda i: F.coalesce(F.get("__k", i + 1)["w"], F.col("len"))
    by_word = F.flatten(F.transform("__k", lambda x, i: F.array_repeat(x["sec"], until(i) - F.when(i == 0, 0).otherwise(x["w"]))))
    c = c.select(*own, F.when(F.col("__plain"), by_piece).otherwise(by_word).alias("__t"))
    c = c.where(_readable(F.col("len"), F.try_element_at("__t", F.lit(-1)) - F.get("__t", F.lit(0))))
    after = F.get("__t", F.col("__i") + 1)
    timed = c.select(*keys, chapter, "start", "__t", F.posexplode("__t").alias("__i", "s"))
    return timed.select(*keys, chapter, (F.col("start") + F.col("__i")).alias("w"), "s", F.when(after > F.col("s"), after).otherwise(F.col("s") + LAST_WORD).alias("e"))


def sync_modes(segments: DataFrame, words: DataFrame, keys: list[str], spans: DataFrame, chapter: str = "chapter") -> DataFrame:
    """How closely each chapter can be followed (ALN15): keys, chapter, mode: word, if ``synced_words`` has it, paragraph, if it has two anchors, or none.

    No word is counted out: a chapter's rate follows from its first and its last
    known word, and each timed segment that meets it gives two anchors.
    """
    a, b = F.greatest("es", "start"), F.least(F.col("ee"), F.col("start") + F.col("len")) - 1
    m = met_chapters(segments, words, keys, spans, chapter, "left")
    worded = (F.col("ee") > F.col("es")) & (F.col("te") > F.col("ts")) & (F.col("len") > 0)
    # Nearly always the outermost word has a time; only where it has none, those beside it are looked at.
    known = F.filter(F.transform(F.sequence(a, b), lambda w: F.struct(w.alias("w"), _spoken_at(w).alias("sec"))), lambda x: x["sec"].isNotNull())
    at = lambda w, other: F.when(worded, F.when(_spoken_at(w).isNotNull(), F.struct(w.alias("w"), _spoken_at(w).alias("sec"))).otherwise(other))
    m = m.select(*keys, chapter, "len", (F.col("end_sec") > 0).alias("anchor"), at(a, F.get(known, F.lit(0))).alias("__x"), at(b, F.try_element_at(known, F.lit(-1))).alias("__y"))
    last = F.when(F.col("__y").isNotNull(), F.struct((-F.col("__y.w")).alias("w"), "__y.sec"))
    c = m.groupBy(*keys, chapter, "len").agg(F.min("__x")["sec"].alias("first"), F.min(last)["sec"].alias("last"), F.max("anchor").alias("by_paragraph"))
    by_word = F.col("first").isNotNull() & _readable(F.col("len"), F.col("last") - F.col("first"))
    return c.select(*keys, chapter, F.when(by_word, "word").when(F.col("by_paragraph"), "paragraph").otherwise("none").alias("mode"))


def fraction_anchors(segments: DataFrame, spans: DataFrame, keys: list[str], chapter: str) -> DataFrame:
    """Fractions of a chapter and the seconds at which they are read, in order (WIN16): keys, chapter, anchors; at least two, else nothing can be followed."""
    ends = spans.withColumn("stop", F.col("start") + F.col("len"))
    s = rel.span_join(segments.where("kind = 'aligned' and end_sec > 0"), ends, keys, "es", "ee", "start", "stop", SPAN)
    part = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col("start")) / F.col("len")))
    point = lambda f, sec: F.struct(part(f).alias("frac"), F.col(sec).alias("sec"))
    both = s.groupBy(*keys, chapter).agg(F.array_sort(F.flatten(F.collect_list(F.array(point("es", "start_sec"), point("ee", "end_sec"))))).alias("anchors"))
    return both.where(F.size("anchors") >= 2)


def second_at(anchors: Column, frac: Column) -> Column:
    """Second at a fraction between sorted anchors (WIN16): linear, held at both ends."""
    after = F.filter(F.slice(anchors, F.lit(2), F.greatest(F.size(anchors) - 1, F.lit(0))), lambda a: a["frac"] >= frac)
    i = F.size(anchors) - F.size(after)  # place of the first anchor at or after it
    a, b = F.get(anchors, i - 1), F.get(anchors, i)
    line = a["sec"] + F.coalesce(F.try_divide(frac - a["frac"], b["frac"] - a["frac"]), F.lit(0.0)) * (b["sec"] - a["sec"])
    first, last = F.get(anchors, F.lit(0)), F.element_at(anchors, -1)
    return F.when(frac <= first["frac"], first["sec"]).when(frac >= last["frac"], last["sec"]).otherwise(line)


def paragraph_windows(paragraphs: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Times of paragraphs (ALN15): keys, paragraph_idx, s, e; windows follow one another and never turn back.

    ``paragraphs``: keys, paragraph_idx, word_start, word_end.
    """
    total = paragraphs.groupBy(*keys).agg(F.max("word_end").alias("total")).where("total > 0")
    at = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.col("total")))
    p = paragraphs.join(total, keys).join(anchors, keys).withColumn("s", second_at(F.col("anchors"), at("word_start"))).withColumn("e", second_at(F.col("anchors"), at("word_end")))
    w = Window.partitionBy(*keys).orderBy("paragraph_idx")
    reach = F.max(F.greatest("s", "e")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = p.withColumn("s", F.greatest("s", F.coalesce(reach, F.lit(0.0))))
    return out.withColumn("e", F.greatest("e", "s")).select(*keys, "paragraph_idx", "s", "e")


def source_timestamps(words: DataFrame, keys: list[str], ends: DataFrame) -> DataFrame:
    """Times of every word of a text of which some have been matched to spoken ones (ALN9): keys, pos, s, e.

    ``words``: keys, pos, and s and e of the spoken word, null where unmatched.  A
    run without times is spread evenly from the end of the word before to the
    start of the one after, or to ``audio_end`` of ``ends``.  What lies ahead is
    read backwards: a frame up to the end of a group would be read anew for each word.
    """
    back, ahead = rel.up_to_here(keys, "pos"), rel.up_to_here(keys, F.desc("pos"))
    known = F.col("s").isNotNull()
    t = words.withColumn("p0", F.last(F.when(known, F.col("pos")), True).over(back)).withColumn("p1", F.last(F.when(known, F.col("pos")), True).over(ahead))
    t = t.withColumn("t0", F.coalesce(F.last("e", True).over(back), F.lit(0.0))).withColumn("t1", F.last("s", True).over(ahead))
    t = t.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).join(ends, keys)
    first, stop = F.coalesce(F.col("p0") + 1, F.lit(0)), F.coalesce("p1", "n")
    t1 = F.greatest(F.coalesce("t1", "audio_end"), "t0")
    step = (t1 - F.col("t0")) / (stop - first)
    s = F.col("t0") + (F.col("pos") - first) * step
    return t.select(*keys, "pos", F.when(known, F.col("s")).otherwise(s).alias("s"), F.when(known, F.col("e")).otherwise(s + step).alias("e"))


def full_extent(maps: DataFrame, keys: list[str], reach: str, audio_end: str) -> DataFrame:
    """Maps that reach far enough into their track (ALN10): a map that ends early has been pressed together."""
    return maps.where((F.col(audio_end) <= EXTENT_FROM) | (F.col(reach) >= EXTENT * F.col(audio_end)))


def mapped_range(segments: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Transcript range of an ebook range (SCA49): keys, a, b, t_start, t_end; ranges that no aligned segment meets are left out.

    Within a segment both sides advance together, in whole tokens.
    """
    s = rel.span_join(segments.where("kind = 'aligned'"), ranges, keys, "es", "ee", "a", "b", SPAN)
    at = lambda c: F.col("ts") + F.floor((c - F.col("es")) * length("ts", "te") / length("es", "ee")).cast("int")
    return s.groupBy(*keys, "a", "b").agg(F.min(at(F.greatest("a", "es"))).alias("t_start"), F.max(at(F.least("b", "ee"))).alias("t_end"))


def divergence(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments and words of each kind in one row a pair (AGG18)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    only = lambda a, b, *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), length(a, b))), F.lit(0))
    return segments.groupBy(*keys).agg(
        n("aligned").alias("aligned_segments"), n("ebook-only").alias("ebook_segments"), n("trans-only").alias("trans_segments"), n("replace").alias("replace_segments"),
        only("es", "ee", "ebook-only", "replace").alias("ebook_only_words"), only("ts", "te", "trans-only", "replace").alias("trans_only_words"), F.max("ee").alias("ebook_words"), F.max("te").alias("trans_words"),
    )


def longest_differences(segments: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` longest segments of each pair that are not aligned, both sides counted (TOP3)."""
    size = length("es", "ee") + length("ts", "te")
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "es", "ts")
    return segments.where("kind <> 'aligned'").withColumn("size", size).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def directional(summary: DataFrame) -> DataFrame:
    """``summary`` with the shares ``audio_to_ebook`` (quality) and ``ebook_to_audio`` (scope), none below zero (AGG19)."""
    share = lambda words, only: F.coalesce(F.try_divide(F.greatest(F.lit(0), F.col(words) - F.col(only)).cast("double"), F.col(words)), F.lit(0.0))
    return summary.withColumn("audio_to_ebook", share("trans_words", "trans_only_words")).withColumn("ebook_to_audio", share("ebook_words", "ebook_only_words"))


def direction_outliers(segments: DataFrame, keys: list[str], narrated: float = 0.75, covered: float = 0.85) -> DataFrame:
    """Pairs whose narration is little backed by a text that is itself well covered (AGG30): a second reading, or a wrong edition."""
    own = lambda a, b: F.sum(F.when(F.col("kind") == "aligned", length(a, b)).otherwise(0))
    n = segments.groupBy(*keys).agg(own("ts", "te").alias("at"), own("es", "ee").alias("ae"), F.max("te").alias("tn"), F.max("ee").alias("en")).where("tn > 0 and en > 0")
    shares = n.select(*keys, (F.col("at") / F.col("tn")).alias("a2e"), (F.col("ae") / F.col("en")).alias("e2a"))
    return shares.where((F.col("a2e") < narrated) & (F.col("e2a") > covered))


def difference_spans(segments: DataFrame, keys: list[str], most: int = SHOWN_WORDS, form: Callable[[Column], Column] = tx.compare_form) -> DataFrame:
    """Segments as they are shown (ALN14): keys, es, ts, kind, a_words, b_words, a_text, b_text, start_sec.

    ``segments`` also has ``a`` and ``b``, the words of either side, and
    ``start_sec`` and ``end_sec``.  Replaced words that read the same in
    comparable form (``form`` of the joined words) are aligned; text is given
    only where the sides differ; a difference without a time of its own has that
    of the end of the last timed segment before it.
    """
    same = (F.col("kind") == "replace") & (form(F.array_join("a", " ")) == form(F.array_join("b", " ")))
    kind = F.when(same, "aligned").otherwise(F.col("kind"))
    w = Window.partitionBy(*keys).orderBy("es", "ts").rowsBetween(Window.unboundedPreceding, -1)
    timed = lambda c: F.when(F.col(c) > 0, F.col(c))
    reached = F.coalesce(F.last(F.coalesce(timed("end_sec"), timed("start_sec")), True).over(w), F.lit(0.0))
    cut = lambda c: F.when(F.size(c) > most, F.concat(F.array_join(F.slice(c, 1, most), " "), F.lit(" … ["), (F.size(c) - most).cast("string"), F.lit(" more words]"))).otherwise(F.array_join(c, " "))
    d = segments.withColumn("reached", reached).withColumn("kind", kind)
    differs = F.col("kind") != "aligned"
    shown = lambda c: F.when(differs, cut(c)).otherwise("").alias(f"{c}_text")
    at = F.when(differs, F.coalesce(timed("start_sec"), "reached")).otherwise(0.0)
    return d.select(*keys, "es", "ts", "kind", length("es", "ee").alias("a_words"), length("ts", "te").alias("b_words"), shown("a"), shown("b"), at.alias("start_sec"))


def passage_matches(ebook: DataFrame, transcript: DataFrame, keys: list[str], least: float = PASSAGE_NEAR) -> DataFrame:
    """The ebook passage most like each transcript passage of a work, the last of equals, if near enough (ALN11): keys, ti, ei, sim.

    Both sides: keys, i (a whole number, once a key) and v, a vector; a work's passages are those of one book.
    Scores are equal when they are to ``EQUAL_TO`` digits.
    """
    side = lambda df, i, v: df.select(*keys, F.col("i").cast("long").alias(i), F.col("v").alias(v))
    found = nearest(side(transcript, "asked", "q"), side(ebook, "id", "v"), keys, 1, "unit", least=least, places=EQUAL_TO, last=True)
    kind = lambda df, c, name: F.col(c).cast(df.schema["i"].dataType).alias(name)
    return found.select(*keys, kind(transcript, "asked", "ti"), kind(ebook, "id", "ei"), F.col("score").alias("sim"))


def passage_chain(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that advance on both sides (ALN11): the longest increasing chain of each work, which is sequential and goes through pandas once."""
    kinds = dict(matches.dtypes)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ei", "ti"], ascending=[True, False])
        return pdf.iloc[ngrams.longest_chain(pdf["ti"].to_numpy())]

    return matches.groupBy(*keys).applyInPandas(chain, ", ".join(f"`{c}` {kinds[c]}" for c in matches.columns))


def passage_segments(chain: DataFrame, ebook: DataFrame, transcript: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned passages and the gaps between them as segments (ALN11); passages overlap, so starts are moved up to where the one before ended.

    Both sides: keys, i, start and end, places of passages in words.
    """
    side = lambda df, i, a, b: df.select(*keys, F.col("i").alias(i), F.col("start").alias(a), F.col("end").alias(b))
    c = chain.join(side(ebook, "ei", "e0", "e1"), [*keys, "ei"]).join(side(transcript, "ti", "t0", "t1"), [*keys, "ti"])
    w = Window.partitionBy(*keys).orderBy("ti")
    reach = lambda x: F.coalesce(F.max(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("ep", reach("e1")).withColumn("tp", reach("t1")).withColumn("es", F.greatest("e0", "ep")).withColumn("ts", F.greatest("t0", "tp"))
    own = c.where("e1 > es or t1 > ts").select(*keys, "es", F.greatest("e1", "es").alias("ee"), "ts", F.greatest("t1", "ts").alias("te"), F.lit("aligned").alias("kind"))
    before = c.select(*keys, F.col("ep").alias("es"), F.col("es").alias("ee"), F.col("tp").alias("ts"), F.col("ts").alias("te"))
    total = lambda df, name: df.groupBy(*keys).agg(F.max("end").alias(name))
    last = c.groupBy(*keys).agg(F.max("e1").alias("es"), F.max("t1").alias("ts")).join(total(ebook, "en"), keys).join(total(transcript, "tn"), keys)
    tail = last.select(*keys, "es", F.greatest("es", "en").alias("ee"), "ts", F.greatest("ts", "tn").alias("te"))
    gaps = before.unionByName(tail).where("ee > es or te > ts")
    kind = F.when((F.col("ee") > F.col("es")) & (F.col("te") > F.col("ts")), "replace").when(F.col("ee") > F.col("es"), "ebook-only").otherwise("trans-only")
    return own.unionByName(gaps.withColumn("kind", kind))


def route(by_words: DataFrame, keys: list[str], coverage: str, least: float = WORD_COVERAGE) -> DataFrame:
    """By what each pair is aligned (ALN12): words, unless they cover too little; then passages."""
    return by_words.withColumn("method", F.when(F.col(coverage) < least, "embedding").otherwise("anchor"))


def paragraph_report(paragraphs: DataFrame, pairs: DataFrame, keys: list[str], covered: float = 0.8, partial: float = 0.4) -> DataFrame:
    """Paragraphs by how well they are read (AGG21, JOI12): the pair of exactly the same range counts; ``pairs`` has confidence."""
    j = paragraphs.join(pairs, keys, "left")
    c = F.coalesce("confidence", F.lit(0.0))
    return j.withColumn("status", F.when(c >= covered, "covered").when(c >= partial, "partial").otherwise("missing"))


def report_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, share and mean confidence of a paragraph report, and what they say (AGG21)."""
    n = lambda s: F.count_if(F.col("status") == s)
    r = report.groupBy(*keys).agg(F.count("*").alias("paragraphs"), n("covered").alias("covered"), n("partial").alias("partial"), n("missing").alias("missing"), F.coalesce(F.avg(F.when(F.col("status") != "missing", F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    share = F.try_divide(F.col("covered").cast("double"), F.col("paragraphs"))
    said = F.when(share >= 0.95, "full").when(share >= 0.85, "near-complete").when(share >= 0.60, "partial").otherwise("low")
    return r.withColumn("share", share).withColumn("summary", said)


def replaced_chapter(pairs: DataFrame, fresh: DataFrame, keys: list[str], chapter: str) -> DataFrame:
    """Pairs with one chapter's computed anew, and the confidence of the whole taken from it (ALN8).

    ``fresh`` holds rows of the chapters that were aligned again, in the columns of ``pairs`` without confidence, and ``confidence``.
    """
    seen = fresh.select(*keys, chapter).distinct()
    whole = fresh.groupBy(*keys).agg(F.max("confidence").alias("new"))
    rows = pairs.drop("confidence").join(seen, [*keys, chapter], "left_anti").unionByName(fresh.drop("confidence"))
    old = pairs.groupBy(*keys).agg(F.max("confidence").alias("old"))
    return rows.join(old, keys, "left").join(whole, keys, "left").withColumn("confidence", F.coalesce("new", "old")).drop("new", "old")


def chosen_pairs(books: DataFrame, known: DataFrame, work: str) -> DataFrame:
    """Which ebook is aligned with which transcript (ALN5): work, ebook, transcript, rank.

    First the ebook of most authority with the first transcript of the work, then
    the pairs aligned before.  ``books``: work, id, role (ebook, transcript) and
    authority; ``known``: work, ebook, transcript and method.
    """
    best = books.where("role = 'ebook'").groupBy(work).agg(F.min_by("id", F.struct((-F.col("authority")).alias("a"), "id")).alias("ebook"))
    first = books.where("role = 'transcript'").groupBy(work).agg(F.min("id").alias("transcript"))
    main = best.join(first, work).withColumn("rank", F.lit(0))
    of = lambda role, name: books.where(F.col("role") == role).select(work, F.col("id").alias(name))
    others = known.where("method = 'anchor'").select(work, "ebook", "transcript").distinct().join(of("ebook", "ebook"), [work, "ebook"], "left_semi").join(of("transcript", "transcript"), [work, "transcript"], "left_semi")
    others = others.join(main.select(work), work, "left_semi").join(main, [work, "ebook", "transcript"], "left_anti").withColumn("rank", F.lit(1))
    return main.select(work, "ebook", "transcript", "rank").unionByName(others.select(work, "ebook", "transcript", "rank"))
