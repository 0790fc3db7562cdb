"""Chapters of transcripts: from silences, pauses and announcements, over several files, with their text.

Words: doc_id, pos, s, e, w.  Silences: doc_id, a, b (start and end in seconds).
Chapters: doc_id, start_sec, pos (place of the first word) and title.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import titles as tt
from quire.operators import relational as rel

#: Seconds of silence that part chapters and paragraphs, reach of a silence's edge, and distance within which a part swallows a chapter.
CHAPTER_SILENCE, PARAGRAPH_SILENCE, NEAR_EDGE, PART_REACH = 3.0, 0.6, 1.5, 5.0
#: Share of a book by which its first chapter has started, length from which chapters are counted, and seconds that have one at least.
FIRST_BY, COUNTED_FROM, ONE_EACH = 0.2, 10_800.0, 5_400.0
#: Announced chapters, and the share of the book they reach, that stand for themselves; books under an hour need only the first.
STRONG_RUN, STRONG_REACH, SHORT_BOOK = 5, 0.6, 3_600.0
#: Fewest chapters from silences, fewest and most from pauses, and the start from which a prelude is put ahead.
SILENCES_LEAST, PAUSES_LEAST, PAUSES_MOST, PRELUDE_SEC, PRELUDE_WORDS = 3, 3, 80, 60.0, 100
#: Confidence of a chapter that was only inferred.
INFERRED = 0.4


def by_doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def starts(words: DataFrame, silences: DataFrame | None = None) -> DataFrame:
    """Words at which a chapter can start, and the last of each text, from one deal of the words: doc_id, pos, s, first, silent, paused, last, reach.

    ``first`` is the word of least place, ``silent`` the first at or after the end
    of a long silence, ``paused`` one behind a long gap between words; ``reach`` is
    the latest end so far.  Ends of silences lie among the words in order of time,
    and ahead of them in order of place, so nothing has to be looked up.
    """
    both = words.select("doc_id", "pos", "s", "e", F.col("s").alias("t"), F.lit(1).alias("side"))
    if silences is not None:
        none = lambda c: F.lit(None).cast(words.schema[c].dataType).alias(c)
        ends = silences.where(F.col("b") - F.col("a") >= CHAPTER_SILENCE)
        both = both.unionByName(ends.select("doc_id", none("pos"), none("s"), none("e"), F.col("b").alias("t"), F.lit(0).alias("side")))
        both = both.withColumn("silent", F.coalesce(F.lag("side").over(by_doc("t", "side", "pos")) == 0, F.lit(False)))
    else:
        both = both.withColumn("silent", F.lit(False))
    place = by_doc("side", "pos")
    gap = F.col("s") - F.lag("e").over(place)
    # Only gaps near the limit have to be rounded.
    paused = F.when(gap > CHAPTER_SILENCE - 0.01, F.round(gap, 3) >= CHAPTER_SILENCE).otherwise(F.lit(False))
    both = both.withColumn("first", F.coalesce(F.lag("side").over(place), F.lit(0)) == 0).withColumn("paused", paused).withColumn("last", F.lead("side").over(place).isNull())
    both = both.withColumn("reach", F.max("e").over(rel.up_to_here(["doc_id"], "side", "pos")))
    return both.where("side = 1 and (first or silent or paused or last)").select("doc_id", "pos", "s", "first", "silent", "paused", "last", "reach")


def inferred(found: DataFrame) -> DataFrame:
    """What ``starts`` tell (SEG8, SEG10, WIN1): doc_id, method, start_sec, pos, number; and a row more a text with its ``duration`` alone.

    The method silences has the first word and those after long silences, pauses the first word and those after long gaps between words.
    """
    here = rel.up_to_here(["doc_id"], "pos")
    at = F.when(F.col("first"), 0.0).otherwise(F.col("s")).alias("start_sec")
    numbered = lambda c: F.count(F.when(c, 1)).over(here).cast("int")
    kinds = {"silences": F.expr("first or silent"), "pauses": F.expr("first or paused")}
    f = found.select("doc_id", "pos", "last", "reach", at, *[c.alias(f"is_{m}") for m, c in kinds.items()], *[numbered(c).alias(m) for m, c in kinds.items()])
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = dict(found.dtypes)
    rows = [F.when(F.col(f"is_{m}"), F.struct(F.lit(m).alias("method"), "start_sec", "pos", F.col(m).alias("number"), none("duration", kind["reach"]))) for m in kinds]
    rows.append(F.when(F.col("last"), F.struct(none("method", "string"), none("start_sec", "double"), none("pos", kind["pos"]), none("number", "int"), F.col("reach").alias("duration"))))
    return f.select("doc_id", F.inline(F.array_compact(F.array(*rows))))


def silence_chapters(words: DataFrame, silences: DataFrame) -> DataFrame:
    """A chapter at the first word, and at the first word after each long silence (SEG8): doc_id, pos, start_sec, number."""
    return inferred(starts(words, silences)).where("method = 'silences'").select("doc_id", "pos", "start_sec", "number")


def silence_parts(words: DataFrame, silences: DataFrame) -> DataFrame:
    """Spoken parts whose word lies near the end of a long silence (SEG8): doc_id, pos, start_sec, number; a number counts once.

    The silence tells a part from a year or the like, so digits may be any whole number.
    """
    n = words.withColumn("k", tx.normalize_word("w")).withColumn("next", F.lead("w").over(by_doc("pos")))
    following = tx.normalize_word("next")
    digits = F.when(following.rlike("^[0-9]+$"), following.try_cast("int"))
    said = n.where("k = 'part'").withColumn("number", F.coalesce(tx.number_word(following), digits)).where("number > 0").select("doc_id", "pos", F.col("s").alias("start_sec"), "number")
    ends = silences.where(F.col("b") - F.col("a") >= CHAPTER_SILENCE).select("doc_id", F.col("b").alias("end"))
    # An end within reach lies in the bucket of the word or next to it.
    place = lambda c: F.floor(F.col(c) / (2 * NEAR_EDGE))
    reached = said.withColumn("b", F.explode(F.array(place("start_sec") - 1, place("start_sec"), place("start_sec") + 1)))
    near = reached.join(ends.withColumn("b", place("end")), ["doc_id", "b"]).where(F.abs(F.col("start_sec") - F.col("end")) <= NEAR_EDGE)
    return near.groupBy("doc_id", "number").agg(F.min("pos").alias("pos"), F.min_by("start_sec", "pos").alias("start_sec")).select("doc_id", "pos", "start_sec", "number")


def with_parts(chapters: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts and chapters in order of time (SEG8): ``src`` is part or chapter; a chapter right after a part goes into it."""
    both = parts.withColumn("src", F.lit("part")).unionByName(chapters.select(parts.columns).withColumn("src", F.lit("chapter")))
    w = by_doc("start_sec", F.desc("src"))
    swallowed = (F.col("src") == "chapter") & (F.lag("src").over(w) == "part") & (F.col("start_sec") - F.lag("start_sec").over(w) < PART_REACH)
    return both.withColumn("in", F.coalesce(swallowed, F.lit(False))).where(~F.col("in")).drop("in")


def pause_chapters(words: DataFrame) -> DataFrame:
    """Chapters at the first word and at the words after long gaps between words (SEG10, WIN1)."""
    return inferred(starts(words)).where("method = 'pauses'").select("doc_id", "pos", "start_sec", "number")


def reliable_titles(chapters: Column, duration: Column) -> Column:
    """Whether a book's own chapters can be kept (SCA40): no title twice, an early first one, and enough of them for a long book."""
    n = F.size(chapters)
    titles = F.array_distinct(F.array_compact(F.transform(chapters, lambda x: F.lower(x["title"]))))
    early = (duration <= 0) | (F.array_min(F.transform(chapters, lambda x: x["start_sec"])) <= duration * FIRST_BY)
    return (n > 0) & (n == F.size(titles)) & early & ((duration <= COUNTED_FROM) | (n >= F.floor(duration / ONE_EACH)))


def strong_run(chapters: Column, duration: Column) -> Column:
    """Whether a book's announced chapters are many and reach far (SEG10)."""
    last = F.array_max(F.transform(chapters, lambda x: x["start_sec"]))
    return (F.size(chapters) >= STRONG_RUN) & ((duration < SHORT_BOOK) | (last >= STRONG_REACH * duration))


def chapter_cascade(sources: DataFrame) -> DataFrame:
    """Chapters of each book from the best source it has (SEG10): doc_id, start_sec, pos, title, method.

    Its own if reliable, else announced ones if strong, else three or more from
    silences, else three to eighty from pauses, else one for the whole; a book
    whose first chapter starts late gets a prelude.  ``sources``: doc_id,
    method (supplied, announced, silences or pauses), start_sec, pos, title, and
    duration, which is null there; one row more a book has its duration alone.

    Chapters of a book are few, so they meet in one row, in which the choice is made.
    """
    of = lambda method: F.collect_list(F.when(F.col("method") == method, F.struct("start_sec", "pos", "title", "method"))).alias(method)
    books = sources.where("doc_id is not null").groupBy("doc_id").agg(F.max("duration").alias("duration"), *[of(m) for m in ("supplied", "announced", "silences", "pauses")])
    length = F.col("duration")
    one = lambda title, method: F.array(F.struct(F.lit(0.0).alias("start_sec"), F.lit(0).alias("pos"), F.lit(title).alias("title"), method.alias("method")))
    chosen = (
        F.when(reliable_titles(F.col("supplied"), length), F.col("supplied")).when(strong_run(F.col("announced"), length), F.col("announced"))
        .when(F.size("silences") >= SILENCES_LEAST, F.col("silences")).when(F.size("pauses").between(PAUSES_LEAST, PAUSES_MOST), F.col("pauses"))
        .when(length.isNotNull(), one("Full Transcript", F.lit("whole")))
    )
    taken = books.select("doc_id", chosen.alias("c"))
    late = (F.array_min(F.transform("c", lambda x: x["start_sec"])) > PRELUDE_SEC) | (F.array_min(F.transform("c", lambda x: x["pos"])) > PRELUDE_WORDS)
    whole = F.concat("c", F.when(late, one("Prelude", F.get("c", F.lit(0))["method"])).otherwise(F.slice("c", 1, 0)))
    return taken.select("doc_id", F.inline(whole)).select("doc_id", "start_sec", "pos", "title", "method")


def reconciled(chapters: DataFrame) -> DataFrame:
    """Titles whose number came before get the next free one (WIN23): what counts is only that no number comes twice.

    A book's chapters are few and their order matters, so each book's titles are a list; a batch has the lists of many books.
    """
    named = re.compile(r"(?i)^\s*(chapter|part|book)\s+(\d{1,3})\b")

    def fix(titles: list[str | None]) -> list[str | None]:
        used, highest, out = set(), 0, []
        for title in titles:
            found = named.match(title) if title is not None else None
            if found:
                n = int(found[2])
                if n in used:
                    n = highest + 1
                    title = f"{found[1]} {n}{title[found.end():]}"
                used.add(n)
                highest = max(highest, n)
            out.append(title)
        return out

    @F.pandas_udf("array<string>")
    def fixed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([fix(list(x)) for x in lists], dtype=object)

    row = F.struct("start_sec", "pos", *[c for c in chapters.columns if c not in ("doc_id", "start_sec", "pos")])
    listed = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("titles", fixed(F.transform("rows", lambda x: x["title"])))
    each = listed.select("doc_id", F.explode(F.arrays_zip("rows", "titles")).alias("x"))
    return each.select(*["doc_id" if c == "doc_id" else F.col("x.titles").alias(c) if c == "title" else F.col(f"x.rows.{c}").alias(c) for c in chapters.columns])


def gap_starts(silences: list[float], start: float, end: float, missing: int) -> list[float]:
    """Starts of chapters that were not heard between two others (WIN24): the silences nearest to even places, in order; even places where none is left."""
    inside = sorted(t for t in silences if start < t < end)
    out, reached = [], start
    for k in range(missing):
        even = start + (k + 1) / (missing + 1) * (end - start)
        ahead = [t for t in inside if t > reached]
        at = even
        if ahead:
            at = reached = min(ahead, key=lambda t: (abs(t - even), t))
        if out and at <= out[-1]:
            at = out[-1] + 1.0
        out.append(at)
    return out


def filled_numbers(chapters: DataFrame, silences: DataFrame) -> DataFrame:
    """Announced chapters with those between them that were not heard (WIN24): doc_id, number, start_sec, confidence.

    ``chapters`` in the same columns; long silences say where the others start.
    """
    quiet = silences.where(F.col("b") - F.col("a") >= CHAPTER_SILENCE).groupBy("doc_id").agg(F.sort_array(F.collect_list("b")).alias("ends"))
    j = chapters.join(quiet, "doc_id", "left")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sec")
        ends = pdf["ends"].iloc[0]
        ends = [] if ends is None else list(ends)
        rows = list(zip(pdf["number"], pdf["start_sec"], pdf["confidence"], strict=True))
        out = rows[:1]
        for (n0, s0, _), (n1, s1, c1) in zip(rows, rows[1:], strict=False):
            out += [(n0 + k, at, INFERRED) for k, at in enumerate(gap_starts(ends, s0, s1, max(0, n1 - n0 - 1)), 1)]
            out.append((n1, s1, c1))
        found = pd.DataFrame(out, columns=["number", "start_sec", "confidence"])
        found.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return found

    return j.groupBy("doc_id").applyInPandas(fill, "doc_id long, number int, start_sec double, confidence double")


def in_files(chapters: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Chapters on a work's clock as places in its files (SEG7): key, number, n, local_start, local_end; each stays in the file it starts in.

    ``files``: key, n, start_sec, duration; ``chapters``: key, number, start_sec, end_sec.  Every chapter of a file is kept.
    """
    spans = files.select(key, "n", F.col("start_sec").alias("base"), (F.col("start_sec") + F.col("duration")).alias("stop"))
    j = rel.interval_join(chapters, spans, [key], "start_sec", "base", "stop", 60.0)
    local = lambda c: F.col(c) - F.col("base")
    return j.select(key, "number", "n", local("start_sec").alias("local_start"), F.least(local("end_sec"), local("stop")).alias("local_end"))


def chapter_texts(words: DataFrame, starts: DataFrame) -> DataFrame:
    """Text of each chapter with a blank line where a sentence ends before a pause (SEG12, SEG13): doc_id, number, words, text.

    Words ahead of the first chapter fall away; the last chapter has all that follow.
    """
    # Words and starts are together before anything is asked of them, so that words are dealt once; a start has no place and is ahead of all words there.
    none = lambda c: F.lit(None).cast(words.schema[c].dataType).alias(c)
    both = words.select("doc_id", "pos", "s", "e", "w", F.lit(None).cast(starts.schema["number"].dataType).alias("number"), F.lit(1).alias("side"))
    both = both.unionByName(starts.select("doc_id", none("pos"), F.col("start_sec").alias("s"), none("e"), none("w"), "number", F.lit(0).alias("side")))
    cut = (F.lead("s").over(by_doc("side", "pos")) - F.col("e") >= PARAGRAPH_SILENCE) & tx.ends_sentence("w")
    owned = both.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("number", F.last("number", True).over(rel.up_to_here(["doc_id"], "s", "side"))).where("side = 1 and number is not null")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat("w", F.when(F.col("cut"), "\n\n").otherwise(" ")).alias("w"))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(listed, lambda x: x["w"]), ""), r"^\s+|\s+$", ""))
    return owned.groupBy("doc_id", "number").agg(F.count("*").alias("words"), text.alias("text"))


def retitled(texts: DataFrame) -> DataFrame:
    """``texts`` with a title: the number, and the title that was spoken after it where it can be told (SEG13, SCA18)."""
    spoken = tt.spoken_title(F.col("text"))
    return texts.withColumn("title", F.when(spoken != "", F.concat(F.col("number").cast("string"), F.lit(". "), spoken)).otherwise(F.concat(F.lit("Chapter "), F.col("number").cast("string"))))


def relabelled_segments(segments: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Transcript segments numbered within the part that holds their middle (OTH3): key, idx, part, within.

    ``segments``: key, idx, start_sec, end_sec; ``parts``: key, n (from 1), start_sec.
    """
    middle = F.when(F.col("end_sec") > F.col("start_sec"), (F.col("start_sec") + F.col("end_sec")) / 2).otherwise(F.col("start_sec"))
    found = rel.as_of(segments.withColumn("mid", middle), parts.select(key, F.col("start_sec").alias("at"), F.col("n").alias("part")), [key], "mid", "at", ["part"])
    part = F.coalesce("part", F.lit(1))
    return found.withColumn("part", part).withColumn("within", F.row_number().over(Window.partitionBy(key, "part").orderBy("idx"))).select(key, "idx", "part", "within")


def phrase_places(words: DataFrame, phrase: list[str]) -> DataFrame:
    """Where a phrase is spoken, of the books where that is once (OTH1): doc_id, pos, end_sec, next_sec.

    The comparable words of ``phrase`` meet equal ones one by one: a place where all do is where their starts agree.
    """
    spark = words.sparkSession
    wanted = spark.createDataFrame(list(enumerate(phrase)), "i int, k string")
    met = words.select("doc_id", "pos", tx.normalize_word("w").alias("k")).join(F.broadcast(wanted), "k").groupBy("doc_id", (F.col("pos") - F.col("i")).alias("first")).agg(F.count("*").alias("n")).where(F.col("n") == len(phrase))
    once = met.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("first").alias("pos")).where("hits = 1").select("doc_id", "pos")
    at = lambda shift, c, name: words.select("doc_id", (F.col("pos") - shift).alias("pos"), F.col(c).alias(name))
    return once.join(at(len(phrase) - 1, "e", "end_sec"), ["doc_id", "pos"]).join(at(len(phrase), "s", "next_sec"), ["doc_id", "pos"])


def replaced_spans(words: DataFrame, fresh: DataFrame, spans: DataFrame) -> DataFrame:
    """Words with those that start in a span replaced by fresh ones, in order of time (OTH5, SET2, TOP7): doc_id, pos, s, e, w.

    ``spans``: doc_id, a, b, few a book; fresh words are on the same clock.
    """
    cut = words.join(spans, (words["doc_id"] == spans["doc_id"]) & (F.col("s") >= F.col("a")) & (F.col("s") < F.col("b")), "left_anti").select("doc_id", "s", "e", "w")
    both = cut.unionByName(fresh.select("doc_id", "s", "e", "w"))
    return both.withColumn("pos", F.row_number().over(by_doc("s", "e", "w")) - 1).select("doc_id", "pos", "s", "e", "w")


def layout_breaks(folder: DataFrame, recorded: DataFrame, key: str, slack: float = 1.0) -> DataFrame:
    """The first place at which a folder's files are not those recorded (OTH4): key, n, reason: count, order, duration or offset.

    Both: key, n, name, duration, start_sec.
    """
    size = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    uneven = size(folder, "x").join(size(recorded, "y"), key).where("x <> y").select(key, F.lit(0).alias("n"), F.lit("count").alias("reason"))
    r = recorded.select(key, "n", F.col("name").alias("r_name"), F.col("duration").alias("r_duration"), F.col("start_sec").alias("r_start"))
    j = folder.join(r, [key, "n"]).join(uneven.select(key), key, "left_anti")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > slack
    reason = F.when(F.col("name") != F.col("r_name"), "order").when(off("duration", "r_duration"), "duration").when(off("start_sec", "r_start"), "offset")
    broken = j.withColumn("reason", reason).where("reason is not null").groupBy(key).agg(F.min("n").alias("n"), F.min_by("reason", "n").alias("reason"))
    return uneven.unionByName(broken)


def effective_gaps(words: DataFrame, silences: DataFrame, slack: float = 0.15) -> DataFrame:
    """Pause before each word (SCA39): doc_id, pos, gap: the gap between words or the longest silence that starts there, whichever is longer."""
    w = by_doc("pos")
    g = words.withColumn("prev", F.lag("e").over(w)).where("prev is not null").withColumn("from", F.col("prev") - slack)
    width = 30.0
    spread = g.select("doc_id", "pos", "from", F.col("e").alias("to"), F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("e") / width))).alias("bucket"))
    q = silences.select("doc_id", "a", (F.col("b") - F.col("a")).alias("d"), F.floor(F.col("a") / width).alias("bucket"))
    longest = spread.join(q, ["doc_id", "bucket"]).where((F.col("a") > F.col("from")) & (F.col("a") < F.col("to"))).groupBy("doc_id", "pos").agg(F.max("d").alias("d"))
    between = F.greatest(F.col("s") - F.col("prev"), F.lit(0.0))
    return g.join(longest, ["doc_id", "pos"], "left").select("doc_id", "pos", F.greatest(between, F.coalesce("d", F.lit(0.0))).alias("gap"))
