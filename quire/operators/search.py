"""Search in books and answers from passages: hits, scopes, fallbacks and times of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import relational as rel
from quire.operators.nearest import nearest

#: Characters shown around a hit, hits collected for each one asked for, and seconds within which two books' hits are one place.
AROUND, RAW_FACTOR, SAME_PLACE = 50, 4, 1.5
#: Passages asked for in a whole book, in a narrower scope, and given to an answer.
WHOLE_K, NARROW_K, ANSWER_K = 8, 24, 8
#: Words of a bucket in which spans of a book meet, about the length of a chunk.
SPAN = 256


def hits(chapters: DataFrame, keys: list[str], text: str, needle: str) -> DataFrame:
    """Every place of a phrase, in either case, none overlapping the one before (RET1): keys, hit (from 0), char_at (from 1), word, snippet.

    The text is cut at the phrase; a hit starts where the parts before it and the phrases between them end.
    """
    low, size = needle.lower(), len(needle)
    found = chapters.where(F.contains(F.lower(text), F.lit(low))).withColumn("parts", F.split(F.lower(text), rf"\Q{low}\E", -1))
    sizes = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.length(p))
    ends = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), lambda acc, n: F.struct((acc["n"] + n + size).alias("n"), F.concat(acc["at"], F.array(acc["n"] + n + 1)).alias("at")))["at"]
    each = found.select(*keys, text, F.posexplode(ends).alias("hit", "char_at"))
    return each.select(*keys, "hit", "char_at", tx.word_count(F.substr(text, F.lit(1), F.col("char_at") - 1)).alias("word"), tx.snippet(F.col(text), F.col("char_at"), F.lit(size), AROUND).alias("snippet"))


def ranked_hits(found: DataFrame, shown_first: Column, order: list[str], limit: int) -> DataFrame:
    """The first hits of each work, those of the displayed source ahead (RET1, SET1); four times as many as asked for, so that doubles can fall away."""
    w = Window.partitionBy("work").orderBy(F.when(shown_first, 0).otherwise(1), *order)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= RAW_FACTOR * limit)


def distinct_places(found: DataFrame, limit: int) -> DataFrame:
    """Hits without those of another book at the same time (JOI19): of two within a second and a half the one that is kept first stays.

    Whether a hit stays depends on those kept before it, so the hits of a work
    (at most four times the limit) are gone through in order, in one aggregate.
    ``found``: work, book, sec, place and what else is to be kept.
    """
    row = F.struct("place", *[c for c in found.columns if c not in ("work", "place")])
    listed = found.groupBy("work").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    same = lambda h: lambda k: (k["book"] != h["book"]) & (F.abs(k["sec"] - h["sec"]) < SAME_PLACE)
    kind = f"array<{dict(listed.dtypes)['rows'].removeprefix('array<')[:-1]}>"
    timed = lambda acc: F.filter(acc, lambda k: k["sec"] > 0)
    kept = F.aggregate("rows", F.array().cast(kind), lambda acc, h: F.when((h["sec"] > 0) & F.exists(timed(acc), same(h)), acc).otherwise(F.concat(acc, F.array(h))))
    return listed.select("work", F.posexplode(F.slice(kept, 1, limit)).alias("rank", "h")).select("work", (F.col("rank") + 1).alias("rank"), "h.*")


def shared_limit(found: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first hits over all works in their order (RET2, TOP6)."""
    return found.orderBy(*order).limit(limit)


def scope_of(override: Column, mode: Column, reader_book: Column, reader_chapter: Column) -> Column:
    """Scope of a question (FIL9): what was pointed at, else the whole book if asked for, else up to where the reader is, else the whole book."""
    reading = (F.coalesce(reader_book, F.lit(0)) != 0) & (F.coalesce(reader_chapter, F.lit(-1)) >= 0)
    return F.when(override.isin("paragraph", "chapter"), override).when(mode == "book", "book").when(reading, "up_to_chapter").otherwise("book")


def in_scope(chunks: DataFrame, asked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Chunks that each question may see (FIL8): question and the columns of ``chunks``.

    ``asked``: question, scope, book, chapter, paragraph; ``chunks``: book,
    chapter, start_word, end_word; ``paragraphs``: book, chapter, paragraph,
    word_start, word_end.  A paragraph that is not known counts as its chapter.
    """
    q = asked.withColumnRenamed("chapter", "q_chapter").join(paragraphs.withColumnsRenamed({"chapter": "q_chapter"}), ["book", "q_chapter", "paragraph"], "left")
    j = chunks.join(q, "book")
    same = F.col("chapter") == F.col("q_chapter")
    within = F.col("word_start").isNull() | (F.col("end_word") > F.col("word_start")) & (F.col("start_word") < F.col("word_end"))
    fine = F.when(F.col("scope") == "book", F.lit(True)).when(F.col("scope") == "up_to_chapter", F.col("chapter") <= F.col("q_chapter")).when(F.col("scope") == "chapter", same).otherwise(same & within)
    return j.where(fine).select("question", *chunks.columns)


def passages(scored: DataFrame, by_word: DataFrame, scoped: DataFrame, keys: list[str]) -> DataFrame:
    """Passages for each question (RET5): keys and rank.

    The nearest by vector, or where there is none those with the keyword, cut to
    the scope; if nothing is left, the scope itself; texts that are one phrase
    over and over fall away; at most eight.  ``scored``: keys and score;
    ``by_word``: keys and place; ``scoped``: keys, place and tokens.
    """
    q, rest = keys[0], keys[1:]
    has = scored.select(q).distinct()
    ranked = scored.select(*keys, F.lit(0).alias("tier"), (-F.col("score")).alias("o")).unionByName(by_word.join(has, q, "left_anti").select(*keys, F.lit(1).alias("tier"), F.col("place").cast("double").alias("o")))
    kept = ranked.join(scoped.select(*keys), keys, "left_semi")
    left = scoped.join(kept.select(q).distinct(), q, "left_anti").select(*keys, F.lit(2).alias("tier"), F.col("place").cast("double").alias("o"))
    good = scoped.where(~tx.is_pure_repetition(F.col("tokens"))).select(*keys)
    w = Window.partitionBy(q).orderBy("tier", "o", *rest)
    return kept.unionByName(left).join(good, keys, "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ANSWER_K).select(*keys, "rank")


def scope_heads(rows: DataFrame, scope: list[str], good: Column) -> DataFrame:
    """The rows of each scope that can come into an answer by their place: enough for one without the row that asks.

    Of the good rows the first ``ANSWER_K`` and one more; the first two of any kind tell whether there is one at all.
    ``rows``: scope, id and place.  What a question may see is then met without every pair of question and row.
    """
    order = F.asc("place"), F.asc("id")
    first = rel.top_by(rows, scope, 2, *order).unionByName(rel.top_by(rows.where(good), scope, ANSWER_K + 1, *order))
    return first.drop("rank").dropDuplicates([*scope, "id"])


def turn_passages(retrieved: DataFrame, scoped: DataFrame, named: DataFrame, asked: DataFrame, place: list[str]) -> DataFrame:
    """Passages for a turn of a conversation (RET9, OTH29): question, book, chapter, place, rank, named.

    Those retrieved, in their order, then all of the chapters that the question
    names and its scope lets it see, in the order of the text, none twice.  A question
    about one chapter or paragraph gets no others.  ``retrieved``: question, book,
    chapter, place and rank from 1; ``scoped``: the same without rank; ``named``:
    question and idx of chapters; ``asked``: question and scope.
    """
    row = ["question", "book", "chapter", *place]
    wide = asked.where(~F.col("scope").isin("chapter", "paragraph")).select("question")
    wanted = named.join(wide, "question", "left_semi").select("question", F.col("idx").alias("chapter")).distinct()
    more = scoped.join(wanted, ["question", "chapter"]).select(*row).join(retrieved.select(*row), row, "left_anti")
    had = retrieved.groupBy("question").agg(F.max("rank").alias("had"))
    order = Window.partitionBy("question").orderBy("book", "chapter", *place)
    later = more.join(had, "question", "left").select(*row, (F.coalesce("had", F.lit(0)) + F.row_number().over(order)).alias("rank"), F.lit(True).alias("named"))
    return retrieved.select(*row, "rank", F.lit(False).alias("named")).unionByName(later)


def turn_states(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """What a turn can be answered from (RET9, RET12): question and state.

    ``passages`` or, with none, ``history`` where the conversation has earlier turns;
    ``not_started`` where a first question is asked within what was read and nothing
    was read yet; ``refused`` for spoken answers when only the text itself may be
    given; else ``none``.  ``asked``: question, scope, chapter, history (earlier
    turns), spoken and extract_only.
    """
    found = passages.select("question").distinct().withColumn("found", F.lit(True))
    unread = (F.col("scope") == "up_to_chapter") & (F.col("chapter") <= 0)
    state = F.when(F.col("spoken") & F.col("extract_only"), "refused").when(F.col("found"), "passages").when(F.col("history") > 0, "history").when(unread, "not_started").otherwise("none")
    return asked.join(found, "question", "left").select("question", state.alias("state"))


def citation_times(chunks: DataFrame, direct: DataFrame, segments: DataFrame, pairs: DataFrame, spoken: DataFrame, keys: list[str]) -> DataFrame:
    """When each chunk is spoken (RET7): keys, start_sec, end_sec, method; the first of three ways that gives a time.

    A transcript's chunk by its own words (``direct``: book, words); an ebook's by
    aligned segments, in proportion; else by pairs of word ranges and the words'
    times.  ``chunks``: book, keys, a, b (words); ``segments``: book, es, ee,
    start_sec, end_sec; ``pairs``: book, fs, fe, ts, te; ``spoken``: book, pos, s, e.
    """
    at = lambda c, name: spoken.select("book", F.col("pos").alias(c), F.col("s" if name == "start_sec" else "e").alias(name))
    timed = lambda df: df.join(at("x", "start_sec"), ["book", "x"]).join(at("y", "end_sec"), ["book", "y"]).select(*keys, "start_sec", "end_sec")
    own = chunks.join(direct, "book").where("a < words").withColumn("x", F.col("a")).withColumn("y", F.least("b", "words") - 1)
    met = rel.span_join(chunks, segments, ["book"], "a", "b", "es", "ee", SPAN)
    part = lambda x: F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * (x - F.col("es")) / (F.col("ee") - F.col("es"))
    line = met.groupBy(*keys).agg(F.min(part(F.greatest("a", "es"))).alias("start_sec"), F.max(part(F.least("b", "ee"))).alias("end_sec"))
    paired = rel.span_join(chunks, pairs, ["book"], "a", "b", "fs", "fe", SPAN).groupBy("book", *[k for k in keys if k != "book"]).agg(F.min("ts").alias("x"), (F.max("te") - 1).alias("y"))
    out = None
    for df, method in ((timed(own), "direct"), (line, "segments"), (timed(paired), "pairs")):
        rows = df.withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows.join(out.select(*keys), keys, "left_anti"))
    return out


def nearest_in_book(rows: DataFrame, asked: DataFrame, k: int, book: str, id_: str, vector: str) -> DataFrame:
    """The ``k`` nearest rows of each question's book (RET4): question, id, score, rank; vectors of another length are passed over.

    ``asked``: question (a whole number, once only), book, q.
    """
    q = asked.select(book, F.size("q").alias("__size"), F.col("question").cast("long").alias("asked"), "q")
    r = rows.select(book, F.size(vector).alias("__size"), F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    found = nearest(q, r, [book, "__size"], k, "cosine")
    return found.select(F.col("asked").cast(asked.schema["question"].dataType).alias("question"), F.col("id").cast(rows.schema[id_].dataType).alias(id_), "score", "rank")


def chapter_refs(questions: DataFrame, id_: str, text: str, numbers: DataFrame, last: Column) -> DataFrame:
    """Chapters that questions name (SCA17): id, idx; numbers in digits or words, through the titles' numbers, else one less; each once, if it exists.

    ``numbers``: number, idx.
    """
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    digits = F.transform(found(r"(?i)\b(?:chapter|chap|ch\.?)\s+([0-9]{1,3})\b"), lambda x: x.try_cast("int"))
    spelled = F.transform(found(r"(?i)\b(?:chapter|chap|ch\.?)\s+([a-z]+(?:[\s\-]+(?:one|two|three|four|five|six|seven|eight|nine))?)\b"), lambda x: F.lower(F.regexp_replace(x, r"[\s\-]+", " ")))
    d = questions.select(id_, F.explode(digits).alias("number"))
    s = questions.select(id_, F.explode(spelled).alias("w")).select(id_, tx.number_word("w").alias("number"))
    named = d.unionByName(s).where("number > 0").distinct().join(F.broadcast(numbers), "number", "left")
    return named.select(id_, F.coalesce("idx", F.col("number") - 1).cast("int").alias("idx")).where((F.col("idx") >= 0) & (F.col("idx") <= last)).distinct()


def named_entities(texts: DataFrame, names: DataFrame, work: str, most: int = 2, among: int = 8, least: int = 4) -> DataFrame:
    """Characters that a reader has met (RET11): the first two of a work's eight leading ones whose name, or another of it, stands in what was read.

    ``texts``: work and content, a row for each text read so far; ``names``: work, rank, name, aliases.
    Each text is looked through by itself, so a work of any size is shared by tasks.
    """
    top = names.where(F.col("rank") <= among).select(work, "rank", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("called")).where(F.length("called") >= least)
    met = top.join(texts, work).where(F.contains("content", F.col("called"))).select(work, "rank", "name").distinct()
    return met.withColumn("n", F.row_number().over(Window.partitionBy(work).orderBy("rank"))).where(F.col("n") <= most).select(work, "rank", "name")


def embedded(chunks: DataFrame, vector: str, embed, text: str) -> DataFrame:
    """``chunks`` with the missing vectors made by ``embed``, a column function over texts (RET10); vectors that are there stay."""
    return chunks.withColumn(vector, F.coalesce(F.col(vector), embed(F.when(F.col(vector).isNull(), F.col(text)))))
