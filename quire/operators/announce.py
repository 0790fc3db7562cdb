"""How many words at the start of a chapter are the narrator's announcement of its title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.titles import let, title_number
from quire.operators import relational as rel

#: Words looked at, the pause that ends a title, and how far before the end of a word a silence may start.
PEEK, TITLE_PAUSE, SLACK = 20, 0.6, 0.15
#: Sections that a number follows, and those whose name is the whole announcement.
NUMBERED = ("chapter", "part", "book")
NAMED = ("section", "prologue", "epilogue", "foreword", "afterword", "introduction", "preface", "dedication", "acknowledgments", "acknowledgements")


def announcement_length(words: Column, silences: Column) -> Column:
    """Words of the announcement (SCA19), 0 where there is none.

    ``words``: array of (w, s, e) from the chapter's first word on; ``silences``:
    array of (a, d), start and length, in any order.  After a named section one
    word is the announcement; after a number, with or without "Chapter", it goes on
    to the first word that ends a sentence or has a long pause behind it, and if
    there is none within twenty words it is the number alone.
    """

    def measured(w: Column) -> Column:
        n = F.size(w)
        text = lambda i: F.trim(F.get(w, i)["w"])
        first = F.lower(F.regexp_replace(text(F.lit(0)), "[.,!?:;]+$", ""))
        number = let(F.transform(F.slice(w, 1, 2), lambda x: F.trim(x["w"])), title_number)
        body = F.when(first.isin(*NUMBERED), 2).when(number["n"].isNotNull(), number["used"])

        def pause(j: Column) -> Column:
            here, after = F.get(w, j), F.get(w, j + 1)
            heard = F.filter(silences, lambda q: (q["a"] > here["e"] - SLACK) & (q["a"] < after["e"]))
            longest = F.aggregate(heard, F.lit(0.0), lambda most, q: F.greatest(most, q["d"]))
            return F.greatest(after["s"] - here["e"], longest)

        def judged(start: Column) -> Column:
            ends = F.filter(F.when(start < n, F.sequence(start, n - 1)), lambda j: text(j).rlike("[.!?]$") | (j + 1 < n) & (pause(j) >= TITLE_PAUSE))
            return F.when(start.isNull() | (start > n), 0).otherwise(F.coalesce(F.get(ends, 0) + 1, start))

        return F.when(n < 2, 0).when(first.isin(*NAMED), 1).otherwise(let(body, judged))

    return F.coalesce(let(F.slice(words, 1, PEEK), measured), F.lit(0)).cast("int")


def announcements(starts: DataFrame, words: DataFrame, silences: DataFrame, keys: list[str]) -> DataFrame:
    """The announcement of every chapter (SCA19): keys, start, length.

    ``starts``: keys and start, the place of a chapter's first word; ``words``:
    keys, pos, w, s, e; ``silences``: keys, a, b.  A chapter has the twenty words
    from its start on, and the silences that start among them.
    """
    spans = starts.select(*keys, "start").distinct().withColumn("stop", F.col("start") + PEEK)
    near = rel.interval_join(words.select(*keys, "pos", "w", "s", "e"), spans, keys, "pos", "start", "stop", PEEK)
    told = near.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "s", "e"))).alias("words"), (F.min("e") - SLACK).alias("since"), F.max("e").alias("until"))
    quiet = rel.interval_join(silences.select(*keys, "a", (F.col("b") - F.col("a")).alias("d")), told.select(*keys, "start", "since", "until"), keys, "a", "since", "until", 30.0)
    quiet = quiet.groupBy(*keys, "start").agg(F.collect_list(F.struct("a", "d")).alias("quiet"))
    none = F.array().cast("array<struct<a:double,d:double>>")
    return told.join(quiet, [*keys, "start"], "left").select(*keys, "start", announcement_length(F.col("words"), F.coalesce("quiet", none)).alias("length"))
