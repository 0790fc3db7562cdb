"""Chapters from spoken announcements and from silences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import relational as rel


def announcements(words: DataFrame, silences: DataFrame, least: float = 2.0) -> DataFrame:
    """"chapter" or "part" followed by a number, with whether a silence of ``least`` seconds ends just before (SEG6).

    ``words``: doc_id, pos, s, w; ``silences``: doc_id, end_sec, duration.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    n = words.withColumn("k", tx.normalize_word("w")).withColumn("next", F.lead("w").over(w))
    c = n.where(F.col("k").isin("chapter", "part")).withColumn("number", tx.number_word(tx.normalize_word("next"))).where("number > 0")
    c = c.select("doc_id", "pos", "s", F.col("k").alias("word"), "number")
    near = silences.where(F.col("duration") >= least).select("doc_id", F.col("end_sec").alias("quiet_end"))
    c = rel.as_of(c, near, ["doc_id"], "s", "quiet_end", ["quiet_end"])
    return c.withColumn("after_silence", F.coalesce(F.col("s") - F.col("quiet_end") <= 1.5, F.lit(False))).drop("quiet_end")


def best_run(numbers: list[int], quiet: list[bool], step: int = 3) -> list[int]:
    """Places of the longest run of rising numbers (WIN19): steps of one to ``step``, one over one only after a silence; of equals the one that starts lowest."""
    best, link, start = [1] * len(numbers), [-1] * len(numbers), list(range(len(numbers)))
    longest: dict[int, int] = {}  # of each number the place where its longest run ends, the first of equals
    for i, n in enumerate(numbers):
        before = [longest[n - d] for d in range(1, (step if quiet[i] else 1) + 1) if n - d in longest]
        if before:
            j = min(before, key=lambda k: (-best[k], k))
            best[i], link[i], start[i] = best[j] + 1, j, start[j]
        if n not in longest or best[i] > best[longest[n]]:
            longest[n] = i
    good = [i for i in range(len(numbers)) if best[i] >= 2]
    run, k = [], min(good, key=lambda i: (-best[i], numbers[start[i]], start[i])) if good else -1
    while k >= 0:
        run.append(k)
        k = link[k]
    return run[::-1]


def detected(found: DataFrame) -> DataFrame:
    """Chapters of each text (SEG6): the longer of the runs of "chapter" and of "part", chapter on equal length, with a confidence."""

    @F.pandas_udf("array<int>")
    def picked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def pick(kinds, numbers, quiet) -> list[int]:
            options = []
            for word in ("chapter", "part"):
                own = [i for i, k in enumerate(kinds) if k == word]
                options.append([own[i] for i in best_run([int(numbers[i]) for i in own], [bool(quiet[i]) for i in own])])
            return options[0] if len(options[0]) >= len(options[1]) else options[1]

        for lists in batches:
            yield pd.Series([pick(*x) for x in zip(*lists, strict=True)], dtype=object)

    # A text's announcements are a list; a batch has the lists of many texts.
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "word", "number", "after_silence"))).alias("r"))
    part = lambda c: F.transform("r", lambda x: x[c])
    each = listed.withColumn("at", picked(part("word"), part("number"), part("after_silence"))).select("doc_id", F.explode(F.transform("at", lambda i: F.get("r", i))).alias("x"))
    confidence = F.lit(0.5) + 0.3 + 0.2 * F.col("x.after_silence").cast("double")
    return each.select("doc_id", "x.word", "x.number", "x.s", confidence.alias("confidence"))


def word_ranges(words: DataFrame, starts: DataFrame) -> DataFrame:
    """Words with the chapter they belong to (SEG11): the last one that starts at or before them; those ahead of the first have 0."""
    found = rel.as_of(words, starts.select("doc_id", F.col("s").alias("start_sec"), "number"), ["doc_id"], "s", "start_sec", ["number"])
    return found.withColumn("number", F.coalesce("number", F.lit(0)))


def greedy_pairs(scores: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs by falling score (JOI8, JOI20): in each round every pair that is best for both sides is taken.

    Ties go to the smaller identifiers, so the result is that of going down one
    sorted list.  Rounds run while pairs are left; each is two aggregates and joins.
    """
    rank = F.struct((-F.col(score)).alias("n"), F.col(a).alias("x"), F.col(b).alias("y"))
    left, out = scores.select(a, b, score).withColumn("r", rank).checkpoint(), None
    while not left.isEmpty():
        for_a = left.groupBy(a).agg(F.min("r").alias("ra"))
        for_b = left.groupBy(b).agg(F.min("r").alias("rb"))
        taken = left.join(for_a, a).join(for_b, b).where("r = ra and r = rb").select(a, b, score).checkpoint()
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti").checkpoint()
    return out if out is not None else scores.select(a, b, score)
