"""Alignment of two renderings of a chapter word by word, by edit distance with the path itself.

A long chapter's table is filled by itself: scores are kept for one row of it
only, and which steps are best in two bits a cell, so the path of a chapter at
the limit of 50 million cells takes 12.5 MB.  Short chapters of like sizes are
taken together, in tables of a million cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import relational as rel

#: What two equal words, two others and a word without a partner add to the score, and the cells of a chapter that is aligned at most.
SAME, OTHER, ALONE, MOST_CELLS = 2, -1, -1, 50_000_000
#: Cells of a table that is filled by itself, and of tables that are filled together.
ALONE_FROM, TOGETHER = 250_000, 1_000_000


def comparable(text: Column | str) -> Column:
    """Words of a text as they are compared (SCA4): white-space fields in lower case without marks at their ends."""
    return F.transform(tx.fields(text), lambda w: tx.normalize_word(w))


def best_path(x: list[str], y: list[str]) -> np.ndarray:
    """For each word of ``x`` the place of its partner in ``y``, -1 for none, on the best global alignment.

    Of equal ways back from the end, a pair goes before a word of ``x`` alone, and that before a word of ``y`` alone.
    """
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int32) for words in (x, y))
    n, m = len(a), len(b)
    steps = np.arange(m + 1, dtype=np.int32) * -ALONE
    row = -steps
    paired, alone = [], []
    for i in range(n):
        pair = row[:-1] + np.where(b == a[i], SAME, OTHER).astype(np.int32)
        best = np.empty(m + 1, dtype=np.int32)
        best[0] = row[0] + ALONE
        np.maximum(pair, row[1:] + ALONE, out=best[1:])
        best += steps
        np.maximum.accumulate(best, out=best)
        best -= steps
        paired.append(np.packbits(best[1:] == pair))
        alone.append(np.packbits(best[1:] == row[1:] + ALONE))
        row = best
    at = np.full(n, -1, dtype=np.int32)
    i, j = n, m
    bit = lambda rows: rows[i - 1][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1
    while i and j:
        if bit(paired):
            i, j = i - 1, j - 1
            at[i] = j
        elif bit(alone):
            i -= 1
        else:
            j -= 1
    return at


def best_paths(pairs: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """``best_path`` of many short pairs at once: each step is taken in the tables of all.

    A cell follows from the words up to it alone, so tables are filled up with words that equal no others.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    size, wide, high = len(pairs), int(m.max(initial=0)), int(n.max(initial=0))
    a, b = np.full((size, high), -1, dtype=np.int32), np.full((size, wide), -2, dtype=np.int32)
    ids: dict[str, int] = {}
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)] = [ids.setdefault(w, len(ids)) for w in x]
        b[k, : len(y)] = [ids.setdefault(w, len(ids)) for w in y]
    steps = np.arange(wide + 1, dtype=np.int32) * -ALONE
    row = np.tile(-steps, (size, 1))
    step = np.zeros((high + 1, size, wide + 1), dtype=np.int8)  # 2: a pair, 1: a word of the first side alone, 0: one of the second
    for i in range(high):
        pair = row[:, :-1] + np.where(b == a[:, i : i + 1], SAME, OTHER).astype(np.int32)
        alone = row + ALONE
        best = alone.copy()
        np.maximum(pair, alone[:, 1:], out=best[:, 1:])
        best += steps
        np.maximum.accumulate(best, axis=1, out=best)
        best -= steps
        step[i + 1, :, 1:] = np.where(best[:, 1:] == pair, 2, best[:, 1:] == alone[:, 1:])
        row = best
    at = np.full((size, high), -1, dtype=np.int32)
    i, j = n.copy(), m.copy()
    k = np.flatnonzero((i > 0) & (j > 0))
    while len(k):
        way = step[i[k], k, j[k]]
        paired = k[way == 2]
        at[paired, i[paired] - 1] = j[paired] - 1
        i[k] -= way > 0
        j[k] -= way != 1
        k = k[(i[k] > 0) & (j[k] > 0)]
    return [at[k, : n[k]] for k in range(size)]


def paths_of(xs: list, ys: list, most_cells: int) -> list[np.ndarray | None]:
    """The paths of pairs; None over ``most_cells``.  Pairs of like sizes are taken together up to ``TOGETHER`` cells, large ones alone."""
    found: list[np.ndarray | None] = [None] * len(xs)
    sizes = sorted((len(x), len(y), k) for k, (x, y) in enumerate(zip(xs, ys, strict=True)) if len(x) * len(y) <= most_cells)
    held: list[int] = []
    wide = 0

    def done() -> None:
        for k, path in zip(held, best_paths([(list(xs[k]), list(ys[k])) for k in held]), strict=True):
            found[k] = path

    for n, m, k in sizes:
        if (n + 1) * (m + 1) > ALONE_FROM:
            found[k] = best_path(list(xs[k]), list(ys[k]))
            continue
        if held and (len(held) + 1) * (n + 1) * (max(wide, m) + 1) > TOGETHER:
            done()
            held, wide = [], 0
        held.append(k)
        wide = max(wide, m)
    if held:
        done()
    return found


def aligned_chapters(pairs: DataFrame, keys: list[str], a: str, b: str, most_cells: int = MOST_CELLS) -> DataFrame:
    """Chapters aligned word by word (ALN7, WIN20): keys, words, at, same, confidence.

    ``a`` and ``b`` are the comparable words of either side.  ``at`` has for each
    word of ``a`` the place of its partner, null for none; ``same`` counts the
    partners that are the same word, ``confidence`` is their share.  All three are
    null where the table would have over ``most_cells`` cells; chapters with an
    empty side have no row.
    """

    @F.pandas_udf("array<int>")
    def path(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series(paths_of(list(xs), list(ys), most_cells), dtype=object)

    # The work on a chapter grows with its length squared, so chapters are dealt anew rather than left where their texts lie.
    dealt = pairs.where((F.size(a) > 0) & (F.size(b) > 0)).select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).repartition(*keys)
    both = dealt.withColumn("__at", path("__a", "__b"))
    equal = F.filter(F.sequence(F.lit(0), F.size("__a") - 1), lambda i: (F.get("__at", i) >= 0) & (F.get("__a", i) == F.get("__b", F.get("__at", i))))
    same = F.when(F.col("__at").isNotNull(), F.size(equal).cast("long"))
    at = F.transform("__at", lambda j: F.when(j >= 0, j))
    return both.select(*keys, F.size("__a").alias("words"), at.alias("at"), same.alias("same")).withColumn("confidence", F.col("same") / F.col("words"))


def word_pairs(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Words of the first side with their partners (ALN7): keys, e, t; t null for a word without one."""
    return aligned.where("at is not null").select(*keys, F.posexplode("at").alias("e", "t"))


def paragraph_pairs(aligned: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of paragraphs in the other rendering (ALN7): keys, from_start, from_end, to_start, to_end, confidence.

    ``paragraphs``: keys, word_start, word_end; none lies over another.  A chapter
    without any counts as one; a paragraph of which no word has a partner goes.
    The words meet their paragraphs in one sort by place.
    """
    none = aligned.join(paragraphs.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("word_start"), F.col("words").alias("word_end"))
    p = paragraphs.select(*keys, "word_start", "word_end").unionByName(none)
    w = word_pairs(aligned, keys).where("t is not null")
    met = rel.as_of(w, p.withColumn("from_start", F.col("word_start")), keys, "e", "word_start", ["from_start", "word_end"]).where("e < word_end")
    ranges = met.groupBy(*keys, "from_start", F.col("word_end").alias("from_end")).agg(F.min("t").alias("to_start"), (F.max("t") + 1).alias("to_end"))
    return ranges.join(aligned.select(*keys, "confidence"), keys)


def work_confidence(aligned: DataFrame, work: str) -> DataFrame:
    """Aligned chapters of each work and their mean confidence (ALN7): work, chapters, skipped, confidence; works without an aligned chapter go."""
    done = F.col("at").isNotNull()
    n = aligned.groupBy(work).agg(F.count_if(done).alias("chapters"), F.count_if(~done).alias("skipped"), F.avg("confidence").alias("confidence"))
    return n.where("chapters > 0")
