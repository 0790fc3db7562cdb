"""What belongs together is dealt once: shuffles of plans, and results against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import audit, linking, ngrams, paths, transcripts


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ways_between_books_take_one_shuffle(spark):
    r = random.Random(2)
    rows = [(w, "u", i, r.randint(0, 5), r.randint(0, 5)) for w in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "work long, unit string, id int, from_book int, to_book int")
    want = {}
    for w in range(40):
        steps = [(a, b, i, False) for k, _, i, a, b in rows if k == w and a != b] + [(b, a, i, True) for k, _, i, a, b in rows if k == w and a != b]
        ways = [((i,), (back,), (a, b)) for a, b, i, back in steps]
        while ways:
            for ids, turns, books in ways:
                key, way = (w, books[0], books[-1]), (len(ids), ids, turns)
                want[key] = min(want.get(key, way), way)
            ways = [((*ids, i), (*turns, back), (*books, b)) for ids, turns, books in ways for a, b, i, back in steps if a == books[-1] and b not in books]
    out = paths.alignment_paths(df)
    assert shuffles(out) == 1
    assert {(x["work"], x["a"], x["b"]): (x["hops"], tuple(x["ids"]), tuple(x["reversed"])) for x in out.collect()} == want


def test_chains_of_files_take_one_shuffle(spark):
    r = random.Random(6)
    rows = [(w, i, r.randint(0, 60) / 2, r.randint(1, 12) / 2) for w in range(60) for i in range(r.randint(1, 9))]
    want = {}
    for w in {x[0] for x in rows}:
        own = [x[1:] for x in rows if x[0] == w]
        after = {i: min((j for j, t, _ in own if t > s and abs(t - (s + d)) <= 2), default=None) for i, s, d in own}
        up = {j: min(i for i in after if after[i] == j) for j in after.values() if j is not None}
        for i, _, _ in own:
            h = i
            while h in up:
                h = up[h]
            want[w, i] = h
    out = linking.narrations(spark.createDataFrame(rows, "work int, id int, start_sec double, duration double"), "work")
    assert shuffles(out) == 1
    assert {(x["work"], x["id"]): x["head"] for x in out.collect()} == want


def test_grams_are_counted_where_texts_lie(spark):
    rows = [(1, "a b c d e"), (1, "b c d e a"), (2, "x y z w x y z w"), (3, "a b"), (None, "p q r s"), (None, "p q r s t")]
    out = ngrams.hapax_counts(spark.createDataFrame(rows, "k int, text string"), "k")
    assert shuffles(out) == 1
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2), (2, 3), (None, 1)]


def test_words_of_chapters_are_dealt_once(spark):
    words = [(1, p, p * 1.0, p + (0.2 if p % 3 == 2 else 0.9), "w." if p % 3 == 2 else "w") for p in range(9)]
    w = spark.createDataFrame(words, "doc_id int, pos int, s double, e double, w string")
    starts = spark.createDataFrame([(1, 2.0, 1), (1, 5.5, 2)], "doc_id int, start_sec double, number int")
    out = transcripts.chapter_texts(w, starts)
    assert shuffles(out) == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, 4, "w.\n\nw w w."), (1, 2, 3, "w w w.")]


def test_checks_of_works_come_from_one_row_each(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 0, 3), (3, 1, 1)], "work int, a long, b int")
    out = audit.findings_of(df, {"x": ("HIGH", F.col("a")), "y": ("LOW", F.col("b"))})
    other = audit.findings({"x": ("HIGH", df.where("a > 0").select("work", F.col("a").alias("n"))), "y": ("LOW", df.where("b > 0").select("work", F.col("b").alias("n")))})
    assert out.dtypes == other.dtypes and sorted(out.collect()) == sorted(other.collect())
    assert shuffles(out) == 0


def test_checks_of_a_timeline_share_one_deal(spark):
    words = [(d, p, (5.0 if d == 1 and p < 8 else p * 0.1) - (9 if p == 30 else 0), p * 0.1 + 0.3, 0.1 if d == 2 and 5 <= p < 14 else 0.9, "w") for d in (1, 2, 3) for p in range(40 if d < 3 else 600)]
    w = spark.createDataFrame(words, "doc_id int, pos int, s double, e double, conf double, w string")
    durations = spark.createDataFrame([(1, 100.0), (2, 2.0)], "doc_id int, duration double")
    files = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 14.0, 10.0)], "doc_id int, n int, start_sec double, duration double")
    out = audit.timeline_problems(w, durations, files)
    want = {(1, "synthesized_word_timings"): 8, (1, "non_monotonic"): 0, (1, "source_discontinuity"): 2, (2, "model_did_not_believe_this"): 9}
    found = {(x["doc_id"], x["kind"]): x["n"] for x in out.collect()}
    for d in (1, 2, 3):
        own = [x for x in words if x[0] == d]
        high, back = float("-inf"), 0
        for x in own:
            back += x[2] < high - 0.5
            high = max(high, x[2])
        want[d, "non_monotonic"] = back
        limit = {1: 100.0, 2: 2.0}.get(d)
        want[d, "words_outside_audio"] = 0 if limit is None else sum(x[2] < -0.5 or x[3] > limit + 1 for x in own)
        ms = sorted(round(x[2] * 1000) for x in own)
        peak = max(sum(t - 60_000 <= u <= t for u in ms) for t in ms)
        want[d, "implausible_density"] = peak if peak > 450 else 0
    assert found == {k: n for k, n in want.items() if n}
