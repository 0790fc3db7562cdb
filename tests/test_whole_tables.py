"""Queries that must look at all rows, on small tables."""

import random


def test_spoken_chapters_of_every_document(spark, tmp_path):
    from quire.plans import upkeep

    rows = [(i, " ".join(f"w{k}" for k in range(100)), "en", "s", 0) for i in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["number"]) for r in upkeep.spoken_chapters(spark, str(tmp_path)).collect()}
    assert got == {(i, n) for i in range(1, 6) for n in (1, 2, 3)}
    got = {tuple(r) for r in upkeep.chapter_word_ranges(spark, str(tmp_path)).select("doc_id", "number", "words", "first_pos").collect()}
    assert got == {(i, n, k, p) for i in range(1, 6) for n, k, p in ((0, 10, 0), (1, 40, 10), (2, 40, 50), (3, 10, 90))}


def test_best_run_as_by_looking_at_all_pairs():
    from quire.operators.chapters import best_run

    def brute(numbers, quiet, step=3):
        best, link = [1] * len(numbers), [-1] * len(numbers)
        for i, n in enumerate(numbers):
            for j in range(i):
                d = n - numbers[j]
                if (d == 1 or 1 < d <= step and quiet[i]) and best[j] + 1 > best[i]:
                    best[i], link[i] = best[j] + 1, j
        runs = []
        for k in range(len(numbers)):
            run = []
            while k >= 0:
                run.append(k)
                k = link[k]
            runs.append(run[::-1])
        good = [r for r in runs if len(r) >= 2]
        return min(good, key=lambda r: (-len(r), numbers[r[0]], r[0])) if good else []

    r = random.Random(5)
    for _ in range(3000):
        n = r.randrange(15)
        numbers, quiet = [r.randint(1, 8) for _ in range(n)], [r.random() < 0.5 for _ in range(n)]
        assert best_run(numbers, quiet) == brute(numbers, quiet)


def test_daily_of_many_files_out_of_time_order(spark, tmp_path):
    import datetime as dt
    from collections import Counter

    from quire.plans import streams

    start = dt.datetime(2024, 1, 1, 12)
    days = [(i * 37) % 70 for i in range(70)]
    folder = tmp_path / "events.parquet"
    rows = [(i, start + dt.timedelta(days=d), 1.0) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").repartitionByRange(70, "event_id").write.option("maxRecordsPerFile", 1).parquet(str(folder))
    assert len(list(folder.glob("*.parquet"))) == 70
    got = {r["day"]: r["n"] for r in streams.streamed_daily(spark, str(tmp_path)).collect()}
    assert got == dict(Counter(str((start + dt.timedelta(days=d)).date()) for d in days if d < 68))
