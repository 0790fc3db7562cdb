"""The drop folder over several batches and restarts, against a walk through all rows of a path."""

import os
import random
from datetime import datetime, timedelta, timezone

from quire.streaming import dropfolder as df

KIND = "path string, at timestamp, what string, size long, error string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def walk(rows, until_ms):
    """Rule by rule over each path's rows in time, as in the README of a drop folder: no state is shared with the stream's code."""
    out = []
    for path in sorted({r[0] for r in rows}):
        if path.rsplit("/", 1)[-1].startswith("."):
            continue
        own = sorted((r for r in rows if r[0] == path), key=lambda r: (r[1], r[2], r[3]))
        shelf = "audiobooks" if path.endswith((".mp3", ".stt.json")) else "ebooks" if path.endswith(".epub") else None
        size, due, tries = None, None, 0
        for _, ms, what, now, error in [*own, (path, until_ms, "end", 0, None)]:
            if due is not None and due <= ms:
                out.append((path, "ready" if shelf else "dead", shelf, tries, due, None if shelf else "unsupported file type"))
                due = None
                if not shelf:
                    size, tries = None, 0
            if what == "written" and (due is None or now != size):
                size, due = now, ms + 3000
            if what == "failed":
                tries += 1
                due = ms + 5000
                if tries == 3:
                    out.append((path, "dead", shelf, 3, ms, error))
            if what == "done" or (what == "failed" and tries == 3):
                size, due, tries = None, None, 0
    return sorted(out, key=str)


def feed(spark, folder, name, rows):
    from pyspark.sql import functions as F

    data = [(p, START + timedelta(milliseconds=ms), w, s, e) for p, ms, w, s, e in rows]
    spark.createDataFrame(data, KIND).coalesce(1).sortWithinPartitions(F.col("at")).write.parquet(f"{folder}/{name}")


def run(spark, base):
    seen = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{base}/in/*")
    df.deal(seen, f"file://{base}/ready", f"file://{base}/dead", f"file://{base}/state", late="2 seconds")


def results(spark, base):
    ms = lambda t: round((t.replace(tzinfo=timezone.utc) - START).total_seconds() * 1000)
    return sorted(((r["path"], a, r["shelf"], r["tries"], ms(r["at"]), r["error"]) for a in ("ready", "dead") for r in df.dealt(spark, f"file://{base}/{a}").collect()), key=str)


def test_growing_failing_and_good_files_over_batches_and_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    good, growing, failing, odd, hidden = "/in/a.mp3", "/in/b.epub", "/in/c.mp3", "/in/d.zip", "/in/.e.mp3"
    first = [(good, 0, "written", 5, None), (growing, 0, "written", 1, None), (growing, 2000, "written", 2, None), (odd, 100, "written", 1, None), (hidden, 0, "written", 1, None), (failing, 500, "written", 9, None)]
    second = [(growing, 4000, "written", 3, None), (good, 4000, "done", 0, None), (failing, 6000, "failed", 0, "disk full"), (growing, 6500, "written", 3, None)]
    third = [(failing, 12_000, "failed", 0, "disk full"), (failing, 18_000, "failed", 0, "disk gone"), (good, 30_000, "written", 6, None)]
    feed(spark, f"file://{tmp_path}/in", "1", first)
    run(spark, tmp_path)
    early = results(spark, tmp_path)
    assert early == []  # nothing is known to have passed yet
    feed(spark, f"file://{tmp_path}/in", "2", second)
    run(spark, tmp_path)
    feed(spark, f"file://{tmp_path}/in", "3", third)
    run(spark, tmp_path)
    want = walk(first + second + third, 28_000)
    assert results(spark, tmp_path) == want
    assert ("/in/c.mp3", "dead", "audiobooks", 3, 18_000, "disk gone") in want and ("/in/b.epub", "ready", "ebooks", 0, 7000, None) in want
    assert ("/in/d.zip", "dead", None, 0, 3100, "unsupported file type") in want and not any(r[0] == hidden for r in want)


def test_many_paths_equal_the_walk(spark, tmp_path):
    r = random.Random(8)
    paths = [f"/in/{i}{e}" for i in range(12) for e in (".mp3", ".epub", ".zip", ".stt.json")]
    rows = sorted({(r.choice(paths), r.randrange(0, 120_000, 250), r.choice(["written", "written", "failed", "done"]), r.randint(1, 2), "no") for _ in range(900)}, key=lambda x: x[1])
    rows = list({(p, ms): (p, ms, w, s, e) for p, ms, w, s, e in rows}.values())
    for i in range(4):
        feed(spark, f"file://{tmp_path}/in", str(i), [x for x in rows if i * 30_000 <= x[1] < (i + 1) * 30_000])
        for d, _, names in os.walk(f"{tmp_path}/in/{i}"):
            for n in names:
                os.utime(f"{d}/{n}", (1_000_000 + i, 1_000_000 + i))
    run(spark, tmp_path)
    newest = max(x[1] for x in rows)
    assert results(spark, tmp_path) == walk(rows, newest - 2000)
