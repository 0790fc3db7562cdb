"""Books, transcript files, archives and streams of files, by known answers."""

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import search, transcripts
from quire.sources import readers
from quire.streaming import events


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def epub(pages, ncx=None, meta=""):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="p{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(pages)))
        spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(pages)))
        toc = '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else ""
        z.writestr("o/b.opf", f"<package><metadata>{meta}</metadata><manifest>{items}{toc}</manifest><spine>{spine}</spine></package>")
        if ncx:
            points = "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{h}#x"/></navPoint>' for h, t in ncx)
            z.writestr("o/t.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        for i, page in enumerate(pages):
            z.writestr(f"o/{i}.xhtml", page)
    return bytearray(box.getvalue())


def test_books(spark):
    meta = "<title>Deep, Book 3</title><creator>A. B.</creator><creator>C</creator><subject>FIC009000</subject><subject>Fiction / Sea</subject>"
    files = [
        ("a", epub(["<p>one</p>", "<h1>Own</h1><p>two</p>", "<p>three</p>"], [("0.xhtml", "First")], meta)),
        ("b", epub(["<h2>Chapter 1</h2><p>x</p><h2>Chapter 2</h2><p>y</p><h2>Chapter III</h2><p>z</p>"], meta='<title>T</title><meta name="calibre:series" content="S"/><meta name="calibre:series_index" content="2.5"/>')),
        ("c", bytearray(b"no zip")),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    got = rows(readers.read_epub(df).select("path", "chapter_idx", "title", "text"), "path", "chapter_idx")
    assert got == [("a", 0, "First", "one"), ("a", 1, "Own", "Own\ntwo"), ("a", 2, "Deep, Book 3", "three"), ("b", 0, "Chapter 1", "Chapter 1\nx"), ("b", 1, "Chapter 2", "Chapter 2\ny"), ("b", 2, "Chapter III", "Chapter III\nz")]
    assert rows(readers.read_epub_metadata(df), "path") == [("a", "Deep, Book 3", "A. B.", "Fiction / Sea", "Deep", 3.0), ("b", "T", "", "", "S", 2.5)]


def test_transcript_files_of_all_versions(spark, tmp_path):
    one = {"duration": 0, "segments": [{"words": [{"word": " a", "start": 0.0, "end": 0.5, "probability": 0.9}]}, {"words": [{"word": "b", "start": 1.0, "end": 1.5, "probability": 0.8}]}]}
    two = {"duration": 9.0, "words": [{"text": "c", "s": 0.0, "e": 0.4, "confidence": 0.7}], "silences": [{"start": 1.0, "end": 4.5}, {"start": 5.0, "end": 5.4, "kind": "paragraph"}]}
    for name, x in (("1", one), ("2", two), ("3", {"version": 3, "words": [], "sources": [{"filename": "f", "start_sec": 0.0, "duration": 2.0}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    got = {r["path"][-6]: r for r in readers.upgraded_sidecars(spark, str(tmp_path)).collect()}
    assert [(w["w"], w["s"], w["e"], w["conf"]) for w in got["1"]["words"]] == [("a", 0.0, 0.5, 0.9), ("b", 1.0, 1.5, 0.8)]
    assert got["1"]["duration"] == 1.5 and got["1"]["made_by"] == "upgraded from 1" and got["2"]["made_by"] == "upgraded from 2"
    assert [(x["a"], x["b"], x["kind"]) for x in got["2"]["silences"]] == [(1.0, 4.5, "chapter"), (5.0, 5.4, "paragraph")]
    assert got["3"]["words"] == [] and got["3"]["sources"][0]["filename"] == "f" and {r["version"] for r in got.values()} == {3}
    words = spark.createDataFrame([(1, 1, 0.5, 0.9, "b"), (1, 0, 0.0, 0.4, "a"), (2, 0, 0.0, 0.1, "c")], "doc_id long, pos int, s double, e double, w string")
    readers.write_timeline(words, f"{tmp_path}/out")
    assert rows(readers.read_written_timeline(spark, f"{tmp_path}/out"), "doc_id", "pos") == rows(words, "doc_id", "pos")


def test_archives_are_checked_and_refused_if_not_whole(spark, tmp_path):
    facts = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "work_id long, v string")
    readers.write_archive({"facts": facts, "links": facts.where("work_id = 2")}, f"{tmp_path}/arch")
    assert readers.archive_faults(spark, f"{tmp_path}/arch").count() == 0
    assert rows(readers.archive_counts(spark, f"{tmp_path}/arch"), "work_id", "name") == [(1, "facts", 2), (2, "facts", 1), (2, "links", 1)]
    remap = spark.createDataFrame([(1, 11), (2, 12)], "old_id long, new_id long")
    assert sorted(readers.import_archive(spark, f"{tmp_path}/arch", remap, f"{tmp_path}/lib")) == ["facts", "links"]
    assert {(r["work_id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/lib/facts").collect()} == {(11, "x"), (11, "y"), (12, "z")}
    facts.where("work_id = 1").write.mode("append").partitionBy("work_id").parquet(f"{tmp_path}/arch/links")
    assert rows(readers.archive_faults(spark, f"{tmp_path}/arch"), "name") == [("links", 1, 3)]
    with pytest.raises(ValueError, match="links"):
        readers.import_archive(spark, f"{tmp_path}/arch", remap, f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()


def test_files_that_go_on_growing_are_taken_after_many_looks(spark, tmp_path):
    kind = "path string, size long"
    looks = [("grows", i) for i in range(20)] + [("still", 5)]
    spark.createDataFrame(looks, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.settled_files(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), looks=15)
    q = stream.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    got, stop = set(), time.time() + 90
    try:
        while len(got) < 2 and time.time() < stop:
            time.sleep(2)
            got = {(r["path"], r["forced"]) for r in spark.table("settled").collect()}
    finally:
        q.stop()
    assert ("grows", True) in got and ("still", False) in got


def test_playback_events_are_appended_once(spark, tmp_path):
    sql = "SELECT * FROM VALUES (1L, timestamp'2024-01-01 10:00:00', 5D), (1L, timestamp'2024-01-01 10:00:00', 5D), (2L, timestamp'2024-01-02 10:00:00', 7D) AS t(event_id, ts, value)"
    spark.sql(sql).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):  # the second run finds nothing new
        events.append_playback(events.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [(r["event_id"], str(r["day"])) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()] == [(1, "2024-01-01"), (2, "2024-01-02")]


def test_hits_of_two_books_at_one_moment_are_one_place(spark):
    data = [("w", 1, 10.0, 1), ("w", 2, 11.0, 2), ("w", 1, 11.2, 3), ("w", 2, 0.0, 4), ("w", 3, 0.0, 5), ("w", 2, 11.6, 6), ("w", 2, 12.8, 7), ("x", 9, 10.0, 1)]
    df = spark.createDataFrame(data, "work string, book int, sec double, place int")
    assert [(r["work"], r["place"]) for r in search.distinct_places(df, 10).orderBy("work", "rank").collect()] == [("w", 1), ("w", 3), ("w", 4), ("w", 5), ("w", 7), ("x", 1)]
    assert search.distinct_places(df, 2).where("work = 'w'").count() == 2


def test_numbers_that_come_twice_or_are_missing(spark):
    kind = "doc_id long, start_sec double, pos int, title string"
    titles = ["Chapter 20: A", "Chapter 4", "Chapter 22: B", "Notes", "chapter 22: C", "Chapter 4"]
    df = spark.createDataFrame([(1, float(i), i, t) for i, t in enumerate(titles)], kind)
    assert [r["title"] for r in transcripts.reconciled(df).orderBy("pos").collect()] == ["Chapter 20: A", "Chapter 4", "Chapter 22: B", "Notes", "chapter 23: C", "Chapter 24"]
    assert transcripts.gap_starts([], 0.0, 40.0, 3) == [10.0, 20.0, 30.0]
    assert transcripts.gap_starts([35.0, 12.0, 19.0], 0.0, 40.0, 3) == [12.0, 19.0, 35.0]
    assert transcripts.gap_starts([33.0], 0.0, 40.0, 2) == [33.0, 34.0]
    heard = spark.createDataFrame([(1, 1, 0.0, 0.8), (1, 4, 40.0, 1.0), (2, 7, 3.0, 0.8)], "doc_id long, number int, start_sec double, confidence double")
    quiet = spark.createDataFrame([(1, 8.0, 12.0), (1, 20.0, 21.0)], "doc_id long, a double, b double")
    got = [(n, round(s, 3), c) for d, n, s, c in rows(transcripts.filled_numbers(heard, quiet), "doc_id", "number") if d == 1]
    assert got == [(1, 0.0, 0.8), (2, 12.0, 0.4), (3, 26.667, 0.4), (4, 40.0, 1.0)]


def test_vectors_as_blobs(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, None)], "i int, v array<double>")
    b = df.select("i", readers.float_blob(F.col("v")).alias("b"))
    assert b.where("i = 1").first()["b"].hex() == "0000003f000000c0"
    back = {r["i"]: r["v"] for r in b.select("i", readers.blob_floats(F.col("b")).alias("v")).collect()}
    assert back == {1: [0.5, -2.0], 2: None}
    odd = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(readers.blob_floats(F.col("b")).alias("v"))
    assert odd.first()["v"] is None


def test_passages_and_states_of_turns(spark):
    make = lambda data, kind: spark.createDataFrame(data, kind)
    asked = make([(1, "book"), (2, "chapter"), (3, "up_to_chapter"), (4, "book"), (5, "book")], "question int, scope string")
    scoped = make([(q, 9, c, p) for q in (1, 2, 3) for c in (0, 1, 2) for p in (0, 1) if not (q == 3 and c > 1)], "question int, book int, chapter int, piece int")
    got = make([(1, 9, 2, 1, 1), (1, 9, 1, 0, 2), (2, 9, 1, 0, 1)], "question int, book int, chapter int, piece int, rank int")
    named = make([(1, 1), (1, 1), (2, 0), (3, 1), (3, 2), (4, 0)], "question int, idx int")
    found = search.turn_passages(got, scoped, named, asked, ["piece"])
    assert rows(found, "question", "rank") == [(1, 9, 2, 1, 1, False), (1, 9, 1, 0, 2, False), (1, 9, 1, 1, 3, True), (2, 9, 1, 0, 1, False), (3, 9, 1, 0, 1, True), (3, 9, 1, 1, 2, True)]
    turns = make([(1, "book", 0, 0, False, True), (2, "chapter", 0, 0, True, True), (4, "up_to_chapter", 0, 2, True, False), (5, "up_to_chapter", 0, 0, False, False), (6, "up_to_chapter", 1, 0, False, False)], "question int, scope string, chapter int, history int, spoken boolean, extract_only boolean")
    assert rows(search.turn_states(turns, found), "question") == [(1, "passages"), (2, "refused"), (4, "history"), (5, "not_started"), (6, "none")]
