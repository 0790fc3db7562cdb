"""Operators on small tables whose results are known, with odd rows."""

import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from quire.operators import entity, ngrams, relational, segment, timeline
from quire.sources import readers
from quire.streaming import events


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_chunks_of_exact_sizes(spark):
    texts = [(1, " ".join(["w"] * 500)), (2, " ".join(["w"] * 200)), (3, ""), (4, None), (5, "one")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = rows(segment.chunks(df, ["id"]).select("id", "start_word", "end_word"), "id", "start_word")
    assert got == [(1, 0, 200), (1, 160, 360), (1, 320, 500), (1, 480, 500), (2, 0, 200), (2, 160, 200), (5, 0, 1)]
    assert segment.chunks(df.where("false"), ["id"]).count() == 0


def test_paragraph_ranges_and_packing(spark):
    df = spark.createDataFrame([(1, "a b\n\n c d e \nf")], "id long, text string")
    assert rows(segment.paragraphs(df, ["id"]), "paragraph_idx") == [(1, 0, 0, 2, "a b"), (1, 1, 2, 5, "c d e"), (1, 2, 5, 6, "f")]
    df = spark.createDataFrame([(1, "One two. Three four five. Six!"), (2, "")], "id long, text string")
    assert rows(segment.packed_sentences(df, ["id"], budget=5), "id", "part_idx") == [(1, 0, 5, "One two. Three four five."), (1, 1, 1, "Six!")]


def test_running_headers_need_four_chapters_and_half(spark):
    data = [(1, i, f"THE TITLE\ntext {i}\nrare" if i < 4 else f"text {i}") for i in range(6)] + [(2, i, "HEAD\nx") for i in range(3)]
    df = spark.createDataFrame(data, "work int, ch int, text string")
    heads = segment.running_headers(df, "work", "ch")
    assert {(r["work"], r["line"]) for r in heads.collect()} == {(1, "THE TITLE"), (1, "rare")}
    clean = {(r["work"], r["ch"]): r["text"] for r in segment.without_headers(df, heads, "work", "ch").collect()}
    assert clean[1, 0] == "text 0" and clean[2, 1] == "HEAD\nx"


def test_text_chapters(spark):
    text = "intro words here are five ok\nChapter 1\n" + "a b c d e f\n" * 2 + "Chapter 2\nshort\nChapter 3\n" + "g h i j k l"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = rows(segment.text_chapters(df, ["id"]).select("chapter_idx", "title", "word_count"), "chapter_idx")
    assert got == [(0, "Chapter 1", 14), (1, "Chapter 3", 8)]
    shout = "\n".join(["word " * 25, "", "THE FIRST PART", "a b c d e f", "", "THE SECOND PART", "g h i j k l"])
    gaps = "a b c d e\n\n\nf g h i j\n\n\nk l m n o"
    lone = "Only one title line\nChapter 1\nand some words"
    df = spark.createDataFrame([(1, shout), (2, gaps), (3, lone), (4, ""), (5, None)], "id long, text string")
    got = rows(segment.text_chapters(df, ["id"]).select("id", "chapter_idx", "title", "word_count"), "id", "chapter_idx")
    assert got == [(1, 0, "Preface", 25), (1, 1, "THE FIRST PART", 9), (1, 2, "THE SECOND PART", 9), (2, 0, "Section 1", 5), (2, 1, "Section 2", 5), (3, 0, "Only one title line", 9), (4, 0, "", 0)]


def test_alignment_of_equal_and_changed_texts(spark):
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([f"x{i}" for i in range(8)] + words[:10] + words[20:]))], "tid long, text string")
    item = spark.createDataFrame([(9, " ".join(words))], "iid long, text string")
    runs = ngrams.without_overlap(ngrams.aligned_runs(ngrams.anchors(texts, "tid", item, "iid"), "iid", "tid"), "iid", "tid")
    sizes = spark.createDataFrame([(9, 1, 30, 30), (9, 2, 30, 28)], "iid long, tid long, en int, tn int")
    got = rows(ngrams.with_gaps(runs, "iid", "tid", sizes), "tid", "es", "ts")
    assert [g[1:] for g in got] == [(1, 0, 30, 0, 30, "aligned"), (2, 0, 0, 0, 8, "trans-only"), (2, 0, 10, 8, 18, "aligned"), (2, 10, 20, 18, 18, "ebook-only"), (2, 20, 30, 18, 28, "aligned")]


def test_longest_chain_and_edit_score_against_brute_force():
    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        ts = np.array([r.randint(0, 12) for _ in range(r.randint(0, 10))])
        best = [1] * len(ts)
        for i in range(len(ts)):
            best[i] = 1 + max([best[j] for j in range(i) if ts[j] < ts[i]], default=0)
        chain = ngrams.longest_chain(ts)
        assert len(chain) == max(best, default=0) and all(np.diff(ts[chain]) > 0)
        x, y = [r.choice("abc") for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]
        d = [[-(i + j) if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = max(d[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), d[i - 1][j] - 1, d[i][j - 1] - 1)
        assert ngrams._global_score(x, y) == d[-1][-1]


def test_gaps_and_holes(spark):
    data = [(1, i, 0, float(i), i + 0.5, "w", 0.9) for i in range(60)] + [(1, 60 + i, 0, 240.0 + i, 240.5 + i, "w", 0.1) for i in range(60)]
    w = spark.createDataFrame(data, "doc_id long, pos int, line_idx int, s double, e double, w string, conf double")
    quiet = spark.createDataFrame([(1, 300.0, 301.0)], "doc_id long, a double, b double")
    track = spark.createDataFrame([(1, 300.0)], "doc_id long, duration double")
    gaps = timeline.transcription_gaps(w, quiet, track)
    assert rows(gaps, "start_sec") == [(1, 60.0, 240.0, 0)]
    assert rows(timeline.holes(w, 30.0), "start_sec") == [(1, 59.5, 240.0)]
    found = timeline.wordless_holes(w, quiet, track)
    assert rows(found, "start_sec") == [(1, 59.5, 240.0)]
    assert rows(timeline.merged_spans(gaps, found), "start_sec") == [(1, "gap", 60.0, 240.0, 0)]
    silent = spark.createDataFrame([(1, 60.0, 239.0)], "doc_id long, a double, b double")
    assert timeline.transcription_gaps(w, silent, track).count() == 0 and timeline.wordless_holes(w, silent, track).count() == 0
    late = spark.createDataFrame([(1, 330.0)], "doc_id long, duration double")
    assert rows(timeline.wordless_holes(w, quiet, late), "start_sec") == [(1, 59.5, 240.0)]  # the last half minute lies at the edge
    assert rows(timeline.wordless_holes(w, quiet, spark.createDataFrame([(1, 400.0)], "doc_id long, duration double")), "start_sec") == [(1, 59.5, 240.0), (1, 299.5, 400.0)]
    assert [tuple(r)[1:3] for r in timeline.doubtful_runs(w).collect()] == [(60, 60)]
    assert timeline.peak_rate(w).first()["peak"] == 60
    filled = {r["pos"]: r["filled"] for r in timeline.filled_times(w, F.col("pos").isin(0, 10, 119)).collect()}
    assert filled[5] == 5.0 and filled[119] == 299.0


def test_joins_by_time(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 3.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b"), (1, 9.0, "c")], "k int, at double, v string")
    assert rows(relational.as_of(left, right, ["k"], "t", "at", ["v"]), "k", "t") == [(1, 0.5, None), (1, 5.0, "b"), (2, 3.0, None)]
    assert rows(relational.as_of(left, right, ["k"], "t", "at", ["v"], forward=True), "k", "t") == [(1, 0.5, "a"), (1, 5.0, "b"), (2, 3.0, None)]
    spans = spark.createDataFrame([(1, 0.0, 5.0, "x"), (1, 5.0, 400.0, "y")], "k int, a double, b double, n string")
    assert {(r["t"], r["n"]) for r in relational.interval_join(left, spans, ["k"], "t", "a", "b", 60.0).collect()} == {(5.0, "y"), (0.5, "x")}


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(2, "", "z"), (3, "c", None)], "k int, p string, q string")
    assert rows(relational.upsert(old, new, ["k"]), "k") == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    pos = spark.createDataFrame([(1, "d1", 10), (2, "d1", 20), (1, "d2", 30)], "work int, day string, v int")
    assert rows(relational.rekey(pos, "work", F.lit(1), F.lit(2), ["work", "day"]), "day") == [(2, "d1", 20), (2, "d2", 30)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(relational.reachable(edges, start, 3), "node") == [(1, 0), (2, 1), (3, 2)]
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    files = spark.createDataFrame([("/a/b/c.txt",), ("/a/bc.txt",), ("/z",)], "path string")
    assert rows(relational.longest_prefix(files, F.col("path"), roots, "root"), "path") == [("/a/b/c.txt", "/a/b"), ("/a/bc.txt", "/a"), ("/z", None)]


def test_duplicates_with_blank_authors(spark):
    data = [(1, "Dune", "Herbert"), (2, "dune (Unabridged)", ""), (3, "Emma", "Austen"), (4, "Emma", "Other"), (5, "Emma", None), (6, "", ""), (7, "", "")]
    df = spark.createDataFrame(data, "id int, title string, author string")
    assert [list(r["ids"]) for r in entity.duplicate_clusters(df, "id", "title", "author").collect()] == [[1, 2]]


def test_pairs_by_common_and_rare_words(spark):
    data = [(1, "great river song"), (2, "great river tale"), (3, "great house"), (4, "river house song")]
    df = spark.createDataFrame(data, "id int, t string")
    want = [(1, 2, 2), (1, 4, 2)]
    assert rows(entity.shared_word_pairs(df, "id", "t"), "a", "b") == want
    assert rows(entity.shared_word_pairs(df, "id", "t", most=1), "a", "b") == want


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "lib" / "tts-previews").mkdir(parents=True)
    (tmp_path / "lib" / "A_Book.txt").write_text("x")
    (tmp_path / "lib" / "tts-previews" / "y.mp3").write_bytes(b"y")
    (tmp_path / "lib" / "z.bin").write_bytes(b"a" + b"\0" * 10 + b"b" + b"\0" * 3)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><metadata><title>T</title></metadata><manifest><item id="a" href="1.xhtml" media-type="application/xhtml+xml"/><item id="b" href="2.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/></spine></package>')
        z.writestr("o/1.xhtml", "<p>skip</p>")
        z.writestr("o/2.xhtml", "<p>Hello</p><p>there</p>")
    (tmp_path / "lib" / "e.epub").write_bytes(box.getvalue())
    (tmp_path / "lib" / "bad.epub").write_bytes(b"no zip")
    walked = readers.walk(spark, f"{tmp_path}/lib")
    assert {(r["title"], r["format"], r["origin"]) for r in walked.collect()} == {("A Book", "text", "user_upload"), ("e", "epub", "publisher_epub"), ("bad", "epub", "publisher_epub")}
    books = readers.read_epub(readers.walk(spark, f"{tmp_path}/lib", content=True).where("format = 'epub'"))
    assert [(r["chapter_idx"], r["href"], r["title"], r["text"]) for r in books.collect()] == [(0, "2.xhtml", "T", "Hello\nthere")]
    meta = readers.read_epub_metadata(readers.walk(spark, f"{tmp_path}/lib", content=True).where("format = 'epub'")).collect()
    assert [(m["title"], m["author"], m["genre"], m["series"]) for m in meta] == [("T", "", "", "")]
    raw = spark.createDataFrame([(bytearray(b"a" + b"\0" * 10 + b"b" + b"\0" * 3),)], "content binary")
    assert readers.zero_runs(raw, least=10).first()[1:] == (10, True)
    (tmp_path / "t.json").write_text(json.dumps({"duration": 3.0, "segments": [{"start": 0, "end": 1, "text": "a", "words": [{"word": " a", "start": 0.0, "end": 0.5, "probability": 0.9}]}]}))
    assert [(r["w"], r["s"], r["conf"]) for r in readers.read_timeline(spark, f"{tmp_path}/t.json").collect()] == [("a", 0.0, 0.9)]
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "work_id long, v string")
    manifest = readers.write_archive({"facts": facts}, f"{tmp_path}/arch").collect()
    assert [(m["name"], m["rows"]) for m in manifest] == [("facts", 2)]
    remap = spark.createDataFrame([(1, 101), (2, 102)], "old_id long, new_id long")
    assert {(r["work_id"], r["v"]) for r in readers.read_archive(spark, f"{tmp_path}/arch", "facts", remap).collect()} == {(101, "x"), (102, "y")}


def test_streams_with_late_and_double_rows(spark, tmp_path):
    kind = "event_id long, ts timestamp, user_id long, value double"
    sql = "SELECT * FROM VALUES (1, timestamp'2024-01-01 10:00:00', 1, 5D), (1, timestamp'2024-01-01 10:00:00', 1, 5D), (2, timestamp'2024-01-02 10:00:00', 1, 7D), (3, timestamp'2024-01-09 10:00:00', 2, 1D) AS t(event_id, ts, user_id, value)"
    spark.sql(sql).selectExpr("bigint(event_id) event_id", "ts", "bigint(user_id) user_id", "value").write.parquet(f"{tmp_path}/in")
    stream = events.daily(events.deduplicated(events.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)))
    events.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = [(str(r["day"]), r["seconds"], r["n"]) for r in spark.read.schema("day date, seconds double, n long").parquet(f"{tmp_path}/out").orderBy("day").collect()]
    assert got == [("2024-01-01", 5.0, 1), ("2024-01-02", 7.0, 1)]
    source = spark.readStream.schema(kind).parquet(f"{tmp_path}/in").select("user_id", "event_id", "value")
    events.upsert_latest(source, f"{tmp_path}/pos", f"{tmp_path}/pos-state", ["user_id"], "event_id")
    kept = lambda: rows(events.read_latest(spark, f"file://{tmp_path}/pos", "user_id long, event_id long, value double"), "user_id")
    assert kept() == [(1, 2, 7.0), (2, 3, 1.0)]
    more = spark.createDataFrame([(9, 2, 4.0), (8, 2, 9.0), (1, 1, 1.0), (5, 3, 2.0)], "event_id long, user_id long, value double")
    more.selectExpr("event_id", "timestamp'2024-02-01 00:00:00' ts", "user_id", "value").write.mode("append").parquet(f"{tmp_path}/in")
    events.upsert_latest(spark.readStream.schema(kind).parquet(f"{tmp_path}/in").select("user_id", "event_id", "value"), f"{tmp_path}/pos", f"{tmp_path}/pos-state", ["user_id"], "event_id")
    assert kept() == [(1, 2, 7.0), (2, 9, 4.0), (3, 5, 2.0)]
    assert events.read_latest(spark, f"file://{tmp_path}/none", "user_id long").count() == 0


def test_spoken_chapters_and_greedy_pairs(spark):
    from quire.operators import chapters

    said = [(0.0, "Chapter"), (0.4, "one,"), (60.0, "chapter"), (60.4, "two"), (90.0, "chapter"), (90.4, "seventeen"), (120.0, "Chapter"), (120.4, "three")]
    words = spark.createDataFrame([(1, i, s, w) for i, (s, w) in enumerate(said)], "doc_id long, pos int, s double, w string")
    quiet = spark.createDataFrame([(1, 59.5, 3.0), (1, 119.5, 3.0)], "doc_id long, end_sec double, duration double")
    found = chapters.detected(chapters.announcements(words, quiet))
    assert [(r["number"], r["s"], round(r["confidence"], 3)) for r in found.orderBy("s").collect()] == [(1, 0.0, 0.8), (2, 60.0, 1.0), (3, 120.0, 1.0)]
    assert {(r["pos"], r["number"]) for r in chapters.word_ranges(words, found).collect() if r["pos"] in (1, 5, 7)} == {(1, 1), (5, 2), (7, 3)}
    assert chapters.best_run([17], [True]) == [] and chapters.best_run([1, 3, 4], [False, False, True]) == [0, 2]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    scores = spark.createDataFrame([("a", "x", 5), ("a", "y", 4), ("b", "x", 5), ("b", "y", 1), ("c", "y", 4)], "a string, b string, n int")
    assert rows(chapters.greedy_pairs(scores, "a", "b", "n"), "a") == [("a", "x", 5), ("c", "y", 4)]
