"""Results on small tables, by plans whose work does not grow with the square of a group."""

import random

from pyspark.sql import functions as F

from quire.operators import alignment, chapters, linking, ngrams, relational, timeline, transcripts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_filled_times_read_no_group_to_its_end(spark):
    r = random.Random(3)
    data = [(d, p, float(p * 2 + d)) for d in range(5) for p in range(r.choice((1, 7, 30)))]
    known = {(d, p) for d, p, _ in data if d != 3 and r.random() < 0.3}
    w = spark.createDataFrame([(d, p, s, (d, p) in known) for d, p, s in data], "doc_id int, pos int, s double, known boolean")
    out = timeline.filled_times(w, F.col("known"))
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    got = {(x["doc_id"], x["pos"]): x["filled"] for x in out.collect()}
    for d, p, _ in data:
        before = [q for e, q in known if e == d and q <= p]
        after = [q for e, q in known if e == d and q >= p]
        want = None
        if before or after:
            want = float((p if before and after else max(before) if before else min(after)) * 2 + d)
        assert got[d, p] == want


def test_forward_as_of_reads_no_group_to_its_end(spark):
    r = random.Random(4)
    a = [(k, r.randrange(40), i) for k in range(4) for i in range(20)]
    b = [(k, t, k * 100 + t) for k in range(3) for t in r.sample(range(40), 9)]
    out = relational.as_of(spark.createDataFrame(a, "k int, t int, i int"), spark.createDataFrame(b, "k int, u int, v int"), ["k"], "t", "u", ["v"], forward=True)
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    want = {(k, i): min((u, v) for q, u, v in b if q == k and u >= t)[1] if any(q == k and u >= t for q, u, _ in b) else None for k, t, i in a}
    assert {(x["k"], x["i"]): x["v"] for x in out.collect()} == want


def test_source_timestamps_read_no_group_to_its_end(spark):
    data = [(d, p, *((p * 1.0, p + 0.5) if p % 4 == d else (None, None))) for d in range(3) for p in range(11)]
    w = spark.createDataFrame(data, "doc_id int, pos int, s double, e double")
    out = alignment.source_timestamps(w, ["doc_id"], spark.createDataFrame([(d, 20.0) for d in range(3)], "doc_id int, audio_end double"))
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    got = {(x["doc_id"], x["pos"]): (x["s"], x["e"]) for x in out.collect()}
    assert got[0, 4] == (4.0, 4.5) and got[0, 5] == (4.5, 4.5 + 3.5 / 3) and got[0, 10] == (8.5 + 11.5 / 2, 20.0) and got[2, 0] == (0.0, 1.0)


def test_titles_of_the_same_words_are_compared_once(spark):
    r = random.Random(6)
    names = [" ".join(r.choice(("red", "blue", "of", "green", "green", "old")) for _ in range(r.randint(1, 4))) for _ in range(60)]
    audio = [(i % 2, 2 * i, names[i % 60] + " x" * (i % 2)) for i in range(120)]
    text = [(i % 2, 2 * i + 1, names[(7 * i) % 60] + " y") for i in range(120)]
    out = linking.title_links(spark.createDataFrame(audio, "work int, audio_index int, title string"), spark.createDataFrame(text, "work int, text_index int, title string"), "work")
    told = lambda s: [w for w in s.split() if len(w) > 2]
    want = {}
    for k, i, title in audio:
        n = [(sum(w in told(t) for w in told(title)), -j) for q, j, t in text if q == k]
        if max(n)[0] >= 2:
            want[i] = (-max(n)[1], min(0.7, max(n)[0] * 0.2))
    assert {x["audio_index"]: (x["text_index"], x["confidence"]) for x in out.collect()} == want
    assert "PythonUDF" not in plan(out) and len(want) > 20


def test_numbers_set_right_for_many_books_a_batch(spark):
    titles = ["Chapter 1: a", "chapter 1", None, "Part 2", "Epilogue", "CHAPTER 2 b", "Chapter 3"]
    rows = [(d, float(i), i, t) for d in range(50) for i, t in enumerate(titles)]
    out = transcripts.reconciled(spark.createDataFrame(rows, "doc_id long, start_sec double, pos int, title string"))
    assert "flatmapgroups" not in plan(out)
    got = [x["title"] for x in out.where("doc_id = 7").orderBy("pos").collect()]
    assert got == ["Chapter 1: a", "chapter 2", None, "Part 3", "Epilogue", "CHAPTER 4 b", "Chapter 5"]
    assert out.count() == 350 and out.columns == ["doc_id", "start_sec", "pos", "title"]


def test_announced_runs_and_chains_for_many_groups_a_batch(spark):
    found = [(d, i * 10, float(i), "chapter" if i < 4 else "part", i + 1, i % 2 == 0) for d in range(30) for i in range(6)]
    out = chapters.detected(spark.createDataFrame(found, "doc_id long, pos int, s double, word string, number int, after_silence boolean"))
    assert "flatmapgroups" not in plan(out)
    assert [tuple(x) for x in out.where("doc_id = 3").orderBy("s").collect()] == [(3, "chapter", i + 1, float(i), 1.0 if i % 2 == 0 else 0.8) for i in range(4)]
    met = [(a, 1, es, ts) for a in range(30) for es, ts in ((0, 5), (0, 9), (1, 6), (2, 7), (5, 8), (6, 9), (7, 0))]
    out = ngrams.aligned_runs(spark.createDataFrame(met, "a int, b int, es int, ts int"), "a", "b")
    assert "flatmapgroups" not in plan(out)
    assert [tuple(x) for x in out.where("a = 3").orderBy("es").collect()] == [(3, 1, 0, 6, 5, 11), (3, 1, 5, 10, 8, 13)]


def test_parts_near_an_end_of_silence(spark):
    w = spark.createDataFrame([(1, 0, 10.0, "Part"), (1, 1, 10.5, "two"), (1, 2, 20.0, "part"), (1, 3, 20.5, "3"), (1, 4, 30.0, "part"), (1, 5, 31.0, "4")], "doc_id int, pos int, s double, w string")
    q = spark.createDataFrame([(1, 5.0, 8.5), (1, 15.0, 21.5), (1, 26.0, 31.6), (1, 29.0, 30.0)], "doc_id int, a double, b double")
    out = transcripts.silence_parts(w, q)
    assert plan(out).count("window ") == 1
    assert sorted(tuple(x) for x in out.collect()) == [(1, 0, 10.0, 2), (1, 2, 20.0, 3)]


def test_words_meet_segments_by_the_work_alone(spark):
    r = random.Random(8)
    segs, words, spans = [], [], []
    for k in range(12):
        es = ts = 0
        for n in range(8):
            el, tl = r.randint(0, 9), r.randint(0, 9)
            segs.append((k, n, r.choice(("aligned", "aligned", "replace")), es, es + el, ts, ts + tl))
            es, ts = es + el, ts + tl
        words += [(k, p, p * 0.5, p * 0.5 + 0.25) for p in range(3, ts) if k % 2 or p % 7]
        spans += [(k, c, 13 * c, min(13, es - 13 * c)) for c in range(-(-es // 13))]
    s = spark.createDataFrame(segs, "k int, n int, kind string, es int, ee int, ts int, te int")
    w = spark.createDataFrame(words, "k int, pos int, s double, e double")
    c = spark.createDataFrame(spans, "k int, chapter int, start int, len int")
    at = {(k, p): (a, b) for k, p, a, b in words}
    want = {(k, x, at[k, ts + (x - es) * (te - ts) // (ee - es)][0]) for k, _, kind, es, ee, ts, te in segs if kind == "aligned" and te > ts for x in range(es, ee) if (k, ts + (x - es) * (te - ts) // (ee - es)) in at}
    assert {tuple(x) for x in alignment.word_seconds(s, w, ["k"]).collect()} == want
    out = alignment.word_seconds(s, w, ["k"], c)
    assert "hashpartitioning(k#" in plan(out) and ", w#" not in "".join(x.split("hashpartitioning(")[1].split(")")[0] for x in plan(out).split("\n") if "hashpartitioning(" in x)
    assert {tuple(x) for x in out.collect()} == {(k, ch, a, x, sec) for k, x, sec in want for q, ch, a, n in spans if q == k and a <= x < a + n}
    got = {(x["k"], x["n"]): (x["start_sec"], x["end_sec"]) for x in alignment.baked(s, w, ["k"]).collect()}
    assert got == {(k, n): (at.get((k, ts), (None, None))[0], at.get((k, te - 1), (None, None))[1]) if kind == "aligned" else (None, None) for k, n, kind, _, _, ts, te in segs}
