"""Queries against their SQL on rows that the sample tables lack."""

import random

import duckdb
from pyspark.sql import functions as F

from quire.operators import alignment as al
from quire.plans import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def compared(spark, name: str, folder, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows of a query and of its SQL over ``documents`` of these (doc_id, text), sorted."""
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    theirs = [x[0] for x in found.description]
    df = registry.queries()[name](spark, str(folder))
    return sorted((tuple(r[c] for c in theirs) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_two_spellings_of_a_word_are_a_difference(spark, tmp_path):
    words = [f"word{k}" for k in range(24)]
    mine, theirs = compared(spark, "difference_spans", tmp_path, [(1, " ".join([*words, "colour", *words, "color"])), (2, " ".join([*words, "Colour", *words, "colour"]))])
    assert mine == theirs
    assert sorted((r[0], r[2]) for r in mine) == [(1, "aligned"), (1, "replace"), (2, "aligned"), (2, "aligned")]


def test_parts_of_a_text_to_its_end(spark, tmp_path):
    mine, theirs = compared(spark, "parts_and_chapters", tmp_path, [(1, "w " * 300_200), (2, "w " * 29_501 + "\nw w"), (3, "w " * 101)])
    assert mine == theirs
    parts = [(r[0], r[3]) for r in mine if r[4] == "part"]
    assert sorted(parts) == [(1, n) for n in range(1, 1002) if 300 * (n - 1) + 101 < 300_200] + [(2, n) for n in range(1, 100)]
    assert (1, 1001) in parts and (2, 99) in parts


def test_sources_of_chapters_come_from_one_deal_of_the_words(spark, tmp_path):
    line = "w " * 40 + "\n"
    texts = ["", " ", "one", "w " * 700, line * 12, "\n" * 5 + line * 3, "a\n\n" * 200, "w " * 101 + "\n" + line * 4, *[line * k + "\n" + "w " * (37 * k) for k in range(1, 30)], "w " * 30_000]
    rows = list(enumerate(texts))
    mine, theirs = compared(spark, "chapter_cascade", tmp_path, rows)
    assert mine == theirs and {r[4] for r in mine} == {"supplied", "announced", "silences", "pauses", "whole"}
    plan = registry.queries()["chapter_cascade"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_words_of_a_cast_are_counted_where_they_lie(spark):
    from quire.operators import entity

    texts = [(2, "so Ann Lee and Ann Lee or Dr. Ann Lee. Ha Ha ha Ha Ha. He met Bo and Bo's dog; Bo Ann left."), (1, "Then Mr. Bo and Ha Ha went by Ann Lee. SO."), (None, "by Mrs. Bo")]
    rows = [("w", i, t) for i, t in texts]
    want = [("Ann Lee", 5, 9), ("Ha Ha", 5, 14), ("Mrs. Bo", 5, 5)]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(w, None if i is None else i if kind == "long" else str(i), t) for w, i, t in rows], f"work string, doc {kind}, text string")
        out = entity.cast_names(df, "work", "doc")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "lag(" not in plan and plan.count("regexp_extract_all") == 2
        assert sorted((r["name"], r["mentions"], r["total"]) for r in out.collect()) == want


def test_times_of_chapters_as_by_looking_at_each_word(spark):
    r = random.Random(12)
    segs, words, spans = [], [], []
    for k in range(60):
        es = ts = 0
        for _ in range(9):
            el = r.randint(0, 30)
            tl = r.choice((el, el, r.randint(0, 30)))
            segs.append((k, r.choice(("aligned", "aligned", "replace")), es, es + el, ts, ts + tl))
            if k % 4 == 3 and el and tl:  # overlaps the one before
                segs.append((k, "aligned", max(0, es - 5), es + el, max(0, ts - 4), ts + tl))
            es, ts = es + el, ts + tl
        pace = r.choice((0.4, 0.1, 0.0))
        words += [(k, p, p * pace, p * pace + 0.3) for p in range(k % 3, ts) if k % 2 or p % 7]
        spans += [(k, c, 40 * c, min(40, es - 40 * c)) for c in range(-(-es // 40))]
    s = spark.createDataFrame(segs, "k int, kind string, es int, ee int, ts int, te int")
    w = spark.createDataFrame(words, "k int, pos int, s double, e double")
    c = spark.createDataFrame(spans, "k int, chapter int, start int, len int")
    every = c.select("k", "chapter", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("w"), F.lit(None).cast("double").alias("sec"))
    each = every.unionByName(al.word_seconds(s, w, ["k"], c).select(*every.columns)).groupBy("k", "chapter", "w").agg(F.min("sec").alias("sec"))
    want = sorted(map(tuple, al.word_sync(each, ["k", "chapter"]).collect()))
    assert sorted(map(tuple, al.synced_words(s, w, ["k"], c).collect())) == want and len(want) > 1000
    timed = {x[:2] for x in want}
    at = {x[:2]: x[3] for x in words}
    met = {(k, ch) for k, ch, a, n in spans for q, kind, es, ee, _, te in segs if q == k and kind == "aligned" and es < a + n and ee > a and at.get((k, te - 1), 0) > 0}
    modes = {(x["k"], x["chapter"]): x["mode"] for x in al.sync_modes(s, w, ["k"], c).collect()}
    assert modes == {x[:2]: "word" if x[:2] in timed else "paragraph" if x[:2] in met else "none" for x in spans}
    assert len(set(modes.values())) == 3


def test_words_of_chapters_are_counted_out_at_the_end(spark):
    plans = {n: registry.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("ebook_word_sync", "text_sync_modes")}
    assert [x.count("Generate") for x in plans.values()] == [2, 1]  # chapters, and words where they are asked for
    assert not any("Broadcast" in x for x in plans.values())
