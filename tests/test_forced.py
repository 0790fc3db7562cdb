"""Word-by-word alignment against a full table, and joins of spans against all pairs."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.operators import forced
from quire.operators import relational as rel
from quire.plans import forced as plans


def full_table(x, y):
    """The whole table of scores and the way back through it."""
    n, m = len(x), len(y)
    score = [[-(i + j) for j in range(m + 1)] if i == 0 else [-i] + [0] * m for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
    at, i, j = [None] * n, n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
            at[i] = j
        elif i and score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return at


def random_words(r, n):
    return [r.choice(["a", "b", "c", "", "don't"]) for _ in range(n)]


def test_path_equals_the_full_table():
    r = random.Random(3)
    for _ in range(400):
        x, y = random_words(r, r.randint(1, 24)), random_words(r, r.randint(1, 24))
        assert [None if j < 0 else int(j) for j in forced.best_path(x, y)] == full_table(x, y), (x, y)


def test_chapters_paragraphs_and_confidence(spark):
    r = random.Random(4)
    data = [(w, c, random_words(r, r.randint(0, 30)), random_words(r, r.randint(0, 30))) for w in range(4) for c in range(8)]
    pairs = spark.createDataFrame(data, "work int, chapter int, a array<string>, b array<string>").repartition(3)
    aligned = forced.aligned_chapters(pairs, ["work", "chapter"], "a", "b", most_cells=500)
    want, ranges, conf = {}, [], {}
    paragraphs = [(w, c, s, min(s + 7, len(a))) for w, c, a, _ in data if c % 3 for s in range(0, len(a), 7)]
    for w, c, a, b in data:
        if not a or not b:
            continue
        at = full_table(a, b) if len(a) * len(b) <= 500 else None
        want[w, c] = (len(a), at, None if at is None else sum(j is not None and a[i] == b[j] for i, j in enumerate(at)))
        conf.setdefault(w, []).append(None if at is None else want[w, c][2] / len(a))
        spans = [(s, e) for pw, pc, s, e in paragraphs if (pw, pc) == (w, c)] if c % 3 else [(0, len(a))]
        for s, e in spans if at else []:
            if hit := [j for j in at[s:e] if j is not None]:
                ranges.append((w, c, s, e, min(hit), max(hit) + 1, round(want[w, c][2] / len(a), 9)))
    assert any(v[1] is None for v in want.values()) and any(v[1] for v in want.values())
    assert {(x["work"], x["chapter"]): (x["words"], x["at"], x["same"]) for x in aligned.collect()} == want
    p = spark.createDataFrame(paragraphs, "work int, chapter int, word_start int, word_end int")
    got = forced.paragraph_pairs(aligned, p, ["work", "chapter"]).withColumn("confidence", F.round("confidence", 9))
    assert sorted(map(tuple, got.collect())) == sorted(ranges)
    known = {w: [x for x in v if x is not None] for w, v in conf.items()}
    said = {x["work"]: (x["chapters"], x["skipped"], round(x["confidence"], 9)) for x in forced.work_confidence(aligned, "work").collect()}
    assert said == {w: (len(known[w]), len(v) - len(known[w]), round(sum(known[w]) / len(known[w]), 9)) for w, v in conf.items() if known[w]}


def test_query_equals_the_full_table(spark, tmp_path):
    texts = ["One two, three four five six seven eight nine ten eleven twelve thirteen.\n\nSecond line of it!", "", None, "word " * 40, "a\nb c d e f"]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{tmp_path}/documents.parquet")
    want = []
    for d, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            a = [w.lower().strip(".,!") for w in line.split()]
            b = [s for k, w in enumerate(a) for s in ([] if k % 11 == 4 else [w, "um"] if k % 13 == 6 else ["uh"] if k % 17 == 9 else [w])]
            if not a or not b:
                continue
            at = full_table(a, b)
            c = round(sum(j is not None and a[k] == b[j] for k, j in enumerate(at)) / len(a), 6)
            for s in range(0, len(a), 10):
                if hit := [j for j in at[s : s + 10] if j is not None]:
                    want.append((d, i, s, min(s + 10, len(a)), min(hit), max(hit) + 1, c))
    assert sorted(map(tuple, plans.forced_alignment(spark, str(tmp_path)).collect())) == sorted(want)


def test_a_chapter_of_thousands_of_words():
    x = [f"w{i % 911}" for i in range(3000)]
    y = x[:1000] + ["um"] * 7 + x[1020:]
    at = forced.best_path(x, y)
    assert (at[:1000] == range(1000)).all() and (at[1020:] == range(1007, 2987)).all()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_spans_meet_as_in_all_pairs(spark, width):
    r = random.Random(width)
    span = lambda: (a := r.randint(-30, 200), a + r.choice([0, 1, 3, 20, 90]))
    left = [(r.choice("hhhx"), i, *span()) for i in range(120)] + [("h", 900, None, 3), ("h", 901, 5, None)]
    right = [(r.choice("hhhy"), i, *span()) for i in range(120)] + [("h", 900, 2, None)]
    got = rel.span_join(spark.createDataFrame(left, "k string, i int, a int, b int"), spark.createDataFrame(right, "k string, j int, c int, d int"), ["k"], "a", "b", "c", "d", width)
    want = [(k, i, j) for k, i, a, b in left for q, j, c, d in right if k == q and None not in (a, b, c, d) and c < b and d > a]
    assert sorted((x["k"], x["i"], x["j"]) for x in got.collect()) == sorted(want)


def test_paths_of_many_pairs_together():
    r = random.Random(11)
    pairs = [(random_words(r, r.randint(0, 24)), random_words(r, r.randint(0, 24))) for _ in range(300)]
    pairs.append((random_words(r, 600), random_words(r, 500)))
    got = forced.paths_of([x for x, _ in pairs], [y for _, y in pairs], 400_000)
    assert [p.tolist() for p in got] == [forced.best_path(x, y).tolist() for x, y in pairs]
    assert [p.tolist() for p in forced.best_paths(pairs[:300])] == [p.tolist() for p in got[:300]]
    assert forced.paths_of([["a"] * 30], [["a"] * 30], 100) == [None]
