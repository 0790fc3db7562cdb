"""Segments, passages and names against brute force and known answers."""

import itertools
import math
import random

from pyspark.sql import functions as F

from quire.operators import alignment as al
from quire.operators import entity


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_names_of_a_cast(spark):
    text = "Then Rose met Mr. Kirwin. We saw Rose again, and Rose smiled. The old Van Helsing came; then Van Helsing left, as Van Helsing does. I met Mr. Kirwin and so did M. Krempe. PREFACE PREFACE. It was Rose's rose and the rose of Mr. Kirwin."
    more = "And Rose spoke. the Rose went."
    both = [("w", 1, text), ("w", 2, more), ("x", 3, "of Rose")]
    want = None
    for data in (both, both[::-1]):
        got = {r["name"]: (r["mentions"], r["in_dictionary"], r["rank"]) for r in entity.cast_names(spark.createDataFrame(data, "work string, doc long, text string").repartition(2), "work", "doc").collect()}
        assert want is None or got == want
        want = got
    assert got["Rose"][0] == 6 and not got["Rose"][1] and got["Van Helsing"][0] == 3 and got["Mr. Kirwin"][0] == 3
    assert "Preface" not in got and "Van" not in got and len(got) == 3
    placed = entity.cast_names(spark.createDataFrame(both, "work string, doc long, text string"), "work", "doc", places=("rose",)).collect()
    assert {r["name"]: r["rank"] for r in placed}["Rose"] == 3


def test_neighbours_stay_within_their_document(spark):
    data = [("w", i, t) for i, t in enumerate(["He met Ann", "Lee went. He met Ann", "Lee and so Ann", "by Lee or Lee or Lee"])]
    got = {r["name"]: r["mentions"] for r in entity.cast_names(spark.createDataFrame(data, "work string, doc long, text string"), "work", "doc").collect()}
    assert got == {"Ann": 3, "Lee": 3}


def brute_chain(matches):
    best = 0
    for k in range(len(matches), 0, -1):
        if any(all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(c)) for c in itertools.combinations(sorted(matches), k)):
            return k
    return best


def test_passages_against_brute_force(spark):
    r = random.Random(6)
    ebook, trans = [], []
    for work in range(6):
        for side, size in ((ebook, r.randint(1, 7)), (trans, r.randint(1, 7))):
            side.extend((work, i, [r.choice((-1.0, 0.0, 1.0)) for _ in range(3)], 8 * i, 8 * i + 10) for i in range(size))
    kind = "work long, i int, v array<double>, start int, end int"
    e, t = spark.createDataFrame(ebook, kind), spark.createDataFrame(trans, kind)
    found = al.passage_matches(e, t, ["work"]).collect()
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v] if any(v) else None
    want = {}
    for work, ti, tv, _, _ in trans:
        sims = [(round(sum(a * b for a, b in zip(unit(tv), unit(ev), strict=True)), 9), ei) for w, ei, ev, _, _ in ebook if w == work and unit(tv) and unit(ev)]
        near = [x for x in sims if x[0] >= 0.6]
        if near:
            want[work, ti] = max(near)[1]
    assert {(m["work"], m["ti"]): m["ei"] for m in found} == want
    chain = al.passage_chain(al.passage_matches(e, t, ["work"]), ["work"])
    by = {}
    for c in chain.collect():
        by.setdefault(c["work"], []).append((c["ei"], c["ti"]))
    for work in {w for w, _ in want}:
        assert len(by[work]) == brute_chain([(ei, ti) for (w, ti), ei in want.items() if w == work])
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(sorted(by[work])))
    segments = al.passage_segments(chain.select("work", "ti", "ei"), e, t, ["work"]).collect()
    for work in by:
        own = sorted((s["es"], s["ee"], s["ts"], s["te"]) for s in segments if s["work"] == work)
        assert own[0][0] == 0 and own[0][2] == 0 and all(a[1] == b[0] and a[3] == b[2] for a, b in itertools.pairwise(own))
        assert own[-1][1] == max(x[4] for x in ebook if x[0] == work) and own[-1][3] == max(x[4] for x in trans if x[0] == work)


def test_fast_chapters_are_not_followed_word_by_word(spark):
    words = [(1, i, 0.01 * i) for i in range(40)] + [(2, i, 0.4 * i if i % 3 else None) for i in range(40)] + [(3, i, None) for i in range(5)] + [(4, i, 1.0) for i in range(5)]
    got = al.word_sync(spark.createDataFrame(words, "c long, w int, sec double"), ["c"])
    by = {}
    for c, w, s, e in rows(got, "c", "w"):
        by.setdefault(c, []).append((w, round(s, 3), round(e, 3)))
    assert set(by) == {2, 4} and by[2][0] == (0, 0.4, 0.7) and by[2][3] == (3, 0.8, 1.6) and by[4][-1] == (4, 1.0, 1.3)


def test_seconds_between_anchors(spark):
    anchors = F.array(*[F.struct(F.lit(f).alias("frac"), F.lit(s).alias("sec")) for f, s in ((0.2, 10.0), (0.5, 20.0), (0.5, 24.0), (1.0, 34.0))])
    fs = [0.0, 0.2, 0.35, 0.5, 0.75, 1.0]
    got = spark.range(1).select(*[al.second_at(anchors, F.lit(f)).alias(str(i)) for i, f in enumerate(fs)]).first()
    assert [round(x, 6) for x in got] == [10.0, 10.0, 15.0, 20.0, 29.0, 34.0]
