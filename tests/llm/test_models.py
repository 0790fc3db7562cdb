"""Classifiers, extraction, search and scoring: held-out accuracy, brute force and edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import hnsw, htmltext, langid, lm_score, quality, trees

WORDS = {
    "en": "the of and to in is that with for was this they have from not are but which one all were when there can an your said use each".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für man aber".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus mettre".split(),
    "es": "el de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este".split(),
}


def sentence(lang, r, n=30):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(3)
    rows = [(i, sentence(lang, r), lang) for i, lang in enumerate(list(WORDS) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(languages):
    model = langid.train(languages, langid.learnable())
    held = langid.predict(languages, model, keep=("doc_id", "lang")).where(~langid.learnable()).collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    assert set(model.families) == {"germanic", "romance"}


def test_language_edge_rows(docs, no_docs, languages):
    model = langid.train(languages)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5))
    assert by[1]["lang_pred"] in WORDS
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.train(languages.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(languages, one).collect()} == {"en"}


def test_rules_held_out_and_compiled(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        good = i % 4 != 0
        text = sentence("en", r, 60).capitalize() + "." if good else r.choice([" | ".join(WORDS["en"]), sentence("de", r).upper() + "!!", "%%% *** &&& " * 20])
        rows.append((i, text, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    stats = quality.with_statistics(df)
    labels = df.select("doc_id", F.col("y").alias("quality"), F.lit("x").alias("upper"))
    model = quality.train(stats, labels, quality.learnable())
    assert 0 < len(model.rules) < 200
    held = stats.withColumn("p", model.score()).join(df.select("doc_id", "y"), "doc_id").where(~quality.learnable()).collect()
    assert sum((x["p"] >= quality.THRESHOLD) == (x["y"] == 1) for x in held) >= 0.97 * len(held)
    x = held[0]
    margin = model.bias + sum(w for w, cs in model.rules if all((x[s] <= b) if sign == "<=" else (x[s] > b) for s, sign, b in cs))
    assert x["p"] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_quality_edge_rows(docs, no_docs, spark):
    stats = quality.with_statistics(docs)
    assert stats.count() == docs.count()
    none = spark.createDataFrame([(1, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(stats, none, quality.learnable())
    assert {round(r["s"], 6) for r in stats.select(model.score().alias("s")).collect()} == {0.5}
    assert quality.with_statistics(no_docs).count() == 0


def test_boosted_trees_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6))
    y = ((x[:, 1] > 0.4) & (x[:, 4] < 0.7)).astype(float)
    forest = trees.fit(x[:1500], y[:1500])
    assert ((forest.margin(x[1500:]) > 0) == (y[1500:] == 1)).mean() > 0.97


def whole(nodes, runs):
    return htmltext.text_of(nodes, runs, [True] * len(nodes))


@pytest.mark.parametrize(("family", "least"), [(htmltext.training_page, 92), (htmltext.table_page, 85), (htmltext.reference_page, 85), (htmltext.stray_page, 85)])
def test_main_text_of_unseen_generated_pages(family, least):
    forest, right = htmltext.model(), 0
    for seed in range(5000, 5100):
        page = family(seed)
        nodes, runs = htmltext.parse(page)
        want = whole(nodes, [(i, t if t is None or "\x01" in t else "") for i, t in runs]).replace("\x01", "").replace("\x02", "")
        right += htmltext.main_texts([page.replace("\x01", "").replace("\x02", "")], forest) == [want]
    assert right >= least


HEAD, TWO = "<h1>Head of it</h1>", "<p>One paragraph of some words here, and more of them.</p><p>Another paragraph follows with several words too.</p>"
SAID = "Head of it One paragraph of some words here, and more of them. Another paragraph follows with several words too."


@pytest.mark.parametrize(("page", "want"), [
    (f"<html><body><article>{HEAD}{TWO}</article></body></html>Copyright 2020 Example Corp.", SAID),
    (f"<html><body><article>{HEAD}{TWO}</article>Copyright 2020 Example Corp.</body></html>", SAID),
    (f"<html><body>Home | News | About <article>{HEAD}{TWO}</article></body></html>", SAID),
    (f'<body><a href="/">Home</a> | <a href="/n">News</a> | <a href="/a">About</a><hr><main>{HEAD}{TWO}</main></body>', SAID),
    ("<html><body>Home | News | About <article><p>One short paragraph.</p></article></body></html>", "One short paragraph."),
    (f"<body><div>Home | News</div><article>First free text of the article, some words long. {TWO}And free text again, to end the article.</article>&copy; 2020 Example Corp. All rights reserved.</body>", f"First free text of the article, some words long. {SAID.removeprefix('Head of it ')} And free text again, to end the article."),
    (f'<body><nav>Home News</nav><article>{HEAD}<p>Mixed <b>bold <i>and</i></b> <a href="x">linked</a> words, all of them of one line.</p></article><footer>&copy; e.example.com</footer></body>', "Head of it Mixed bold and linked words, all of them of one line."),
])
def test_pages_written_by_hand(page, want):
    assert htmltext.main_texts([page], htmltext.model()) == [want]


def test_free_text_is_a_node_between_blocks():
    nodes, runs = htmltext.parse("<div>a <b>c</b> d<p>e</p> f<br>g<hr>h</div> ")
    shown = [(nodes[i].tag, nodes[nodes[i].parent].tag, t) for i, t in runs if t and t.strip()]
    free = htmltext.FREE
    assert shown == [(free, "div", "a "), ("b", free, "c"), (free, "div", " d"), (free, "p", "e"), (free, "div", " f"), (free, "div", "g"), (free, "div", "h")]
    places = [i for i, t in runs if t and t.strip()]
    assert places[0] == places[2] and places[4] == places[5] and len({places[0], places[4], places[6]}) == 3


def test_time_grows_with_length_alone():
    """Pages that would be read over and over: each takes seconds at a megabyte, not hours."""
    import time

    forest = htmltext.model()
    hostile = ["<a " * 330_000, "<a " * 330_000 + "'>", "<a " * 330_000 + '">"', "<div>" * 100_000 + "<p>x</i>" * 50_000, "<i><table>" + "<div>" * 80_000 + "</i>" * 80_000, "<!--" * 250_000, "<a '>" * 200_000]
    for page in hostile:
        began = time.process_time()
        htmltext.main_texts([page], forest)
        assert time.process_time() - began < 40


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A  head &amp; more</h1><p><b>First</b>ly&nbsp;some text, with <i>marks</i> &lt;here&gt;.<br>Next line of the text.<p>Unclosed paragraph of some length follows here.
<p>It&#39;s the &eacute;nd of this article, and it has enough words.</article><footer>&copy; example</footer>"""


def test_page_rules(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<html><script>x</script>"), (None, "u", PAGE), (5, "u", "<p>" * 3000), (6, "u", "< < &")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    want = "A head & more Firstly some text, with marks <here>. Next line of the text. Unclosed paragraph of some length follows here. It's the énd of this article, and it has enough words."
    assert got[1] == want and got[None] == want
    assert got[2] == got[3] == got[4] == got[5] == ""
    assert htmltext.extract(df.where("false")).count() == 0


def test_nothing_kept_inside_dropped():
    nodes = [htmltext.Node("html", -1, 0), htmltext.Node("div", 0, 1), htmltext.Node("p", 1, 2), htmltext.Node("p", 0, 1)]
    for n in nodes:
        n.own = 50
    kept = htmltext.decode(nodes, np.array([1.0, -9.0, 2.0, 1.0]))
    assert kept == [True, False, False, True]
    kept = htmltext.decode(nodes, np.array([1.0, -1.0, 2.0, -1.0]))
    assert kept == [True, True, True, False]


def brute_nearest(vectors, k):
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            out[i] = sorted((-float(np.dot(v, w)), j) for j, w in vectors if j != i)[:k]
    return out


def test_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    v = [(i, centres[i % 20] + 0.4 * rng.normal(size=16)) for i in range(900)]
    same = [(i, np.ones(16) * 2) for i in range(2000, 2300)]
    rows = [(i, [float(x) for x in w]) for i, w in v + same]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 16), (5004, [float("nan")] + [1.0] * 15), (5005, [None] + [1.0] * 15), (5006, [1.0]), (None, [1.0] * 16), (5007, [float("inf")] + [1.0] * 15), rows[0]]
    df = spark.createDataFrame([(i, w, 0, "clash") for i, w in rows + odd], "vec_id long, embedding array<double>, label int, raw string")
    got = hnsw.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_size=256).collect()
    want = brute_nearest(v + same, 20)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hits = 0
    for q, rs in by.items():
        rs.sort()
        assert [x[0] for x in rs] == list(range(1, 21)) and q not in {x[1] for x in rs}
        assert [(-s, i) for _, i, s in rs] == sorted((-s, i) for _, i, s in rs)
        hits += len({x[1] for x in rs} & {j for _, j in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    assert [i for _, i, _ in by[2000]] == list(range(2001, 2021))


def test_search_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.1])], kind)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 2.0), (2, 1, 0.5)]
    empty = spark.createDataFrame([], kind)
    assert hnsw.nearest(empty, empty).count() == 0
    assert hnsw.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_rows_that_share_an_identifier(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(df, df.where("vec_id = 0")).collect())
    assert got == sorted([(1, 1, 2.0), (2, 2, 1.0), (3, 0, 0.0), (1, 2, 3.0), (2, 1, 1.0), (3, 0, 0.0)])


def test_pseudo_likelihood_equals_brute_force_and_sums_to_one(languages, docs, no_docs):
    net = lm_score.train(languages, vocabulary=60)
    texts = [lm_score.words_of("the of zebra and to in"), lm_score.words_of("der")]
    ids = net.ids(texts)
    at = np.array([p for a, n in lm_score._places(texts) for p in range(a, a + n)])
    brute = []
    for p in at:
        total = []
        for w in range(len(net.log_class)):
            changed = ids.copy()
            changed[p] = w
            total.append(net.log_probability(changed, np.array([p]))[0])
        assert np.exp(total).sum() == pytest.approx(1, abs=1e-4)
        brute.append(total[ids[p]])
    assert net.log_probability(ids, at) == pytest.approx(brute, abs=1e-5)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, net).collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["log_prob"] == 0 and rows[3]["mean_log_prob"] is None
    assert rows[16]["n_words"] == 20000 and rows[16]["log_prob"] < 0
    fluent, noise = lm_score.score(languages.limit(40), net).agg(F.avg("mean_log_prob")).first()[0], rows[16]["mean_log_prob"]
    uniform = -math.log(len(net.log_class))
    assert fluent > uniform and math.isfinite(noise)
    assert lm_score.score(no_docs, lm_score.train(no_docs)).count() == 0


def test_network_beats_word_frequencies_on_held_out_texts(spark):
    """Words that follow one another in pairs: what stands beside a word tells more than how often it occurs."""
    r = random.Random(8)
    pairs = [(f"a{i}", f"b{i}") for i in range(30)]
    text = lambda: " ".join(w for _ in range(40) for w in r.choice(pairs))
    learnt = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").repartition(3)
    held = [text() for _ in range(40)]
    net = lm_score.train(learnt, vocabulary=60, rounds=3)
    counts = {bytes(x["word"]): x["n"] for x in lm_score.word_counts(learnt).collect()}
    total = sum(counts.values())
    unigram = np.mean([math.log(counts[w] / total) for t in held for w in lm_score.words_of(t)])
    rows = lm_score.score(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), net).collect()
    assert sum(x["log_prob"] for x in rows) / sum(x["n_words"] for x in rows) > unigram + 0.3


def test_word_counts_cover_every_text(docs):
    from collections import Counter

    from .conftest import edge_texts

    want = Counter(w for _, t, _ in edge_texts() for w in lm_score.words_of(t))
    assert {bytes(r["word"]): r["n"] for r in lm_score.word_counts(docs).collect()} == dict(want)


def test_training_covers_every_position(spark, docs):
    from .conftest import edge_texts

    net = lm_score.Network.create([(b"one", 3), (b"two", 1)], 10)
    border, shared = len(net.log_class), spark.sparkContext.broadcast(net)
    kind = "block long, task long, seen long, part binary"
    short = [("one",), ("one two",), ("one two three",), ("a b c d e f",), ("a b c d e f g h",)]
    for df, want in ((docs, sum(len(lm_score.words_of(t)) for _, t, _ in edge_texts())), (spark.createDataFrame(short, "text string"), 20)):
        rows = lm_score.numbered(df, net)
        for shard, chunk in ((lm_score.SHARD, lm_score.CHUNK), (want // 12, 3)):
            runs = lm_score.dealt(rows, want, border, shard, chunk)
            inner = runs.selectExpr("sum(length(codes) div 4 - 4) AS n").first()["n"]
            parts = runs.groupBy("part", "shard").applyInArrow(lm_score._train_shard(shared, 0, 1 << 30), kind)
            assert inner == want == parts.agg(F.sum("seen")).first()[0]


def test_network_and_scores_do_not_depend_on_partitions(spark, languages):
    rows = languages.select("doc_id", "text").unionByName(spark.createDataFrame([(7, "of the to")] * 30 + [(None, "in that")], "doc_id long, text string"))
    found = []
    for n in (1, 4, 16, 64):
        net, codes = lm_score.fit(rows.repartition(n), vocabulary=60, spell=True, shard=500)
        scored = lm_score.score_numbered(codes, net).collect()
        found.append(sorted((str(r["doc_id"]), r["log_prob"]) for r in scored))
        assert sorted((str(r["doc_id"]), round(r["log_prob"], 6)) for r in lm_score.score(rows, net).collect()) == [(i, round(x, 6)) for i, x in found[-1]]
    for other in found[1:]:
        assert [i for i, _ in other] == [i for i, _ in found[0]]
        assert [x for _, x in other] == pytest.approx([x for _, x in found[0]], abs=1e-3)


def test_a_text_of_many_runs(spark):
    text = " ".join(f"w{i % 37}" for i in range(130_000))
    df = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    net, rows = lm_score.fit(df, vocabulary=30)
    got = {r["doc_id"]: r for r in lm_score.score_numbered(rows, net).collect()}
    assert got[1]["n_words"] == 130_000 and got[2]["log_prob"] < 0
    assert lm_score.dealt(rows, 130_002, len(net.log_class)).count() == 4


def test_words_outside_the_vocabulary_have_probabilities_of_their_own(spark):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "the catan and the dog", "the xqzv and the dog", "the the and and", "the the and and catan cat"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net = lm_score.train(df, vocabulary=2, spell=True)
    assert set(net.words) == {b"the", b"and"} and np.exp(net.table.astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4)
    counts = Counter()
    for w in ["cat", "dog", "catan", "dog", "xqzv", "dog", "catan", "cat"]:
        for x, y, z in zip("  " + w, " " + w, w + " ", strict=False):
            counts[ord(y), (ord(x) ^ ord(x) >> 4) & 15, ord(z)] += 1
    totals = Counter()
    for (y, x, _), n in counts.items():
        totals[y, x] += n

    def spell(w):
        keys = [(ord(y), (ord(x) ^ ord(x) >> 4) & 15, ord(z)) for x, y, z in zip("  " + w, " " + w, w + " ", strict=False)]
        return sum(math.log((counts[k] + 1 / 256) / (totals[k[:2]] + 1)) for k in keys)

    got = {r["doc_id"]: r["log_prob"] for r in lm_score.score(df, net).collect()}
    for i, t in rows:
        words = [lm_score.words_of(t)]
        ids, context = net.ids_and_context(words)
        at = np.arange(lm_score.SPAN, lm_score.SPAN + len(words[0]))
        want = net.log_probability(ids, at, context).sum() + sum(spell(w) for w in t.split() if w not in ("the", "and"))
        assert got[i] == pytest.approx(want, abs=1e-3)
    assert len({round(x, 3) for x in got.values()}) == len(rows)
    a, b = (net.ids_and_context([lm_score.words_of(t)])[1] for _, t in rows[:2])
    assert not np.allclose(net.hidden(a, np.array([2])), net.hidden(b, np.array([2])))


def test_words_split_by_columns_are_those_of_each_text():
    r = random.Random(3)
    texts = ["".join(r.choice("aAbÉİ界 \t\n\v\f\r\x00\x1c\x85   Zz") for _ in range(r.randint(0, 40))) for _ in range(2000)] + [None, "", " ", "  a", "a  "]
    sizes, place, own = lm_score.split_words(pa.array(texts, pa.string()))
    assert len(set(own)) == len(own) and sizes.sum() == len(place)
    for text, end, n in zip(texts, np.cumsum(sizes), sizes, strict=True):
        assert [own[i] for i in place[end - n : end]] == lm_score.words_of(text)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    pieces = list(lm_score._pieces([batch, batch.slice(0, 0), batch.slice(7, 9)], 0))
    assert len(pieces) == 2 and sum((p.column(0).to_pylist() for p in pieces), []) == texts + texts[7:16]


def test_a_word_scores_the_same_beside_any_others():
    net = lm_score.Network.create([(f"w{i}".encode(), 900 - i) for i in range(800)], 500)
    rng = np.random.default_rng(5)
    for x in (net.embed, net.by_class, net.by_word):
        x += rng.normal(0, 0.5, x.shape).astype(np.float32)
    ids = rng.integers(0, 801, 3000).astype(np.int32)
    at = np.arange(lm_score.SPAN, 3000 - lm_score.SPAN)
    whole = net.log_probability(ids, at)
    for n in (1, 2, 3, 7, 50, 333):
        assert np.array_equal(net.log_probability(ids, at[:n]), whole[:n])


def test_a_step_takes_every_place_of_a_word_off():
    net = lm_score.Network.create([(f"w{i}".encode(), 40 - i) for i in range(30)], 20)
    rng = np.random.default_rng(6)
    for x in (net.by_class, net.by_word):
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
    ids = rng.integers(0, 31, 400).astype(np.int32)
    at = np.arange(lm_score.SPAN, 400 - lm_score.SPAN)
    before = net.embed.copy()
    one, many = net.with_flat(net.flat()), np.zeros(net.embed.shape)
    net.step(ids, ids, at, 1.0)
    for p in at:
        alone = one.with_flat(one.flat())
        alone.step(ids, ids, np.array([p]), 1.0)
        many += alone.embed - before
    assert np.allclose(net.embed - before, many, atol=1e-5) and np.abs(many).max() > 0.01
