"""The five stages on edge rows, each against what its operator decides."""

import corpus_pipeline as cp
import pytest

from .conftest import PASSAGE


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    words = lambda lang, i, n=40: " ".join(f"{lang}{(i * 31 + k * 7) % 211}x" for k in range(n))
    rows = [(i, words(lang, i), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr", "es"] * 20)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, None, "en", None, None), (102, "", "en", "s", 0), (103, "123 456", "en", "s", 0)]
    rows += [(104, words("en", 900, 60) + " " + PASSAGE, "en", "s", 0), (105, words("en", 950, 70) + " " + PASSAGE, "en", "s", 0), (106, words("en", 999, 30) + " quick brown foxes never eat the seven lazy dogs of town hall today", None, "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "Quick brown foxes never eat the seven lazy dogs of town hall today")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if i + 1 < len(cp.STAGES):
            assert out.columns == list(cp.COLUMNS)
            out.write.parquet(f"{folder}/out-{name}")
            out = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert not {101, 102, 103} & seen["language"].keys() and len(seen["language"]) == 84
    assert 0 in seen["near_duplicates"] and 100 not in seen["near_duplicates"] and len(seen["near_duplicates"]) == 83
    cut = seen["repeated_passages"]
    assert len(cut) == 83 and "committee" not in cut[104]["text"] and cut[104]["n_chars"] == len(cut[104]["text"])
    assert cut[5]["text"] == seen["near_duplicates"][5]["text"]
    assert seen["repeated_passages"].keys() - seen["decontamination"].keys() == {106}
    assert seen["tokens"].keys() == seen["decontamination"].keys()


def test_run_equals_stages_and_empty_table(spark, folder, tmp_path):
    assert cp.run(spark, folder).count() == 82
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_with_shared_identifiers(spark, folder):
    item = "Quick brown foxes never eat the seven lazy dogs of town hall today"
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))
    other = one + " other words stand here at last, more of them now"  # 26 of 35 shingles: no near copy
    rows = [(None, one), (None, one), (None, two), (7, two), (9, three), (9, three), (9, other), (9, one + " three more words"), (None, item), (3, "seven other words stand before this one: " + item), (3, one)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicate_stage(spark, docs, folder)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("3", one), ("7", two), ("9", three), ("9", other), ("None", item), ("3", "seven other words stand before this one: " + item)])
    clean = cp.decontamination_stage(spark, kept, folder)
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == sorted([("3", one), ("7", two), ("9", three), ("9", other)])


def test_near_copies_by_five_word_shingles_go(spark, folder):
    words = lambda i: [f"w{i}x{k * k % 997}" for k in range(160)]
    rows = []
    for i in range(12):
        near, far = words(i), words(i)
        near[40], near[90] = "changed", "again"  # 146 of 166 shingles are shared
        for k in range(5, 160, 20):
            far[k] = f"other{k}"  # under 0.8
        rows += [(3 * i, " ".join(words(i))), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, folder).collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


def test_short_near_copies_go(spark, folder):
    words = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "tail"])), (3, " ".join([*words[:6], "changed", *words[7:]])), (4, "one two three"), (5, "one two three four"), (6, "one  two three")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, folder).collect()}
    assert kept == {1, 3, 4, 5}  # 10 of 11 shingles; 5 of 15; one shingle each


def test_passages_of_51_words_go_and_clean_texts_stay(spark, folder):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    short, most = words("p", 51), words("q", 50)  # under 400 bytes each
    rows = [(1, f"{words('a', 30)} {short} {words('b', 9)}"), (2, f"{short}\n{words('c', 40)}"), (3, f"{words('d', 30)} {most} tail"), (4, f"{words('e', 30)} {most} end"), (5, "\n" + short), (6, words("f", 20))]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r["doc_id"]: r["text"] for r in cp.repeated_passage_stage(spark, docs, folder).collect()}
    assert cut == {1: f"{words('a', 30)} {words('b', 9)}", 2: words("c", 40), 3: rows[2][1], 4: rows[3][1], 6: rows[5][1]}


def test_passage_stage_takes_one_python_worker_a_task(spark, folder):
    passage = "é" * 210  # over 400 bytes; the characters ahead of it share their last byte, which goes
    rows = [(1, "one éx" + passage), (2, "two ũx" + passage), (3, "ab界" * 60 + "x"), (4, "cd界" * 60 + "y"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = cp.repeated_passage_stage(spark, docs, folder)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {1: ("one ", 4), 2: ("two ", 4), 3: (rows[2][1], 181), 4: (rows[3][1], 181)}
    plan = cut._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
