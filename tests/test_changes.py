"""Changes over all tables, publishing, and works imported anew."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import changes as ch
from quire.operators import reimport as ri


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def library(spark):
    make = lambda data, kind: spark.createDataFrame(data, kind)
    return {
        "works": make([(1, "one", "old", 10), (2, "two", "old", 21), (3, "three", "old", None)], "id long, title string, content_version string, display_text_book_id long"),
        "books": make([(10, 1), (11, 1), (20, 2), (21, 2), (22, 2)], "id long, work_id long"),
        "chapters": make([(10, 0), (20, 0), (21, 0), (21, 1)], "book_id long, idx int"),
        "alignments": make([(1, 10, 11), (2, 20, 21), (2, 21, 22), (2, 20, 22)], "work_id long, from_book_id long, to_book_id long"),
        "bookmarks": make([(1, 10), (2, 21), (2, None)], "work_id long, book_id long"),
        "playback_positions": make([(1, 7, 100), (2, 7, 200), (2, 8, 300), (3, 8, 50)], "work_id long, user_id long, word long"),
        "characters": make([(1, 1, 10, "Ann"), (2, 2, 21, "Bob")], "id long, work_id long, book_id long, name string"),
        "character_mentions": make([(1, 5), (2, 6), (9, 7)], "character_id long, n int"),
    }


def test_merge_moves_everything_and_keeps_the_targets_rows(spark, library):
    out = ch.merged(library, spark.createDataFrame([(2, 1), (3, 1)], "source long, target long"), "new")
    assert rows(out["works"]) == [(1, "one", "new", 10)]
    assert {r[1] for r in rows(out["books"])} == {1} and out["books"].count() == 5
    assert rows(out["playback_positions"]) == [(1, 7, 100), (1, 8, 50)]
    assert rows(out["alignments"].select("work_id").distinct()) == [(1,)]
    assert rows(out["chapters"]) == rows(library["chapters"])
    for bad in ([(2, 1), (1, 3)], [(2, 1), (2, 3)]):
        with pytest.raises(ValueError, match="is to be merged"):
            ch.merged(library, spark.createDataFrame(bad, "source long, target long"), "new")


def test_split_takes_books_along_and_cuts_edges(spark, library):
    moves = spark.createDataFrame([(21, 9), (22, 9)], "book long, new_work long")
    out = ch.split(library, moves, spark.createDataFrame([(9, "nine")], "id long, title string"), "new")
    assert rows(out["books"]) == [(10, 1), (11, 1), (20, 2), (21, 9), (22, 9)]
    assert rows(out["alignments"]) == [(1, 10, 11), (9, 21, 22)]
    assert rows(out["bookmarks"]) == [(1, 10), (2, None), (9, 21)]
    assert rows(out["works"]) == [(1, "one", "old", 10), (2, "two", "new", None), (3, "three", "old", None), (9, "nine", "new", None)]
    assert rows(out["characters"]) == [(1, 1, 10, "Ann"), (2, 9, 21, "Bob")]
    parted = ch.split(library, spark.createDataFrame([(21, 8), (22, 9)], "book long, new_work long"), spark.createDataFrame([(8, "a"), (9, "b")], "id long, title string"), "new")
    assert rows(parted["alignments"]) == [(1, 10, 11)]


def test_deletes_cascade_and_sweeps_find_what_is_left_over(spark, library):
    less = ch.without_books(library, spark.createDataFrame([(21,)], "id long"))
    assert rows(less["chapters"]) == [(10, 0), (20, 0)] and rows(less["alignments"]) == [(1, 10, 11), (2, 20, 22)]
    assert rows(less["bookmarks"]) == [(1, 10), (2, None)] and rows(less["character_mentions"]) == [(1, 5)]
    gone = ch.without_works(library, spark.createDataFrame([(2,)], "id long"))
    assert rows(gone["books"]) == [(10, 1), (11, 1)] and rows(gone["playback_positions"]) == [(1, 7, 100), (3, 8, 50)]
    broken = library | {"books": library["books"].where("id <> 21"), "works": library["works"].where("id <> 3")}
    swept = ch.swept(broken)
    assert rows(swept["character_mentions"]) == [(1, 5)] and rows(swept["playback_positions"]) == [(1, 7, 100), (2, 7, 200), (2, 8, 300)]
    assert rows(swept["alignments"]) == [(1, 10, 11), (2, 20, 22)] and rows(swept["bookmarks"]) == [(1, 10)]


def test_a_library_is_published_whole_or_not_at_all(spark, library, tmp_path):
    root = f"file://{tmp_path}/library"
    assert ch.newest(spark, root) is None
    first = ch.publish(library, root)
    assert ch.newest(spark, root) == first and rows(ch.opened(spark, root)["books"]) == rows(library["books"])
    fails = F.udf(lambda x: 1 // 0, "int")
    broken = dict(list(library.items())[:3]) | {"jobs": spark.range(3).select(fails("id").alias("x"))}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        ch.publish(broken, root)
    assert ch.newest(spark, root) == first and os.listdir(f"{tmp_path}/library") == ["v00000001"]
    less = ch.without_works(ch.opened(spark, root), spark.createDataFrame([(2,)], "id long"))
    second = ch.publish(less, root)
    assert second.endswith("v00000002") and rows(ch.opened(spark, root)["works"]) == [(1, "one", "old", 10), (3, "three", "old", None)]
    with pytest.raises(FileNotFoundError):
        ch.opened(spark, f"file://{tmp_path}/nothing")


def files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_only_parts_of_works_that_came_anew_change(spark, tmp_path):
    data = [(w, f"a b c d {w}\n\ne f") for w in range(40)]
    books = spark.createDataFrame(data, "work long, text string")
    root = f"file://{tmp_path}/store"
    ri.store(ri.derived(books, "work", "text"), root, "work", parts=16)
    before = files(tmp_path)
    anew = spark.createDataFrame([(3, "one two"), (5, None), (99, "new work here")], "work long, text string")
    for _ in range(2):  # running it again gives the same
        ri.reimport(ri.derived(anew, "work", "text"), anew, root, "work", parts=16)
        now = [(w, t) for w, t in data if w not in (3, 5)] + [(3, "one two"), (99, "new work here")]
        for name, want in ri.derived(spark.createDataFrame(now, "work long, text string"), "work", "text").items():
            assert rows(ri.stored(spark, root, name).drop("part")) == rows(want), name
    touched = {r[0] for r in anew.select(ri.part_of("work", 16)).collect()}
    kept = {f: t for f, t in before.items() if int(f.split("part=")[1].split("/")[0]) not in touched}
    after = files(tmp_path)
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert not any(f in after for f in before if f not in kept)


def test_a_part_that_is_left_without_rows_goes(spark, tmp_path):
    books = spark.createDataFrame([(1, "a b"), (2, "c")], "work long, text string")
    root = f"file://{tmp_path}/store"
    ri.store(ri.derived(books, "work", "text"), root, "work", parts=1000)
    gone = spark.createDataFrame([(1, "")], "work long, text string")
    ri.reimport(ri.derived(gone, "work", "text"), gone, root, "work", parts=1000)
    assert rows(ri.stored(spark, root, "chapters").select("work", "words")) == [(2, 1)]
