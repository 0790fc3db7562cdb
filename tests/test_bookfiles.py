"""Books, transcripts and archives read as a source: good, damaged and unsafe ones; ways between books against a search by breadth."""

import json
import os
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from quire.operators import paths
from quire.sources import bookfiles as bf

from .test_intake import epub


def test_archives_good_damaged_and_unsafe(spark, tmp_path):
    chapters = [(1, 0, "One", "<p>é</p>"), (1, 1, "One", "<p>b</p>"), (2, 5, "Two", "<p>only</p>"), (3, 0, "Three", "x" * 100_000)]
    df = spark.createDataFrame(chapters, "work int, idx int, title string, html string")
    root = f"file://{tmp_path}/in"
    sizes = {r["work"]: r["size"] for r in bf.pack(df, root, "work").collect()}
    assert {w: os.path.getsize(f"{tmp_path}/in/{w}.abook") for w in (1, 2, 3)} == sizes and len(os.listdir(f"{tmp_path}/in")) == 3
    before = {w: open(f"{tmp_path}/in/{w}.abook", "rb").read() for w in (1, 2, 3)}
    bf.pack(df.repartition(3), root, "work").collect()
    assert before == {w: open(f"{tmp_path}/in/{w}.abook", "rb").read() for w in (1, 2, 3)}

    (tmp_path / "in/broken.abook").write_bytes(before[3][: len(before[3]) // 2])
    (tmp_path / "in/none.abook").write_bytes(b"")
    (tmp_path / "in/note.txt").write_text("passed over")
    with zipfile.ZipFile(tmp_path / "in/evil.abook", "w") as z:
        z.writestr("manifest.json", json.dumps({"checksums": {"text/a.html": "sha256:00", "text/gone.html": "sha256:11"}}))
        for name in ("../evil.txt", "/etc/evil", "a/../../evil", "C:\\evil", "text/a.html", "extra.html"):
            z.writestr(name, "data")
    os.makedirs(tmp_path / "in/deep")
    (tmp_path / "in/deep/2.abook").write_bytes(before[2])
    got = bf.read(spark, "archive", root).select(F.regexp_replace("path", ".*/in/", "").alias("path"), "member", "size", "state", F.col("content").isNull().alias("bare")).collect()
    states = {(r["path"], r["member"]): r["state"] for r in got}
    assert all(r["bare"] for r in got)
    assert states[("1.abook", "text/chapter-001.html")] == states[("deep/2.abook", "text/chapter-001.html")] == "ok" and states[("1.abook", "manifest.json")] == "manifest"
    assert states[("broken.abook", None)] == states[("none.abook", None)] == "damaged"
    assert {m: s for (p, m), s in states.items() if p == "evil.abook"} == {
        "manifest.json": "manifest", "../evil.txt": "unsafe", "/etc/evil": "unsafe", "a/../../evil": "unsafe", "C:\\evil": "unsafe", "text/a.html": "changed", "extra.html": "unlisted", "text/gone.html": "missing",
    }

    out = bf.unpack(bf.read(spark, "archive", root, content=True), f"file://{tmp_path}/out")
    said = {os.path.basename(r["path"]): (r["members"], r["refused"]) for r in out.where("path not like '%deep%'").collect()}
    assert said == {"1.abook": (3, None), "2.abook": (2, None), "3.abook": (2, None), "broken.abook": (0, "damaged"), "none.abook": (0, "damaged"), "evil.abook": (0, "changed, missing, unsafe")}
    assert open(f"{tmp_path}/out/1.abook/text/chapter-001.html").read() == "<p>é</p>"
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["1.abook", "2.abook", "3.abook"]


def test_members_whose_data_is_broken(spark, tmp_path):
    raw = bytearray(bf.packed("t", [("text/a.html", os.urandom(5000)), ("text/b.html", b"fine")]))
    raw[1500:1600] = bytes(100)
    (tmp_path / "x.abook").write_bytes(raw)
    states = {r["member"]: r["state"] for r in bf.read(spark, "archive", f"file://{tmp_path}").collect()}
    assert states["text/a.html"] in ("damaged", "changed") and states["text/b.html"] == "ok"


def test_books_and_transcripts_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub(["<h1>Own</h1><p>one</p>", "<p>two</p>"], meta="<title>T</title>"))
    (tmp_path / "b.EPUB").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("other", "x")
    rows = sorted(map(tuple, bf.read(spark, "epub", f"file://{tmp_path}").select(F.substring_index("path", "/", -1), "chapter_idx", "title", "html", "fault").collect()), key=str)
    assert rows == [("a.epub", 0, "Own", "<h1>Own</h1><p>one</p>", None), ("a.epub", 1, "T", "<p>two</p>", None), ("b.EPUB", None, None, None, "damaged"), ("c.epub", None, None, None, "no chapters")]
    files = {
        "one": {"segments": [{"words": [{"word": " a", "start": 0, "end": 0.5, "probability": 0.9}]}]}, "two": {"words": [{"text": "c", "s": 0.0, "e": 0.4, "confidence": 0.7}], "silences": [{"start": 1.0, "end": 4.5}, {"start": 5, "end": 5.4, "kind": "odd"}, {"start": 6, "end": 6.1}]},
        "three": {"version": 3, "words": [], "duration": 7}, "nine": {"version": 9}, "list": [1], "odd": {"words": [{"word": "x", "start": "soon"}]},
    }
    for name, x in files.items():
        (tmp_path / f"{name}.stt.json").write_text(json.dumps(x))
    (tmp_path / "cut.stt.json").write_text('{"words": [')
    got = {os.path.basename(r["path"]).split(".")[0]: r for r in bf.read(spark, "sidecar", f"file://{tmp_path}").collect()}
    assert [tuple(w) for w in got["one"]["words"]] == [("a", 0.0, 0.5, 0.9)] and got["one"]["made_by"] == "upgraded from 1" and got["one"]["duration"] == 0.5
    assert [q["kind"] for q in got["two"]["silences"]] == ["chapter", "odd", "breath"] and got["two"]["made_by"] == "upgraded from 2"
    assert got["three"]["duration"] == 7.0 and got["three"]["made_by"] == "read" and got["three"]["fault"] is None
    assert {n: got[n]["fault"] for n in ("nine", "list", "cut", "odd")} == {"nine": "unknown version 9", "list": "damaged", "cut": "damaged", "odd": "not a transcript: ValueError"}


def test_partitions_by_size_and_wrong_kinds(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.abook").write_bytes(bf.packed(str(i), [("text/a.html", os.urandom(3000))]))
    bf.register(spark)
    df = spark.read.format("bookfiles").option("kind", "archive").option("partitionBytes", "7000").load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 12
    assert bf.read(spark, "epub", f"file://{tmp_path}").count() == 0
    with pytest.raises(Exception, match="kind must be one of"):
        spark.read.format("bookfiles").option("kind", "film").load(f"file://{tmp_path}").count()


def shortest(edges, start):
    """First way found by breadth, edges in order of their identifiers."""
    ways, queue = {start: []}, deque([start])
    while queue:
        node = queue.popleft()
        for i, a, b in sorted(edges):
            for x, y, back in ((a, b, False), (b, a, True)):
                if x == node and y not in ways and a != b:
                    ways[y] = [*ways[node], (i, back)]
                    queue.append(y)
    return {k: v for k, v in ways.items() if k != start}


def test_ways_equal_a_search_by_breadth(spark):
    r = random.Random(11)
    links = [(w, u, i, r.randint(1, 6), r.randint(1, 6)) for w in range(25) for i in range(7) for u in [r.choice(["word", "paragraph"])]]
    want = {}
    for w in range(25):
        for u in ("word", "paragraph"):
            edges = [(i, a, b) for x, y, i, a, b in links if (x, y) == (w, u)]
            for start in range(1, 7):
                want |= {(w, u, start, k): (len(v), [i for i, _ in v], [x for _, x in v]) for k, v in shortest(edges, start).items()}
    df = spark.createDataFrame(links, "work int, unit string, id int, from_book int, to_book int")
    assert {(x["work"], x["unit"], x["a"], x["b"]): (x["hops"], x["ids"], x["reversed"]) for x in paths.alignment_paths(df).collect()} == want
    asked = spark.createDataFrame([(w, "word", 1, b) for w in range(25) for b in (1, 2, 3)], "work int, unit string, a int, b int")
    got = {(x["work"], x["b"]): (x["id"], x["reversed"]) for x in paths.direct(df, asked).collect()}
    assert got == {(w, b): (v[1][0], v[2][0]) for (w, u, a, b), v in want.items() if u == "word" and a == 1 and b in (2, 3) and v[0] == 1}
