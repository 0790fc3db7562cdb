"""Near duplicates, repeated passages and contamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import decontam, graph, simhash, suffix

from .conftest import PASSAGE, edge_texts


def brute_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, most=2):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_components(docs):
    rows = edge_texts()
    codes = [brute_fingerprint(t) for _, t, _ in rows]
    groups = brute_components(codes)
    least = {}
    for g, (i, _, _) in zip(groups, rows, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{c:016x}", str(least.get(g))) for (i, _, _), c, g in zip(rows, codes, groups, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def clustered(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        c = r.choice(centres)
        for _ in range(r.randint(0, 5)):
            c ^= 1 << r.randrange(64)
        out.add(c)
    return sorted(out)


@pytest.mark.parametrize("hot", [10**9, 40])
def test_links_connect_as_all_pairs_do(spark, hot):
    """Both when dealt once and, for crowded blocks, again by thirds of the open bits."""
    codes = clustered(400, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"), hot)
    roots = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    groups = brute_components(codes)
    mine = {}
    for s, g in zip(signed, groups, strict=True):
        mine.setdefault(roots.get(s, s), set()).add(g)
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(groups))


def test_thirds_of_open_bits():
    """Every path shares what its choices name; bits put on top keep all others; linked codes share a third at every turn."""
    r = random.Random(2)
    for path in ("0", "1", "2", "12", "201", "0120"):
        shared, rest = simhash._bits(path)
        assert sorted(shared + rest) == list(range(64)) and abs(len(simhash._bits(path[:-1])[1]) / 3 - (len(shared) - len(simhash._bits(path[:-1])[0]))) < 1
        code = r.getrandbits(64)
        turned = int(simhash._turned(np.array([code], dtype=np.uint64), path)[0])
        assert [turned >> (63 - i) & 1 for i in range(64)] == [code >> b & 1 for b in shared + rest]
    for _ in range(300):
        a = r.getrandbits(64)
        b, path = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), ""
        while len(simhash._bits(path)[1]) > 2:
            same = [p for p in (f"{path}{i}" for i in range(3)) if (a ^ b) & (simhash._mask(p) & (1 << 64) - 1) == 0]
            assert same
            path = r.choice(same)


def test_index_finds_every_pair():
    codes = np.array(clustered(700, 9), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = {(i, j) for a, b in simhash.GrayIndex(codes).links(np.uint64(0)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(int(codes[i]) ^ int(codes[j])).count("1") <= 2}
    assert found == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1051)}


def brute_cut(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot_bytes", [suffix.HOT_BYTES, 2000, 0])
def test_repeats_removed_as_by_brute_force(docs, hot_bytes):
    rows = edge_texts()
    want = sorted((str(i), *w) for (i, _, _), w in zip(rows, brute_cut([t for _, t, _ in rows]), strict=True))
    got = suffix.remove_repeats(docs, hot_bytes=hot_bytes).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def brute_windows(text, words):
    """(first byte that goes, last, window) in bytes of the text."""
    raw = b" " + re.sub(r"[\t\n\v\f\r]", " ", text or "").encode() + b" "
    for i in range(len(raw)):
        if i + 400 <= len(raw):
            yield i - 1, i + 399, raw[i : i + 400]
        found = re.match(rb" [^ ]+(?: +[^ ]+){%d} " % (words - 1), raw[i:])
        if found and len(found[0]) < 400:
            yield i, i + len(found[0]) - 1, found[0]


@pytest.mark.parametrize("hot_bytes", [suffix.HOT_BYTES, 2000, 0])
def test_repeated_words_removed_as_by_brute_force(spark, hot_bytes):
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abcdeé") for _ in range(k))
    some = lambda n: " ".join(word(r.randint(1, 6)) for _ in range(n))
    texts = [t for _, t, _ in edge_texts()] + [some(120)] * 2
    kept, gone = some(50), [some(51), some(55), some(90), " ".join(["a"] * 51)]
    for p in (kept, *gone, "界" * 150, "x" * 30 + word(500), " ".join(word(30) for _ in range(20))):
        texts += [f"{some(r.randint(0, 30))} {p}{end}{some(r.randint(0, 70))}" for end in (" ", "\n", "z ")]
    texts += [some(9) + word(9) + "界" * 160, f"{kept}  {gone[0]}\n", gone[1]]
    own = [list(brute_windows(t, 51)) for t in texts]
    seen = Counter(w for x in own for *_, w in x)
    want = []
    for i, (t, x) in enumerate(zip(texts, own, strict=True)):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        out = np.zeros(len(raw), dtype=bool)
        for first, end, w in x:
            if seen[w] > 1:
                out[max(0, first) : end] = True
        want.append((i, int(out.sum()), bytes(raw[~out])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"], x["n_removed"], bytes(x["kept"])) for x in suffix.remove_repeats(df, hot_bytes=hot_bytes, words=51).collect())
    assert got == want
    left = [k.decode() for _, _, k in got]
    assert sum(kept in k for k in left) == 4 and not any(p + " " in k + " " for p in gone for k in left)


def test_interval_expansion_on_random_strings():
    r = random.Random(11)
    for _ in range(60):
        length, base = r.choice([8, 12, 20]), bytes(r.choice(b"ab\0c") for _ in range(60))
        strings = []
        for _ in range(r.randint(1, 6)):
            a = r.randint(0, 40)
            s = bytearray(base[a : a + r.randint(0, 60)])
            if s and r.random() < 0.7:
                s[r.randrange(len(s))] = r.choice(b"abc")
            strings.append(bytes(s))
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, hit in zip(strings, suffix.repeated_starts(strings, length), strict=True):
            assert hit.tolist() == [seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def brute_overlap(text, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, named = words(text), set(), set()
    for k, t in items:
        iw = words(t)
        for s in range(max(1, len(iw) - n + 1)) if iw else ():
            win = iw[s : s + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if k is not None:
                        named.add(str(k))
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_ROWS, 0])
def test_overlaps_as_by_brute_force(docs, spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    items = [(10, PASSAGE[:300]), (2, "HELLO world it"), (3, None), (4, ""), (5, "École"), (6, "one"), (7, " ".join(f"w{i}" for i in range(40))), (None, "no identifier here"), (8, "one two"), (2, "hello WORLD it"), (9, "never seen words at all in these documents but long enough for several windows of words")]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    got = decontam.overlaps(docs, bench).collect()
    want = sorted((str(i), *brute_overlap(t, items)) for i, t, _ in edge_texts())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got) == want


def test_empty_tables(docs, no_docs, spark):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert suffix.remove_repeats(no_docs).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(docs, bench).where("contaminated or n_hit > 0").count() == 0
    assert decontam.overlaps(docs, bench).count() == docs.count()
    full = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.overlaps(no_docs, full).count() == 0


def test_no_python_in_decontamination(docs, spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    plan = decontam.overlaps(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)
    assert F is not None


def all_similar(texts, size, least):
    sets = {}
    for t in {t for t in texts if t and t.split()}:
        w = t.lower().split()
        k = min(size, len(w))
        sets[t] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    names = sorted(sets)
    near = lambda a, b: (both := len(sets[a] & sets[b])) >= least * (len(sets[a]) + len(sets[b]) - both)
    return {frozenset((a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if near(a, b)}


def test_similar_links_against_all_pairs(spark, docs, no_docs):
    import hashlib

    r = random.Random(21)
    texts = [None, "", " \n ", "one", "ONE", "one two", "a b c d e"]
    for i in range(40):
        base = [f"b{i}w{k}" for k in range(r.choice([9, 30, 120, 240]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([1, 1, 2, 14])):
            copy = list(base)
            for _ in range(r.randint(0, 1 + len(copy) // 80)):
                copy[r.choice([0, -1, r.randrange(len(copy))])] = f"x{r.random()}"
            texts += [" ".join(copy)] * r.choice([1, 2])
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, h string, band string").repartition(3)
    by = {hashlib.md5((t or "").encode()).hexdigest(): t for t in texts}
    got = {frozenset((by[x["src"]], by[x["dst"]])) for x in simhash.similar_links(df, 5, 0.8).collect()}
    want = all_similar(texts, 5, 0.8)
    assert got <= want and len(want) > 150
    groups = lambda links: {x: min(g) for g in _components(links) for x in g}
    mine, theirs = groups(got), groups(want)
    assert sum(mine.get(x) == y for x, y in theirs.items()) >= 0.97 * len(theirs)
    small = {p for p in want if sum(bool(p & q) for q in want) < 3}
    assert small and len(got & small) >= 0.97 * len(small)
    assert simhash.similar_links(no_docs, 5, 0.8).count() == 0
    assert simhash.similar_links(docs, 5, 0.8).count() >= 0


def _components(links):
    groups = []
    for a, b in map(tuple, links):
        joined = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in joined] + [set().union({a, b}, *joined)]
    return groups


def test_similar_links_in_the_middle_of_large_bands(spark, monkeypatch):
    """Texts that share two thirds of their shingles fill large bands; near copies among them are linked, whatever their hashes."""
    import hashlib
    from collections import defaultdict

    r = random.Random(5)
    texts = []
    for f in range(6):
        common = [f"f{f}w{k}" for k in range(150)]
        for i in range(30):
            own = [*common, *(f"f{f}o{i}w{k}" for k in range(36))]
            texts.append(" ".join(own))
            if i % 3 == 0:
                own[160 + r.randrange(20)] = "changed"
                texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    by = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    bands = {t: {(b, v) for b, v in enumerate(simhash.band_values(simhash.shingle_hashes(t, 5)).tolist())} for t in texts}
    want = {p for p in all_similar(texts, 5, 0.8) if not set.isdisjoint(*(bands[t] for t in p))}
    groups = defaultdict(set)
    for t in texts:
        for b in bands[t]:
            groups[b].add(t)
    assert len(want) >= 60 and sum(len(g) > simhash.FEW for g in groups.values()) > 20
    theirs = {x: min(g) for g in _components(want) for x in g}
    for block, least in ((simhash.BLOCK, simhash.TEXT_LEAST), (600, 1)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "TEXT_LEAST", least)
        got = {frozenset((by[x["src"]], by[x["dst"]])) for x in simhash.similar_links(df, 5, 0.8).collect()}
        assert got <= all_similar(texts, 5, 0.8)
        mine = {x: min(g) for g in _components(got) for x in g}
        assert all(mine.get(x) == y for x, y in theirs.items())
