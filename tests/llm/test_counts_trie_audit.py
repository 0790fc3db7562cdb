"""Token counts against the libraries, the prefix trie and the audit of sources against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import divergence, prefix_trie, queries, token_counts

from .conftest import edge_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_token_counts_of_edge_rows(docs, library):
    rows = token_counts.count_tokens(docs, PATH, limit=400).collect()
    want = [(str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 400) for i, t, _ in edge_texts()]
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)


def test_cut_texts_count_as_whole_ones(docs, library):
    whole = sorted(map(str, token_counts.count_tokens(docs, PATH).collect()))
    assert sorted(map(str, token_counts.count_tokens(docs, PATH, part=7, call=50).collect())) == whole


def test_no_token_reaches_across_a_cut(library):
    lengths, cuts = token_counts.load(PATH)
    assert cuts
    r = random.Random(7)
    marks = ["<|endoftext|>", "<|startoftext|>", "'s", "don't", "12", "Σ", "ß", "é", "≮", "́", "\x1c", " ", "　", "中", "?!", "a.b", "|", "<", ">"]
    texts = ["".join(r.choice([*marks, *"aabnehit'.,!1 2É\n\t</-:"]) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    for part in (1, 3, 10):
        assert all(b"".join(token_counts.parts_of(x, part)) == x for x in raw)
        got = token_counts.count_texts(raw, lengths, True, part, 400).tolist()
        assert got == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_texts_without_a_place_for_a_cut_and_very_long_ones(library):
    lengths, cuts = token_counts.load(PATH)
    texts = ["a" * 300_000, "naïve words 123, and more. " * 80_000, "", "é" * 5000]
    assert len(list(token_counts.parts_of(texts[0].encode()))) == 1
    assert len(list(token_counts.parts_of(texts[1].encode()))) > 30
    assert token_counts.count_texts([t.encode() for t in texts], lengths, cuts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_not_cut(docs, name):
    path = public_tokenizers.path(name)
    lengths, cuts = token_counts.load(path)
    assert not cuts
    rows = token_counts.count_tokens(docs, path, part=5, call=60).collect()
    want = sorted((str(i), lengths([t or ""])[0]) for i, t, _ in edge_texts())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == want


def test_counts_of_an_empty_table(no_docs):
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


TURNS = "conv_id long, turn long, role string, text string, place long, content string, depth long, owner string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 5, "clash") for r in rows], TURNS).repartition(3)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [said for _, said in sorted(x)] for c, x in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        children = [u for u in below if len(u) == len(node) + 1]
        leaves = [u for u in below if not any(len(x) == len(u) + 1 and x[: len(u)] == u for x in below)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    found = prefix_trie.trie(prefix_trie.rebuilt(conversations(spark, rows)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PLACE_BITS", 1)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    r = random.Random(seed)
    rows = [(None, 1, "user", "nobody's"), (900, 0, "user", "alone"), (-5, 1, None, "below zero"), (-100, 3, "a", ""), (-103, 1, "a", "")]
    for c in [*range(0, 12), 100, 101, 102, 103, 205, 206, 207, 10**12 + 1, *range(-104, -99)]:
        for turn in range(r.randint(1, 9)):
            rows.append((c, r.choice([turn, turn, turn, None, 2]), r.choice(["user", "bot", None]), r.choice(["hi", "yes", "日本語 👍🏽", None, ""])))
    rows += rows[5:9]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PLACE_BITS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 40) for t in range(3)] + [(7, t, "user", "on " * (t % 5)) for t in range(3, 200)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, []) == []


def brute_audit(rows, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in words}:
        here = [x for x in words if x[0] == lang]
        docs = Counter(t for _, _, w in here for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        share = lambda own: {t: 1 + 1_000_000_000 * (own[t] + 2) // (sum(own[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        count = {s: Counter(t for _, source, w in here if source == s for t in w) for s in {x[1] for x in here}}
        whole = share(sum(count.values(), Counter()))
        for s, own in count.items():
            p = share(own)
            pairs = [(-sum(f(p[t], q[t]) for t in kept), o) for o in count if o != s for q in [share(count[o])]]
            terms = [(-f(p[t], whole[t]), t) for t in kept if own[t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audit_rows(n_sources, seed):
    r = random.Random(seed)
    known = ["the", "THE", "naïve", "Ünder", "日本", "a1b", "x_y", "don't", "z", "Zeta", "ɐ", "\U0001f44d", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(r.choice(["en", "en", "de", None]), r.choice([None, *(f"s{i}" for i in range(n_sources - 1))]), " ".join(r.choices(known, k=r.randint(0, 30)))) for _ in range(90)]
    return rows + [("en", "s0", None), ("xx", "only rare", "once"), ("xx", "rare too", "twice"), ("xx", "empty", ""), ("yy", "one", "alone"), ("en", "without", None)] + rows[:5]


@pytest.mark.parametrize(("n_sources", "block", "slice_terms"), [(1, 16, 16_384), (5, 1, 4), (8, 2, 9), (9, 2, 100), (12, 4, 3)])
def test_audit_equals_brute_force(spark, n_sources, block, slice_terms, monkeypatch):
    monkeypatch.setattr(divergence, "WAVE", 3)
    rows = audit_rows(n_sources, n_sources)
    docs = spark.createDataFrame([(*r, 3, "clash", 9, "clash") for r in rows], "lang string, source string, text string, n long, term string, doc_id long, slot string").repartition(4)
    found = divergence.audit(docs, least_docs=3, top=4, slice_terms=slice_terms, block=block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, 3, 4)


def test_every_two_blocks_meet_once(spark):
    from pyspark.sql import functions as F

    for n in range(2, 12):
        met = Counter()
        for turn in range(1, (n - 1 if n % 2 == 0 else n) + 1):
            other = {r[0]: r[1] for r in spark.range(n).select("id", divergence.partner(F.col("id").cast("int"), n, turn)).collect()}
            assert all(o >= n or other[o] == s for s, o in other.items())
            met.update((s, o) for s, o in other.items() if s < o < n)
        assert met == {(a, b): 1 for a in range(n) for b in range(a + 1, n)}


def test_large_counts_stay_exact():
    import numpy as np

    n = np.array([0, 1, 40_000_000_000], dtype=np.int64)
    assert divergence.shares(n, 40_000_000_001, 3).tolist() == [1 + 1_000_000_000 * (int(x) + 2) // (40_000_000_001 + 6) for x in n]


def test_audit_of_empty_and_wordless_tables(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [("en", "a", None), ("en", "b", "123 ..."), ("en", None, "")]
    found = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, 10, 10)


def test_queries_of_the_three_operators_are_registered():
    assert {"op11_token_counts", "op12_prefix_trie", "op13_divergence"} <= queries.QUERIES.keys()
