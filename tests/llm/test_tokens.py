"""BPE and token shards against the public library, on edge texts and random strings."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, chunks, sstable

from .conftest import edge_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_pair_index_equals_library_on_random_strings(library):
    index, encoder = bpe.load(PATH)
    r = random.Random(5)
    texts = ["".join(r.choice("aabnehit'.,!1 2ÉéΣß́中\n\t<|>/w\x1c") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 5000, "hahahaha" * 300, "banana " * 200, "Σ", "don't we'll", "½ ² 12345"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(got, "<i4")
        assert ids.tolist() == want, text
        assert index.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memo_bound_does_not_change_results(library, monkeypatch):
    monkeypatch.setattr(chunks, "MEMO", 3)
    index = bpe.PairIndexBPE(PATH)
    encoder = chunks.ChunkEncoder(index.encode_pieces, index.special)
    for text in ["the cat sat", "on the mat", "the cat sat on", "the mat"]:
        assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_decode_edge_rows(docs, library):
    rows = bpe.encode_decode(docs, PATH).collect()
    assert len(rows) == docs.count()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in edge_texts())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r["decoded"] for r in rows)


def test_shards_round_trip_and_starts(docs, library, spark, tmp_path):
    folder = f"file://{tmp_path}/sst"
    manifest = [(r["shard"], r["n_ids"]) for r in sstable.write(docs, PATH, folder, shards=3).collect()]
    rows = sorted(sstable.read(spark, folder, manifest).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted((str(i), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in edge_texts())
    assert sorted((str(r["doc_id"]), zlib.crc32(r["ids"])) for r in rows) == want
    shards = [s for s, _ in manifest]
    assert len(sstable.lookup(folder, shards, 9)) == 2
    assert len(sstable.lookup(folder, shards, None)) == 1
    assert sstable.lookup(folder, shards, 16)[0].tolist() == [*library.encode(edge_texts()[15][1], add_special_tokens=False).ids, 2]
    assert sstable.lookup(folder, shards, 123456) == []


def test_empty_tables(no_docs):
    assert bpe.encode_decode(no_docs, PATH).count() == 0
    assert sstable.write_and_read(no_docs, PATH).count() == 0


def test_block_lookup_over_many_blocks(tmp_path, monkeypatch):
    import io

    monkeypatch.setattr(sstable, "BLOCK_IDS", 8)
    out = io.BytesIO()
    writer = sstable.ShardWriter(out)
    rows = [(k, np.arange(k % 5, dtype="<u4").tobytes()) for k in [-7, -1, 0, 3, 3, 3, 3, 3, 9, 200, 70000] + list(range(70001, 70100))]
    for k, v in rows:
        writer.add(k, v)
    writer.close()

    class File:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    reader = sstable.ShardReader(File())
    assert [(k, v) for k, _, v in reader.rows()] == rows
    assert len(reader.get(3)) == 5 and reader.get(4) == [] and len(reader.get(-7)) == 1 and len(reader.get(70099)) == 1
