"""Token ids of documents in sorted-string-table shards.

A shard holds the documents of one range of identifiers in ascending order:

    magic | data blocks | block index | Bloom filter | footer

* A data block is a zstandard frame of up to ``BLOCK_IDS`` ids.  Each entry is
  varint(bytes shared with the previous key), varint(new key bytes),
  varint(value bytes), the new key bytes and the value.  The first key of a
  block shares nothing, so a block is read on its own.
* A key is a null marker and the identifier as big-endian 64 bits with its
  sign turned, so bytes sort as numbers do and a null identifier comes first.
* A value is the ids as little-endian unsigned 32-bit integers.
* The sparse index has (first key, offset, length, ids before the block in the
  shard) of each block; the filter answers most absent keys without a block.
* The footer has the places of index and filter and the numbers of documents
  and ids.

A lookup reads footer, index and filter, finds its block by binary search, and
reads that block alone.

Tasks write to a name of their own and rename, so a task that runs again gives
the same file.  Paths are Hadoop-style URIs that pyarrow.fs opens (file, hdfs,
s3, gs).

Defined results: a null text is empty and so holds the end id alone; equal
identifiers keep all their rows, in the order of a hash of the text and then
the text; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import byte_symbols
from quire.llm.chunks import ChunkEncoder, groups
from quire.llm.scratch import new_path, partitions, trimmed

MAGIC = b"QUIRESST1\n"
FOOTER = struct.Struct("<QQQQQQ10s")
ENTRY = struct.Struct("<9sQQQ")
BLOCK_IDS = 16_384
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Chunks that a worker learns before it forgets those it did not meet again.
MEMO = 250_000


@lru_cache(2)
def library_encoder(path: str) -> ChunkEncoder:
    """Pieces encoded by the model of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    model, table = tokenizer.model, dict(enumerate(byte_symbols()))
    own = [np.uint32(i).tobytes() for i in range(tokenizer.get_vocab_size())].__getitem__
    added = {t.content: np.uint32(i).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode(pieces: list[str]) -> list[bytes]:
        out = []
        for p in pieces:
            shown = p if p.isascii() and p.isprintable() else p.encode("utf-8", "replace").decode("latin-1").translate(table)
            out.append(b"".join([own(t.id) for t in model.tokenize(shown)]))
        return out

    return ChunkEncoder(encode, added, MEMO)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - 2**63 if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes rows that come in key order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index, self.keys = [], []
        self.block, self.block_ids, self.first, self.before = bytearray(), 0, b"", 0
        self.last, self.total, self.compress = b"", 0, zstandard.ZstdCompressor(level=1).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if not self.block:
            self.first, self.before = key, self.total
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.total += len(ids) // 4
        self.block_ids += len(ids) // 4
        if self.block_ids >= BLOCK_IDS:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.compress(bytes(self.block))
            self.index.append(ENTRY.pack(self.first, self.at, len(data), self.before))
            self._put(data)
        self.block, self.block_ids = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(b"".join(self.index))
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for i in _bloom_places(key, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, bits, len(self.keys), self.total, MAGIC))


class ShardReader:
    """Reads a shard from an open random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.index_at, n, self.bloom_at, self.bits, self.docs, self.total, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.index = list(ENTRY.iter_unpack(file.read_at(n * ENTRY.size, self.index_at)))
        self.bloom = None

    def block(self, i: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(identifier, ids before it in the shard, ids) of a block's entries."""
        _, offset, length, start = self.index[i]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield id_of(key), start, data[at : at + size]
            start += size // 4
            at += size

    def rows(self) -> Iterator[tuple[int | None, int, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self.file.read_at((self.bits + 7) // 8, self.bloom_at)
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of every row of an identifier."""
        if not self.may_hold(doc_id):
            return []
        key, low, high = key_of(doc_id), 0, len(self.index)
        while low < high:  # the first block whose first key is not before the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        out = []
        for i in range(max(0, low - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [ids for found, _, ids in self.block(i) if found == doc_id]
        return out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _write_batches(tokenizer: str, folder: str, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = library_encoder(tokenizer)
        store, root = _filesystem(folder)
        name = f"{root}/shard-{task.partitionId():06d}.sst"
        own = f"{name}.{task.taskAttemptId()}.tmp"
        with store.open_output_stream(own) as out:
            writer = ShardWriter(out)
            for batch in batches:
                ids, texts = batch.column(0), (x.as_py() for x in batch.column(1))
                for start, group in groups(texts):
                    for i, found in enumerate(encoder.encode(group), start):
                        writer.add(ids[i].as_py(), found + end)
            writer.close()
        if writer.keys:
            store.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_docs": [len(writer.keys)], "n_ids": [writer.total], "n_bytes": [writer.at]})
        else:
            store.delete_file(own)

    return run


def write(df: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write shards under ``folder``; one row a shard: shard, n_docs, n_ids, n_bytes.

    Ranges are cut by identifier and a hash of the text, so rows that share an
    identifier can still be split, and encoding follows the one shuffle.
    """
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    order = [F.col("id").asc_nulls_first(), F.col("h").asc_nulls_first()]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(shards or partitions(df.sparkSession), *order).sortWithinPartitions(*order, "text")
    return sorted_rows.select("id", "text").mapInArrow(trimmed(_write_batches(tokenizer, folder, end_id)), "shard long, n_docs long, n_ids long, n_bytes long")


def _read_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/shard-{shard:06d}.sst") as file:
                    rows = ShardReader(file).rows()
                    while held := list(itertools.islice(rows, 512)):
                        ids, starts, values = zip(*held, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(starts) + base), pa.array(values, pa.binary())], ["id", "start", "ids"])

    return run


def read(spark: SparkSession, folder: str, manifest: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """Rows of the shards: ``id_col``, ``start`` (ids of all documents before it) and ``ids`` as bytes.

    ``manifest`` has (shard, number of ids) of each shard, a few bytes a shard.
    """
    base, rows = 0, []
    for shard, n in sorted(manifest):
        rows.append((shard, base))
        base += n
    order = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, min(len(rows), 4 * partitions(spark))), "shard")
    return order.mapInArrow(trimmed(_read_batches(folder)), "id long, start long, ids binary").withColumnRenamed("id", id_col)


def lookup(folder: str, shards: list[int], doc_id: int | None) -> list[np.ndarray]:
    """Ids of each row of one identifier, by filter and binary search."""
    store, root = _filesystem(folder)
    out = []
    for shard in shards:
        with store.open_input_file(f"{root}/shard-{shard:06d}.sst") as file:
            out += [np.frombuffer(x, dtype="<u4") for x in ShardReader(file).get(doc_id)]
    return out


def write_and_read(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` to shards and return what reading them gives."""
    spark = df.sparkSession
    folder = folder or new_path(spark, "sst")
    manifest = [(r["shard"], r["n_ids"]) for r in write(df, tokenizer, folder, end_id, id_col, text_col).collect()]
    return read(spark, folder, manifest, id_col)
