"""BPE encoding and decoding with a pair occurrence index.

A task lays the distinct pieces of its texts out as one flat array of symbols
with links to both neighbours.  The index maps each mergeable pair to all its
positions.  Active ranks are applied in ascending order: all positions of the
pair merge at once, and the lists of the pairs that arise beside them are
updated.  Ids and text equal those of the public library for the same file.

Defined results: a null text encodes as the empty text (no ids, decoded text
empty).  Rows are independent of one another, so repeated rows repeat, a null
identifier is carried along, and other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import ChunkEncoder, groups
from quire.llm.scratch import trimmed


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    known = set(shown)
    return [chr(b) if b in known else chr(next(hidden)) for b in range(256)]


class PairIndexBPE:
    """Merge rules of a vocabulary file with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *added.values()])
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.special = {k: np.int32(v).tobytes() for k, v in added.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where no rule joins them."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        stops = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(flat)
        if not n:
            return [b""] * len(raw)
        sym = self.inner[flat]
        word = np.repeat(np.arange(len(raw)), lengths)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        last, first = stops[lengths > 0] - 1, (stops - lengths)[lengths > 0]
        sym[last] = self.final[flat[last]]
        after[last] = -1
        before[first] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            if not len(at):
                return
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[a:b])

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(rank)))
            other = after[at]
            live = (sym[at] == self.left[rank]) & (other >= 0) & (sym[other] == self.right[rank])
            at = at[live]
            if not len(at):
                continue
            # The leftmost of each piece only: what it brings may rank before the rest.
            within = word[at]
            same = within[1:] == within[:-1]
            if same.any():
                lead = np.concatenate([[True], ~same])
                index[rank] = [at[~lead]]
                heapq.heappush(active, rank)
                at = at[lead]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[rank]
            sym[gone] = -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            prior = before[at]
            enter(np.concatenate([at[has], prior[prior >= 0]]))

        kept = sym >= 0
        ids = sym[kept].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word[kept], minlength=len(raw)))
        starts = [0, *ends[:-1].tolist()]
        return [ids[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def load(path: str) -> tuple[PairIndexBPE, ChunkEncoder]:
    bpe = PairIndexBPE(path)
    return bpe, ChunkEncoder(bpe.encode_pieces, bpe.special)


def _encode_batches(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = load(path)
        for batch in batches:
            for start, texts in groups(x.as_py() for x in batch.column(1)):
                found = [np.frombuffer(x, dtype="<i4") for x in encoder.encode(texts)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                columns = [batch.column(0).slice(start, len(texts)), ids]
                if with_text:
                    columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    return run


def _inputs(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every text."""
    rows, kind = _inputs(df, id_col, text_col)
    return rows.mapInArrow(trimmed(_encode_batches(tokenizer, False)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>`` and the text ``decoded`` from them, in one pass."""
    rows, kind = _inputs(df, id_col, text_col)
    out = rows.mapInArrow(trimmed(_encode_batches(tokenizer, True)), f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give null, an id outside the vocabulary gives an empty token."""

    @F.pandas_udf("string")
    def text_of(ids):
        bpe, _ = load(tokenizer)
        known = lambda x: [i if 0 <= i < bpe.size else None for i in x]
        return ids.map(lambda x: None if x is None else " ".join("" if i is None else bpe.tokens[i] for i in known(x)))

    return df.withColumn(out_col, text_of(ids_col))
