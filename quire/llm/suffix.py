"""Removal of long byte strings that occur more than once, by a bounded BWT search.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts
anywhere else, in the same text or another.

1. Texts are deduplicated by a 128-bit hash; a text of ``LENGTH`` bytes or more
   that two rows share goes whole.  The distinct texts are kept as a table
   bucketed by the hash, so later joins move only small rows.
2. The smallest hash of a ``GRAM``-byte string within a window of ``LENGTH``
   bytes depends on the window alone, so equal windows get the same one.  A
   text is cut into runs of windows with the same smallest hash; only runs
   whose hash comes again are looked at, with their bytes.
3. Runs are dealt by that hash; equal runs count as one with a number.  A task
   joins its runs into one string and sorts its suffixes to ``LENGTH`` bytes.
   Starting from intervals of short strings, breadth-first backward extension
   on the Burrows-Wheeler transform finds the boundaries with a common prefix
   of 7, 8, 9 ... bytes, and stops at ``LENGTH``: suffixes with no boundary
   between them share that many bytes.
4. Where more than ``HOT_BYTES`` of distinct runs lie under one hash, those runs
   are cut again by the smallest of another hash of their windows' strings, up
   to ``FINER`` times, so that they too come in parts that a task can sort;
   copies of a passage meet again, and what is beside them falls off.  Runs
   that stay crowded share one string of ``GRAM`` bytes in over ``HOT_BYTES`` of
   different surroundings; their windows are compared by a 128-bit hash.

With ``words`` strings of that many words go too where they are shorter than
``LENGTH`` bytes: such a window begins with the blank before a word and ends
with the blank behind the last.  White space counts as blanks there, and so do
the ends of a text.  Runs of both kinds of windows with the same hash are
joined where they overlap, so that no place of a text is there twice under one
hash; windows are compared under one hash only.

Defined results: null counts as empty; matches never cross rows; repeated rows
are copies of each other; equal identifiers are separate rows; other columns
play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import materialize, new_path, partitions, trimmed

LENGTH, GRAM = 400, 64
HOT_BYTES = 2_000_000
#: Times that crowded runs are cut again.
FINER = 3
#: Bytes of joined runs that a task sorts together; fewer with windows of words, whose places take memory too.
SORT_BYTES, SORT_WORD_BYTES = 1_000_000, 400_000


# --- windows by their smallest hash


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (y * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return z ^ (z >> np.uint64(29))


def gram_hashes(raw: np.ndarray, turn: int = 0) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each position; another one for each ``turn``."""
    x = raw.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    for shift in (8, 16, 32):
        x = _mix(x[:-shift], x[shift:])
    return _mix(x, np.full(1, turn, dtype=np.uint64)) * np.uint64(0x9FB21C651E98DF25) if turn else x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, ~np.uint64(0))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of ``x[a:b]`` for each range, from minima of powers of two."""
    power = np.frexp(b - a)[1] - 1
    out = np.empty(len(a), dtype=x.dtype)
    for k in range(int(power.max()) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(x[a[own]], x[b[own] - (1 << k)])
        x = np.minimum(x[: -(1 << k)], x[1 << k :])
    return out


_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _raw(text: str, words: int) -> bytes:
    raw = text.encode("utf-8", "replace")
    return b" " + raw.translate(_BLANKS) + b" " if words else raw


def windows(raw: bytes, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the windows of ``LENGTH`` bytes, and behind them of the shorter ones of ``words`` words."""
    n = max(0, len(raw) - LENGTH + 1)
    start, size = np.arange(n), np.full(n, LENGTH)
    if not words or not raw:
        return start, size
    blank = np.frombuffer(raw, dtype=np.uint8) == 32
    begin, behind = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if len(begin):
        behind = behind[behind > begin[0]]
    most = max(0, len(behind) - words + 1)
    span = behind[words - 1 :][:most] + 1 - begin[:most]
    short = span < LENGTH
    return np.concatenate([start, begin[:most][short]]), np.concatenate([size, span[short]])


def _same_runs(least: np.ndarray, start: np.ndarray, size: np.ndarray) -> zip:
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([at[1:], [len(least)]])[: len(at)] - 1
    return zip(least[at].tolist(), start[at].tolist(), (start[last] + size[last]).tolist(), strict=True)


def runs_of(raw: bytes, turn: int = 0, words: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, start of the first window, end of the last, whether the hash occurs twice inside) of each run of windows."""
    start, size = windows(raw, words)
    if not len(start):
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty.astype(bool)
    h = gram_hashes(np.frombuffer(raw, dtype=np.uint8), turn)
    n = max(0, len(raw) - LENGTH + 1)
    found = list(_same_runs(sliding_min(h, LENGTH - GRAM + 1) if n else h[:0], start[:n], size[:n]))
    if len(start) > n:
        start, size = start[n:], size[n:]
        more = _same_runs(range_min(h, start, start + size - GRAM + 1), start, size)
        both, found = sorted([*found, *more]), []
        for v, a, b in both:
            if found and found[-1][0] == v and a < found[-1][2]:
                found[-1] = (v, found[-1][1], max(b, found[-1][2]))
            else:
                found.append((v, a, b))
    value, first, end = (np.array(x, dtype=t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    twice = np.fromiter((np.count_nonzero(h[a : b - GRAM + 1] == v) > 1 for v, a, b in zip(value, first, end, strict=True)), dtype=bool, count=len(value))
    return value, first, end, twice


def _emit_runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for h1, h2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value, first, end, twice = runs_of(_raw(text, words), words=words)
            if len(value):
                parts.append((value.view(np.int64), np.full(len(value), h1), np.full(len(value), h2), first, end, twice))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["m", "h1", "h2", "first", "end", "twice"])


def _emit_bytes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Bytes of each run that is looked at."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            out = []
            for h1, h2, text, runs in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                raw = _raw(text, words)
                for r in runs:
                    part = raw[r["first"] : r["end"]]
                    out.append((r["m"], _digest(part), part, h1, h2, r["first"]))
            if out:
                m, c1, part, h1, h2, first = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(c1, pa.int64()), pa.array(part, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first, pa.int64())], ["m", "c", "bytes", "h1", "h2", "first"])


# --- Burrows-Wheeler transform and interval expansion

_PACK, _BITS = 7, 9


def bounded_suffixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least ``length`` symbols, and the packed first symbols in that order."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_PACK, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(_PACK):
        key = (key << np.uint64(_BITS)) | padded[j : j + n]
    packed, reach = key, _PACK
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)])).astype(np.uint64)
        if reach >= length or rank[order[-1]] == n - 1:
            return order, packed[order]
        beyond = np.zeros(n, dtype=np.uint64)
        beyond[: max(0, n - reach)] = rank[reach:] + np.uint64(1)
        key = (rank << np.uint64(32)) | beyond
        reach *= 2


def common_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, lcp): the common prefix of neighbours in order where it is under ``length``, else ``length``.

    Symbol 0 separates strings.  Values arise in increasing order: an interval
    of suffixes that start with a string is extended to the left by each symbol
    before it, and an extension goes on only if its right end was not yet a boundary.
    """
    n = len(symbols)
    order, packed = bounded_suffixes(symbols, length)
    before = symbols[order - 1].astype(np.int64)  # the transform; position -1 is the final separator
    lcp = np.full(n + 1, length, dtype=np.int64)
    lcp[0] = lcp[n] = -1
    apart = packed[1:] ^ packed[:-1]
    known = apart != 0
    top = np.zeros(len(apart), dtype=np.int64)
    for j in range(1, _PACK):
        top += (apart >> np.uint64(_BITS * (_PACK - j))) == 0
    lcp[1:n][known] = top[known]
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[by_symbol] = np.arange(n)
    grouped = before[by_symbol]
    same = grouped[1:] == grouped[:-1]
    prior, later = np.full(n, -1), np.full(n, n)
    prior[by_symbol[1:][same]] = by_symbol[:-1][same]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    starts = np.concatenate([[0], np.flatnonzero(known) + 1])
    ends = np.concatenate([starts[1:], [n]]) - 1
    ahead = lcp[ends + 1] == _PACK - 1
    low, high = starts[ahead], ends[ahead]
    for depth in range(_PACK, length):
        if not len(low):
            break
        sizes = high - low + 1
        own = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[own]
        real = before[at] > 0
        first = to[at[real & (prior[at] < low[own])]]
        last = to[at[real & (later[at] > high[own])]]
        first.sort()
        last.sort()
        fresh = lcp[last + 1] == length
        low, high = first[fresh], last[fresh]
        lcp[high + 1] = depth
    return order, lcp[:n]


def _joined(strings: Sequence[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(begin of each string, suffix order, common prefixes) of the strings in one, each with a separator behind it."""
    sizes = np.array([len(s) + 1 for s in strings])
    flat = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    stops = np.cumsum(sizes) - 1
    flat[stops] = 0
    return stops - sizes + 1, *common_prefixes(flat, length)


def repeated_starts(strings: Sequence[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes occur at two places among all strings."""
    begins, order, lcp = _joined(strings, length)
    joined = np.flatnonzero(lcp == length)
    marked = np.zeros(len(order), dtype=bool)
    marked[order[joined]] = True
    marked[order[joined - 1]] = True
    return [marked[b : b + max(0, len(s) + 1 - length)] for b, s in zip(begins, strings, strict=True)]


def repeated_windows(strings: Sequence[bytes], own: Sequence[tuple[np.ndarray, np.ndarray]], groups: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its ``own`` windows occur at two places among the strings of its group."""
    begins, order, lcp = _joined(strings, LENGTH)
    counts = [len(w[0]) for w in own]
    start, size = np.concatenate([w[0] + b for w, b in zip(own, begins, strict=True)]), np.concatenate([w[1] for w in own])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    place, group = place[start], np.repeat(groups, counts)
    hit = np.zeros(len(start), dtype=bool)
    for kind in (size == LENGTH, size < LENGTH):
        by = np.flatnonzero(kind)
        by = by[np.argsort(group[by] * len(order) + place[by])]
        next_to = np.flatnonzero(group[by[1:]] == group[by[:-1]])
        if len(next_to):
            shared = np.full(len(by) + 1, -1)  # prefix in common with the window before
            shared[next_to + 1] = range_min(lcp, place[by[next_to]] + 1, place[by[next_to + 1]] + 1)
            hit[by] = np.maximum(shared[:-1], shared[1:]) >= size[by]
    return np.split(hit, np.cumsum(counts)[:-1])


def _spans(start: np.ndarray, size: np.ndarray) -> list[dict]:
    """Byte spans covered by windows; the blank before a word stays."""
    if not len(start):
        return []
    end, start = start + size, start + (size < LENGTH)
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return [{"s": int(a), "e": int(b)} for a, b in zip(start[np.concatenate([[0], cut + 1])], end[np.append(cut, len(end) - 1)], strict=True)]


def _search(rows: list[tuple[int, int, bytes, int]], words: int) -> pa.RecordBatch:
    strings = [r[2] for r in rows]
    own = [windows(x, words) for x in strings]
    groups = np.unique([r[0] for r in rows], return_inverse=True)[1]
    found = repeated_windows(strings, own, groups) if words else repeated_starts(strings)
    spans = [_spans(*(x[f | (r[3] > 1)] for x in w)) for r, w, f in zip(rows, own, found, strict=True)]
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, kind)], ["m", "c", "spans"])


def _search_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash, so a hash is never cut apart."""
    held: list[tuple[int, int, bytes, int]] = []
    size, most = 0, SORT_WORD_BYTES if words else SORT_BYTES
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= most and row[0] != held[-1][0]:
                yield _search(held, words)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield _search(held, words)


def _window_hashes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m, c, part, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            start, size = windows(part, words)
            digest = [xxhash.xxh3_128_digest(part[i : i + k]) for i, k in zip(start.tolist(), size.tolist(), strict=True)]
            w = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            k = len(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1])), pa.array(np.full(k, m)), pa.array(np.full(k, c)), pa.array(np.full(k, n)), pa.array(start + (size < LENGTH)), pa.array(start + size)], ["w1", "w2", "m", "c", "n", "s", "e"])


# --- the Spark job

_SPAN_LIST = "array<struct<s:bigint,e:bigint>>"


def _hot_spans(rows: DataFrame, words: int) -> DataFrame:
    """As ``_search`` for rows of crowded hashes, through counts of window hashes."""
    windows = materialize(rows.mapInArrow(trimmed(partial(_window_hashes, words=words)), "w1 long, w2 long, m long, c long, n long, s long, e long"), "windows")
    again = windows.groupBy("w1", "w2", "m").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2", "m")
    hit = windows.join(materialize(again, "repeated-windows"), ["w1", "w2", "m"], "left_semi")
    return hit.groupBy("m", "c").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _cut_finer(turn: int, words: int):
    """Parts of runs whose windows have one smallest hash of another kind; ``m0``, ``c0`` name the run and ``first`` the part's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, c, part, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                value, first, end, twice = runs_of(part, turn, words)
                value = _mix(value, np.full(1, m, dtype=np.int64).view(np.uint64)).view(np.int64)
                for v, a, b, t in zip(*(x.tolist() for x in (value, first, end, twice)), strict=True):
                    piece = part[a:b]
                    out.append((v, _digest(piece), piece, n, m, c, a, t))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["m", "c", "bytes", "n", "m0", "c0", "first", "twice"])

    return run


def _digest(piece: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(piece)[:8], "big", signed=True)


def _run_spans(distinct: DataFrame, hot_bytes: int, words: int, turn: int = 0) -> DataFrame:
    """``m``, ``c`` and the ``spans`` to remove of the distinct runs ``m``, ``c``, ``bytes``, ``n``."""
    spark, kind = distinct.sparkSession, f"m long, c long, spans {_SPAN_LIST}"
    search = lambda rows: rows.repartition(partitions(spark), "m").sortWithinPartitions("m").mapInArrow(trimmed(partial(_search_batches, words=words)), kind)
    crowded = distinct.groupBy("m").agg(F.sum(F.length("bytes")).alias("b")).where(F.col("b") > hot_bytes).select("m")
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        return search(distinct)
    dense = distinct.join(crowded, "m", "left_semi")
    if turn == FINER:
        spans = _hot_spans(dense, words)
    else:
        parts = dense.mapInArrow(trimmed(_cut_finer(turn + 1, words)), "m long, c long, bytes binary, n long, m0 long, c0 long, first long, twice boolean")
        parts = materialize(parts, "finer-parts")
        again = parts.groupBy("m").agg(F.sum("n").alias("k"), F.bool_or("twice").alias("twice")).where("k > 1 or twice").select("m")
        own = parts.join(materialize(again, "finer-again"), "m", "left_semi").groupBy("m", "c").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n"))
        found = materialize(_run_spans(materialize(own, "finer"), hot_bytes, words, turn + 1).where(F.size("spans") > 0), "finer-spans")
        spans = _placed(parts, found, ["m0", "c0"]).withColumnsRenamed({"m0": "m", "c0": "c"})
    return search(distinct.join(crowded, "m", "left_anti")).unionByName(spans)


def _placed(parts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the spans found in their parts, moved by the part's ``first``."""
    at = lambda x, k: (x[k] + F.col("first")).alias(k)
    moved = parts.select("m", "c", "first", *keys).join(found, ["m", "c"]).select(*keys, F.transform("spans", lambda x: F.struct(at(x, "s"), at(x, "e"))).alias("spans"))
    return moved.groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _texts(df: DataFrame, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return text, F.xxhash64(text), F.xxhash64(F.lit(LENGTH), text)


def _bucketed(texts: DataFrame) -> DataFrame:
    """``texts`` as files bucketed by its hash in the shared folder; the catalog's entry is needed only to read them and goes at once."""
    spark, name = texts.sparkSession, f"quire_texts_{uuid.uuid4().hex[:12]}"
    texts.write.bucketBy(partitions(spark), "h1", "h2").option("path", new_path(spark, "texts")).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def _cut_batches(batches: Iterator[pa.RecordBatch], words: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each text; as text, a character of which only some bytes are left goes with them."""
    ahead = int(words > 0)  # the blank before a text
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            out = []
            for text, n, spans in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                raw = text.encode("utf-8", "replace")
                if n > 1:
                    spans = _spans(*windows(_raw(text, words), words))
                kept, here, removed, count = [], 0, 0, 0
                reach = -1  # end of the removed run that is open
                for s, e in sorted((max(0, x["s"] - ahead), min(x["e"] - ahead, len(raw))) for x in spans or ()):
                    if s > reach:
                        kept.append(raw[here:s])
                        count += 1
                        removed += e - s
                    elif e > reach:
                        removed += e - reach
                    reach = max(reach, e)
                    here = reach
                kept.append(raw[here:])
                left = b"".join(kept)
                out.append((len(raw), removed, count, left.decode("utf-8", "ignore") if as_text else left))
            n_bytes, n_removed, n_spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array(kept, pa.string() if as_text else pa.binary())], ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept"])


def text_spans(texts: DataFrame, hot_bytes: int = HOT_BYTES, words: int = 0) -> DataFrame:
    """``h1``, ``h2`` and byte spans to remove of the distinct ``texts`` (h1, h2, text, n) that have any."""
    runs = materialize(texts.select("h1", "h2", "text").mapInArrow(trimmed(partial(_emit_runs, words=words)), "m long, h1 long, h2 long, first long, end long, twice boolean"), "runs")
    again = runs.groupBy("m").agg(F.count("*").alias("k"), F.bool_or("twice").alias("twice")).where("k > 1 or twice").select("m")
    looked = runs.join(materialize(again, "repeated-hashes"), "m", "left_semi").groupBy("h1", "h2").agg(F.collect_list(F.struct("m", "first", "end")).alias("runs"))
    cut = texts.join(looked, ["h1", "h2"]).select("h1", "h2", "text", "runs").mapInArrow(trimmed(partial(_emit_bytes, words=words)), "m long, c long, bytes binary, h1 long, h2 long, first long")
    cut = materialize(cut, "run-bytes")
    distinct = materialize(cut.groupBy("m", "c").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n")), "distinct-runs")
    spans = materialize(_run_spans(distinct, hot_bytes, words).where(F.size("spans") > 0), "spans")
    return _placed(cut, spans, ["h1", "h2"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), kept: Column | None = None, hot_bytes: int = HOT_BYTES, words: int = 0, as_text: bool = False) -> DataFrame:
    """Per row: ``id_col``, the columns ``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes left).

    ``kept`` replaces the bytes by an expression over them, computed once a distinct text.  With ``as_text`` they come as
    text, made in the task that cuts, without a Python worker of its own.  With ``words``, strings of that
    many words go too; they have ``GRAM`` bytes at least.
    """
    text, h1, h2 = _texts(df, text_col)
    rows = df.select(F.col(id_col), *keep, text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    texts = _bucketed(rows.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("n")))
    spans = text_spans(texts, hot_bytes, words)
    joined = texts.join(spans, ["h1", "h2"], "left").select("h1", "h2", "text", "n", "spans")
    result = joined.mapInArrow(trimmed(partial(_cut_batches, words=words, as_text=as_text)), f"h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    if kept is not None:
        result = result.withColumn("kept", kept)
    return rows.drop("text").join(result, ["h1", "h2"]).drop("h1", "h2")
