"""How far the sources of a language differ in their words, and by which words.

Terms are counted by document in tasks and summed before they are shuffled.
The kept terms of a language are dealt by hash to slices of about 16,384, its
groups (sources) to blocks of about 16.  Each (language, slice, block) packs
its groups' vectors once: numbers of the terms that occur, with their
smoothed shares; what does not occur has one share a group and is not stored.
A bounded heap ranks the terms of each group there.

Blocks then meet as in a round-robin tournament by the circle method.  In a
round every block has one partner; of the two one stays where it is and the
packed vectors of the other travel, and the meeting gives both directions.
Within a meeting only terms that occur in the traveller are looked at one by
one; the rest of a resident goes by its distinct shares and how often it has
them.  Sums over slices and ranks are grouped at the end.

Defined results: null text, language and source are the empty string; rows
count each by itself, repeated or not; the identifier and other columns are
not looked at; an empty table gives no rows; a language whose terms are all
rare pairs its sources at value 0 and has no terms.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import materialize, trimmed

#: Documents of a language that a kept term is in, at least; ranks of terms.
LEAST_DOCS, TOP = 10, 10
#: Shares are out of so many.
SCALE = 1_000_000_000
#: Kept terms of a slice and groups of a block, about; distinct entries that a task counts before it hands them on.
SLICE, BLOCK, HELD = 16_384, 16, 400_000
#: Rounds whose results are written together.
WAVE = 8
UNIT = ["lang", "slice", "slot"]
#: Letters of terms: A-Z become lower case, other ASCII characters stand between terms, all else belongs to them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def ready() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [b"", *n]
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
            numbers = [pa.array([0, *map(x.__getitem__, n)], pa.int64()) for x in (n, docs)]
            yield pa.RecordBatch.from_arrays(columns + numbers, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.translate(FOLD).split()
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
        if held > HELD:
            yield from ready()
            held = 0
    yield from ready()


def counted(documents: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``docs``; each group has a row of the empty term besides."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = documents.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(trimmed(_count_batches), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _dealt(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    wide = n if not len(n) or int(n.max()) < 9_000_000_000 else n.astype(object)
    return (1 + SCALE * (wide + 2) // (total + 2 * kept)).astype(np.int64)


def gaps(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pack(top: int):
    """Vectors of a block's groups in a slice, each with its best terms."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        heads = rows[rows["term"].isna()]
        entries = dict(tuple(rows[rows["term"].notna()].groupby("source", sort=False)))
        out = {n: [] for n in ("source", "rest", "size", "places", "shares", "best")}
        for head in heads.itertuples():
            found, p, best = entries.get(head.source), np.zeros(0, np.int64), []
            places = np.zeros(0, np.int32)
            if found is not None:
                found = found.sort_values("place")
                places = found["place"].to_numpy(np.int32)
                p = shares(found["n"].to_numpy(np.int64), int(head.total), int(head.kept))
                q = shares(found["lang_n"].to_numpy(np.int64), int(head.lang_total), int(head.kept))
                value, terms = gaps(p, q), found["term"].to_numpy()
                more = np.flatnonzero(p > q)
                best = heapq.nsmallest(top, ((-int(value[i]), terms[i].encode(), terms[i]) for i in more))
            out["source"].append(head.source)
            out["rest"].append(int(shares(np.zeros(1, np.int64), int(head.total), int(head.kept))[0]) if head.kept else 1)
            out["size"].append(int(head.size))
            out["places"].append(places.astype("<i4").tobytes())
            out["shares"].append(p.astype("<i8").tobytes())
            out["best"].append([{"term": t, "value": -v} for v, _, t in best])
        n = len(out["source"])
        fixed = {name: pa.repeat(x, n) for name, x in zip(UNIT, key, strict=True)}
        kinds = {"rest": pa.int64(), "size": pa.int64(), "places": pa.binary(), "shares": pa.binary(), "source": pa.string(), "best": pa.list_(pa.struct([("term", pa.string()), ("value", pa.int64())]))}
        return pa.table(fixed | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def packed(counts: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_terms: int = SLICE, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Packed vectors of all groups by (language, slice, block), and the number of blocks."""
    whole = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(whole.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "kept-terms")
    groups = counts.where("term = ''").select("lang", "source")
    most_terms, most_groups = (x.groupBy("lang").count().agg(F.max("count")).first()[0] or 1 for x in (kept, groups))
    slices, slots = -(-most_terms // slice_terms), -(-most_groups // block)

    sliced = kept.withColumn("slice", _dealt("term", slices))
    placed = sliced.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)
    entries = counts.where("term <> ''").join(placed, ["lang", "term"]).select("lang", "source", "slice", _dealt("source", slots).alias("slot"), "term", "n", "lang_n", "place")
    entries = materialize(entries, "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = sliced.groupBy("lang", "slice").agg(F.count("*").alias("size"))
    # Each language has slice 0, though it may have no kept term.
    all_slices = sizes.unionByName(groups.select("lang", F.lit(0).alias("slice"), F.lit(0).cast("long").alias("size")).distinct()).groupBy("lang", "slice").agg(F.sum("size").alias("size"))
    zero = F.lit(0).cast("long")
    heads = (
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(all_slices, "lang")
        .select("lang", "source", "slice", _dealt("source", slots).alias("slot"), *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total", "size")])
    )
    rows = entries.unionByName(heads, allowMissingColumns=True)
    kind = "lang string, slice int, slot int, source string, rest long, size long, places binary, shares binary, best array<struct<term:string,value:long>>"
    return materialize(rows.groupBy(*UNIT).applyInArrow(_pack(top), kind), "vectors"), slots


def _vectors(table: pa.Table) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    columns = (table.column(c).to_pylist() for c in ("source", "rest", "places", "shares"))
    return [(s, r, np.frombuffer(i, "<i4"), np.frombuffer(p, "<i8")) for s, r, i, p in zip(*columns, strict=True)]


def meeting(resident: pa.Table, traveller: pa.Table | None) -> list[tuple[str, str, int]]:
    """(source, source, sum over the slice) of the pairs between two blocks, or within one where no other travels."""
    here = _vectors(resident)
    there = here if traveller is None else _vectors(traveller)
    if not here or not there:
        return []
    dense = np.empty((len(here), int(resident.column("size")[0].as_py())), np.int64)
    often = []
    for row, (_, rest, places, p) in zip(dense, here, strict=True):
        row[:] = rest
        row[places] = p
        often.append(np.unique(p, return_counts=True) + (rest, len(row) - len(p)))
    out = []
    for j, (peer, rest, places, q) in enumerate(there):
        near = dense[:, places]
        looked = (gaps(near, q) - gaps(near, rest)).sum(axis=1)
        for i, (source, *_) in enumerate(here):
            if traveller is None and i >= j:
                break
            seen, times, own_rest, others = often[i]
            value = int(looked[i]) + int((gaps(seen, rest) * times).sum()) + others * int(gaps(own_rest, rest))
            out += [(source, peer, value), (peer, source, value)]
    return out


def _met(key: tuple[pa.Scalar, ...], resident: pa.Table, traveller: pa.Table) -> pa.Table:
    source, item, value = zip(*x, strict=True) if (x := meeting(resident, traveller)) else ((), (), ())
    return pa.table({"lang": pa.repeat(key[0], len(source)), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def partner(slot: Column, n: int, turn: int) -> Column:
    """The block that ``slot`` meets in round ``turn`` (1 to m) of ``n`` blocks, by the circle method; n or more: none."""
    m = n - 1 if n % 2 == 0 else n
    other = F.pmod(F.lit(turn) - slot, F.lit(m))
    fixed = F.lit(turn * ((m + 1) // 2) % m)
    return F.when(slot == m, fixed).otherwise(F.when(other == slot, F.lit(m)).otherwise(other)).cast("int")


def pair_sums(vectors: DataFrame, slots: int) -> DataFrame:
    """``lang, source, item, value`` of all pairs of sources, summed over slices, in rounds of meetings."""
    kind = "lang string, source string, item string, value long"
    need = vectors.select(*UNIT, "source", "rest", "size", "places", "shares")
    alone = need.groupBy(*UNIT).applyInArrow(lambda key, t: _met(key, t, None), kind)
    rounds = [alone]
    for turn in range(1, (slots - 1 if slots % 2 == 0 else slots) + 1 if slots > 1 else 1):
        other = partner(F.col("slot"), slots, turn)
        # Of two partners the lower stays in even rounds, the higher in odd ones.
        stays = F.col("slot") < other if turn % 2 == 0 else F.col("slot") > other
        playing = need.withColumn("other", other).where(F.col("other") < slots)
        travel = playing.where(~stays).drop("slot").withColumnRenamed("other", "slot")
        rounds.append(playing.where(stays).drop("other").groupBy(*UNIT).cogroup(travel.groupBy(*UNIT)).applyInArrow(_met, kind))
    waves = []
    for i in range(0, len(rounds), WAVE):
        wave = rounds[i]
        for x in rounds[i + 1 : i + WAVE]:
            wave = wave.unionByName(x)
        waves.append(wave if len(rounds) <= WAVE else materialize(wave, "meetings"))
    met = waves[0]
    for x in waves[1:]:
        met = met.unionByName(x)
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_terms: int = SLICE, block: int = BLOCK, **columns: str) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources by distance, and the first ``top`` terms of each group."""
    counts = materialize(counted(documents, **columns), "term-counts")
    vectors, slots = packed(counts, least_docs, top, slice_terms, block)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    best = vectors.select("lang", "source", F.explode("best").alias("x")).select("lang", "source", F.lit("term").alias("part"), F.col("x.term").alias("item"), F.col("x.value").alias("value"))
    terms = best.select("*", ranked).where(F.col("rank") <= top)
    pairs = pair_sums(vectors, slots).select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", ranked)
    return pairs.unionByName(terms)
