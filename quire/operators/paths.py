"""Ways from one book of a work to another over the alignments between its books."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alignments that a way goes over at most; a work has few books.
HOPS = 6


def either_way(links: DataFrame) -> DataFrame:
    """Each alignment in both directions (OTH12): work, unit, id, src, dst, reversed.

    ``links``: work, unit, id, from_book, to_book; one of a book with itself leads nowhere.
    """
    there = links.where("from_book <> to_book").select("work", "unit", "id", F.col("from_book").alias("src"), F.col("to_book").alias("dst"), F.lit(False).alias("reversed"))
    return there.unionByName(there.select("work", "unit", "id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("reversed")))


def direct(links: DataFrame, asked: DataFrame) -> DataFrame:
    """The alignment of each asked pair of books, in whichever direction it is kept (OTH12): work, unit, a, b, id, reversed; the first of several.

    ``asked``: work, unit, a, b.
    """
    kept = either_way(links).withColumnsRenamed({"src": "a", "dst": "b"})
    return asked.join(kept, ["work", "unit", "a", "b"]).groupBy("work", "unit", "a", "b").agg(F.min(F.struct("id", "reversed")).alias("x")).select("work", "unit", "a", "b", "x.id", "x.reversed")


def best_ways(links: list[tuple[int, int, int, bool]], hops: int) -> list[tuple]:
    """(a, b, ids, reversed) of the best way between any two books of one work; ``links``: src, dst, id, reversed.

    A way of fewest alignments goes over the best ways to its books, so only one a book is kept in each round.
    """
    near: dict = {}
    for src, dst, id_, back in links:
        near.setdefault(src, []).append((dst, id_, back))
    out = []
    for a in near:
        seen, front = {a}, {a: ((), ())}
        for _ in range(hops):
            reached: dict = {}
            for book, (ids, turns) in front.items():
                for dst, id_, back in near.get(book, ()):
                    if dst not in seen:
                        way = ((*ids, id_), (*turns, back))
                        if dst not in reached or way < reached[dst]:
                            reached[dst] = way
            if not reached:
                break
            seen.update(reached)
            out += [(a, b, ids, turns) for b, (ids, turns) in reached.items()]
            front = reached
    return out


def alignment_paths(links: DataFrame, hops: int = HOPS) -> DataFrame:
    """The shortest way between any two books of a work over alignments of one unit (ALN13): work, unit, a, b, hops, ids, reversed.

    A direct alignment is a way of one hop; of ways of one length that over the
    alignments of lower identifiers, from the first hop on.  A work has few
    alignments, so they are a list that meets in one shuffle.
    """
    steps = either_way(links.where("work is not null and unit is not null"))
    kinds = dict(steps.dtypes)
    names = ["src", "dst", "id", "reversed"]
    listed = steps.groupBy("work", "unit").agg(F.collect_list(F.struct(*names)).alias("links"))
    flat = listed.select("work", "unit", *[F.col(f"links.{c}").alias(c) for c in names])
    schema = f"work {kinds['work']}, unit {kinds['unit']}, a {kinds['src']}, b {kinds['src']}, hops int, ids array<{kinds['id']}>, reversed array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                ways = best_ways(list(zip(*x, strict=True)), hops)
                at += [i] * len(ways)
                found += ways
            if found:
                a, b, ids, turns = zip(*found, strict=True)
                own, id_kind = pa.array(at), batch.column("id").type.value_type
                book = batch.column("src").type.value_type
                columns = [batch.column("work").take(own), batch.column("unit").take(own), pa.array(a, book), pa.array(b, book), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(id_kind)), pa.array(turns, pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, ["work", "unit", "a", "b", "hops", "ids", "reversed"])

    return flat.mapInArrow(run, schema)
