"""Prefix trie of conversations that share beginnings, with its sums by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the
conversations that start with it, and the smallest member owns it.  Whoever
owns a node owns all that follows on its own path, so a conversation owns a
suffix of its path.  A window over each node marks its owner.  What a subtree
saves is then the sum, over the members of its top, of the tokens of their
occurrences below less those of the nodes that they own: one group-by over the
prefixes gives members, leaves and savings of all subtrees at once.

Prefixes are told apart by depth and 128 bits: the exclusive or of two hashes
of (place, turn) over the turns so far.  Numbers of turns and running hashes
are taken block by block of 1,024 places, with what lies before a block added
from sums by block, so that a conversation of any length is shared by tasks.

Defined results: rows without a conversation identifier belong to none and
are left out; a null turn comes first; turns of one number go by the MD5 of
role and text; repeated rows are turns of their own; null role or text is the
empty one; other columns are not looked at; an empty table has no nodes, not
even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import materialize, trimmed

#: Bits of the places in a block, and of the identifiers that are joined into one row.
PLACE_BITS, ID_BITS = 10, 12
#: Conversations of a hundred share the beginning of the first; so many turns at most, less one.
FAMILY, MOST_SHARED = 100, 6
NODE = ("depth", "k1", "k2")


def content(role: Column, text: Column) -> Column:
    """MD5 of role and text, told apart by the length of the role."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def running(rows: DataFrame, key: str, block: Column, order: list[Column], sums: dict[str, Column], marks: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``before_<name>``: the sum of each of ``sums``, and the exclusive or of each of ``marks``, over the rows of the key that come before.

    ``block`` rises with ``order``; a task has one block of a key at a time, not the key.
    """
    marks = marks or {}
    total = dict.fromkeys(sums, F.sum) | dict.fromkeys(marks, F.bit_xor)
    both = {n: (lambda a, b: a + b) if n in sums else (lambda a, b: a.bitwiseXOR(b)) for n in total}
    rows = rows.withColumns({"_block": block} | {f"_{n}": c for n, c in (sums | marks).items()})
    zero = F.lit(0).cast("long")
    per_block = rows.groupBy(key, "_block").agg(*[f(f"_{n}").alias(f"_{n}") for n, f in total.items()])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(key, "_block", *[F.coalesce(f(f"_{n}").over(earlier), zero).alias(f"_start_{n}") for n, f in total.items()])
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(starts, [key, "_block"]).withColumns({f"before_{n}": both[n](F.col(f"_start_{n}"), F.coalesce(f(f"_{n}").over(inside), zero)) for n, f in total.items()})
    return found.drop("_block", *[f"_{n}" for n in total], *[f"_start_{n}" for n in total])


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, content, n_chars`` of every turn of the rebuilt conversations, and a row of depth 0 for each of them.

    Conversation c has the first h turns of c - c % 100, then its own without the first h; h = crc32(c) % 6.
    """
    empty = F.lit("")
    role, text = F.coalesce(F.col(role_col), empty), F.coalesce(F.col(text_col), empty)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), content(role, text).alias("content"), F.length(text).cast("long").alias("n_chars")
    )
    first = F.lit(-(1 << 60)).cast("long")
    block = F.coalesce(F.shiftright("turn", PLACE_BITS), first)
    numbered = running(turns, "conv_id", block, [F.col("turn").asc_nulls_first(), F.col("content")], {"place": F.lit(1).cast("long")})
    numbered = materialize(numbered.select("conv_id", (F.col("before_place") + 1).alias("place"), "content", "n_chars"), "turns")

    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED)).withColumnRenamed("conv_id", "family")
    known = heads.groupBy("family").agg(F.count("*").alias("n_heads"))
    ids = numbered.select("conv_id").distinct().select("conv_id", shared.alias("shared"), family.alias("family"))
    taken = ids.join(heads, "family").where("place <= shared").select("conv_id", F.col("place").alias("depth"), "content", "n_chars")
    own = numbered.withColumns({"shared": shared, "family": family}).where("place > shared").join(known, "family", "left")
    depth = F.least("shared", F.coalesce("n_heads", F.lit(0))) + F.col("place") - F.col("shared")
    own = own.select("conv_id", depth.alias("depth"), "content", "n_chars")
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("n_chars"))
    return roots.unionByName(taken).unionByName(own)


def occurrences(turns: DataFrame) -> DataFrame:
    """Each turn with the node that it ends (``depth, k1, k2``), the node's parent (``p1, p2``) and the code points before it."""
    root = F.col("depth") == 0
    mark = lambda *x: F.when(root, F.lit(0).cast("long")).otherwise(F.xxhash64(*x))
    rows = turns.select("conv_id", "depth", "n_chars", mark("depth", "content").alias("x1"), mark("content", "depth").alias("x2"))
    rows = running(rows, "conv_id", F.shiftright("depth", PLACE_BITS), [F.col("depth")], {"chars": F.col("n_chars")}, {"x1": F.col("x1"), "x2": F.col("x2")})
    key = lambda n: F.col(f"before_x{n}").bitwiseXOR(F.col(f"x{n}")).alias(f"k{n}")
    return rows.select("conv_id", "depth", key(1), key(2), F.col("before_x1").alias("p1"), F.col("before_x2").alias("p2"), F.col("before_chars").alias("before"), "n_chars")


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks in order; a node's blocks follow one another in a task."""
    node, state = None, None
    names = [*NODE, "ends_sha256"]

    def done() -> list[pa.Array]:
        return [pa.array([x], pa.int64()) for x in node] + [pa.array([state.hexdigest()], pa.string())]

    for batch in batches:
        ready = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if row[:3] != node:
                if node is not None:
                    ready.append((*node, state.hexdigest()))
                node, state = row[:3], hashlib.sha256(row[3].encode())
            else:
                state.update(b"," + row[3].encode())
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ready, strict=True)], names)
    if node is not None:
        yield pa.RecordBatch.from_arrays(done(), names)


def end_digests(tails: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ``conv_id`` that end at each node, in ascending order.

    Identifiers meet in rows of up to 4,096 first; then one task reads the rows of a node in order and keeps the hash's state only.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = tails.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return ordered.mapInArrow(trimmed(_digest_blocks), "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row a node over ``conv_id, depth, content, n_chars`` (a row of depth 0 for each conversation)."""
    occ = materialize(occurrences(turns), "occurrences")
    smallest = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
    owned = materialize(occ.withColumn("nth", smallest).where("nth = 1").drop("nth"), "owned")

    children = owned.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = owned.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "nodes")

    # The suffix that each conversation owns: what comes before it, and whether its last node is a leaf.
    suffixes = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("unowned"), F.max_by(F.col("n_children") == 0, "depth").alias("leaf"))
    tails = occ.groupBy("conv_id").agg(F.max(F.struct(*NODE, (F.col("before") + F.col("n_chars")).alias("total"))).alias("end"))
    paths = tails.join(suffixes, "conv_id", "left").select(
        "conv_id", F.coalesce("unowned", "end.total").alias("unowned"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")
    )
    zero = F.lit(0).cast("long")
    sums = occ.join(paths, "conv_id").groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("unowned") - F.col("before"), zero)).alias("saved_tokens")
    )
    parents = owned.select(F.col("depth").alias("parent_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    up = nodes.withColumn("parent_depth", F.col("depth") - 1).join(parents, ["parent_depth", "p1", "p2"], "left")
    ends = end_digests(tails.select("conv_id", "end.depth", "end.k1", "end.k2"))
    return (
        up.join(sums, list(NODE)).join(ends, list(NODE), "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    )
