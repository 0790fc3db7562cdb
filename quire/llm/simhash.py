"""SimHash fingerprints and their groups through a Gray-order hierarchical index.

Fingerprints: the words of a text are its runs of bytes other than ASCII white
space after A-Z are lower-cased; each run of ``SHINGLE`` words, repeats
included, is hashed by XXH64 with seed 42, and a bit is 1 where over half the
hashes have it.  A shorter sequence is one shingle; no words give zero.

Groups: two fingerprints link when they differ in at most ``MAX_BITS`` = 2
bits.  Cut into three blocks, such a pair agrees in one block at least, so the
distinct fingerprints are dealt three times, by block and its value.  A task
sorts what it got by Gray rank with the shared block on top, which puts equal
top patterns side by side, and builds a hierarchy over the order: every node
keeps the bits that all its members share (pattern and mask).  The search
descends pairs of nodes and prunes a whole pair of groups once the shared bits
differ in the top block or have gathered more than two differences.  What is
left are links, and each task reduces them to at most one a fingerprint.

A block value that over ``HOT`` distinct fingerprints share would be one large
task.  Its fingerprints are dealt three times more, by a third of the bits that
are still open: two of them that are linked agree in one third at least.  That
goes on while a group is crowded; with every turn a third of the open bits is
shared, so a group of few open bits is small by itself.

Fingerprints of texts whose sets of shingles are alike but not nearly equal
differ in more bits than blocks can find (3 to 11 at a Jaccard similarity of
0.8).  ``similar_links`` finds such texts by ``BANDS`` bands of ``BAND_ROWS``
min-hashes (a pair at 0.8 shares one with probability 0.9996).  In a band of up
to ``FEW`` texts all are compared; in a larger one first each with the first
and last, and with those of its texts that agree in the band after it too.
Links whose exact similarity is high enough are kept.  In a large band whose
texts these links leave in several classes, all texts of different classes are
then compared exactly: they are dealt to blocks by class and number of
shingles, and each two blocks whose sizes allow a link meet in one task.  So no
class is missed that comparing all pairs of a band would find.  The links can
be given to ``near_duplicates`` beside its own.

Defined results: a null text counts as empty; copies of a text share a
fingerprint and so a group; repeated rows repeat; the component of a row is
the smallest non-null identifier of its group (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import connected_components
from quire.llm.scratch import give_back, materialize, partitions, text_hash, trimmed

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Distinct fingerprints that share their dealt bits beyond which they are dealt again.
HOT = 4096
#: Children of a node of the hierarchy, and pairs of nodes looked at together.
FANOUT, AT_ONCE = 16, 1 << 18
#: Min-hash bands of ``similar_links`` and min-hashes in each.
BANDS, BAND_ROWS = 20, 5
#: Texts of a band that are all compared with one another.
FEW = 8
#: Shingles of a block of a larger band, and those that a text counts for at least.
BLOCK, TEXT_LEAST = 1 << 16, 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_hash`` and the fingerprint ``fp`` as a signed 64-bit integer."""
    rows = df.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "text_hash", "fp"])

    return rows.mapInArrow(trimmed(run), f"id {kind}, text_hash string, fp long").withColumnRenamed("id", id_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchy over fingerprints in Gray order; every node has the bits its members share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # distinct, sorted by Gray rank
        ones = zeros = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(codes, np.full(len(codes), ~np.uint64(0)))]
        ones, zeros = codes, ~codes
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones, ones | zeros))

    def links(self, top: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j, of codes that agree in ``top`` and differ in at most ``most`` bits."""
        stack = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, i, j = stack.pop()
            if not level:
                if len(i):
                    yield i, j
                continue
            pattern, mask = self.levels[level - 1]
            step = np.arange(FANOUT)
            for at in range(0, len(i), AT_ONCE // FANOUT**2):
                a = (i[at : at + AT_ONCE // FANOUT**2, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
                b = (j[at : at + AT_ONCE // FANOUT**2, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
                real = (a < b if level == 1 else a <= b) & (b < len(pattern))
                a, b = a[real], b[real]
                apart = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
                near = (apart & top == 0) & (np.bitwise_count(apart) <= most)
                stack.append((level - 1, a[near], b[near]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each index reaches, for links that come in parts."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root = jumped
    return root


@lru_cache(None)
def _bits(path: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(shared, open) bits, from the top, after the choices of ``path``: a digit for each third of the bits then open."""
    if not path:
        return (), tuple(range(63, -1, -1))
    shared, rest = _bits(path[:-1])
    size, more = divmod(len(rest), 3)
    cuts = [0, size + (more > 0), 2 * size + (more > 0) + (more > 1), len(rest)]
    a, b = cuts[int(path[-1])], cuts[int(path[-1]) + 1]
    return shared + rest[a:b], rest[:a] + rest[b:]


def _runs(bits: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """(lowest bit, number) of each run of neighbours."""
    start = 0
    for i in range(1, len(bits) + 1):
        if i == len(bits) or bits[i] != bits[i - 1] - 1:
            yield bits[i - 1], i - start
            start = i


def _turned(codes: np.ndarray, path: str) -> np.ndarray:
    """Codes with the bits that ``path`` shares on top and the others, in their order, below."""
    out = np.zeros_like(codes)
    for low, n in (r for part in _bits(path) for r in _runs(part)):
        out = (out << np.uint64(n)) | ((codes >> np.uint64(low)) & np.uint64((1 << n) - 1)) if n < 64 else codes
    return out


def _mask(path: str) -> int:
    """The shared bits as a signed 64-bit integer."""
    m = sum(1 << b for b in _bits(path)[0])
    return m - (1 << 64) if m >> 63 else m


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.array(b.column(0).to_pylist(), dtype="U64"), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    paths, codes = (np.concatenate(x) for x in zip(*held, strict=True))
    for path in np.unique(paths).tolist():
        own = codes[paths == path].view(np.uint64)
        if len(own) < 2:
            continue
        turned = _turned(own, path)
        by = np.argsort(gray_rank(turned))
        own, turned = own[by], turned[by]
        width = len(_bits(path)[0])
        root = _roots(len(own), GrayIndex(turned).links(np.uint64(((1 << width) - 1) << (64 - width))))
        linked = np.flatnonzero(root != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[root[linked]].view(np.int64))], ["src", "dst"])


def near_links(codes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``src``, ``dst`` that connect the distinct ``fp`` of ``codes`` as all pairs within two bits do."""
    spark = codes.sparkSession
    n = partitions(spark)
    level, ready = _dealt(codes.withColumn("path", F.lit("")), [""]), None
    while True:
        large = materialize(level.groupBy("path", "value").count().where(F.col("count") > hot).select("path", "value"), "large-groups")
        paths = sorted(r["path"] for r in large.select("path").distinct().collect() if len(_bits(r["path"])[1]) > MAX_BITS)  # at most three times those of the turn before
        crowded = large.where(F.col("path").isin(paths)) if paths else large.where("false")
        calm = level if not paths else level.join(crowded, ["path", "value"], "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        if not paths:
            break
        level = materialize(_dealt(level.join(crowded, ["path", "value"], "left_semi").select("fp", "path"), paths), "dealt-again")
    return ready.repartition(n, "path", "value").select("path", "fp").mapInArrow(trimmed(_link_batches), "src long, dst long")


def _dealt(codes: DataFrame, paths: list[str]) -> DataFrame:
    """``fp`` once for each third of the bits still open: ``path`` and ``value``, the bits shared there."""
    if paths == [""]:
        turn = lambda p: F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("long")).alias("value"))
        return codes.select("fp", F.explode(F.array(*[turn(p) for p in "012"])).alias("x")).select("fp", "x.path", "x.value")
    turns = codes.sparkSession.createDataFrame([(p, f"{p}{i}", _mask(f"{p}{i}")) for p in paths for i in range(3)], "path string, to string, mask long")
    return codes.join(F.broadcast(turns), "path").select("fp", F.col("to").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the text's runs of ``size`` words; a shorter text is one run, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)} if k else ()), dtype=np.uint64)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """One value for each band of min-hashes."""
    rng = np.random.default_rng(SEED)
    n = BANDS * BAND_ROWS
    times, plus = rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)
    least = np.full(n, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * times + plus
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    raw = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in raw], dtype=np.uint64)


def _hashed(rows: DataFrame, size: int, make) -> DataFrame:
    """``h`` (hash of the text) and ``x``, what ``make`` gives for the hashes of its shingles; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, make(x).view(np.int64)) for h, x in zip(batch.column(0).to_pylist(), (shingle_hashes(t.as_py(), size) for t in batch.column(1)), strict=True) if len(x)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["h", "x"])

    return rows.mapInArrow(trimmed(run), "h string, x array<long>")


def similar_links(df: DataFrame, size: int, least: float, text_col: str = "text") -> DataFrame:
    """Links ``src``, ``dst`` of hashes of texts whose sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more.

    They connect the texts as all such pairs that share a band do; of pairs in large bands not every one is given.
    Equal texts count once, null, empty and blank texts have no links; a text of fewer words is one shingle.
    """
    rows = df.select(text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    bands = _hashed(rows, size, band_values).groupBy("h").agg(F.first("x").alias("x"))
    both = F.transform("x", lambda v, i: F.struct(v.alias("value"), F.get("x", (i + 1) % BANDS).alias("after")))
    bands = materialize(bands.select("h", F.posexplode(both).alias("band", "v")).select("h", "band", "v.*"), "bands")

    def ends(*keys: str) -> DataFrame:
        return bands.groupBy(*keys).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("n > 1")

    groups = materialize(ends("band", "value"), "band-groups")
    few, large = groups.where(F.col("n") <= FEW).select("band", "value"), groups.where(F.col("n") > FEW)
    close = bands.join(few, ["band", "value"]).select("band", "value", "h")
    pairs = close.join(close.withColumnRenamed("h", "other"), ["band", "value"])
    crowded = bands.join(large.select("band", "value"), ["band", "value"], "left_semi")
    inner = crowded.join(ends("band", "value", "after"), ["band", "value", "after"])
    outer = bands.join(large, ["band", "value"])
    star = lambda x: x.select("h", F.explode(F.array("low", "high")).alias("other"))
    met = pairs.select("h", "other").unionByName(star(outer)).unionByName(star(inner)).where("h != other")
    pairs = materialize(met.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct(), "met")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    sets = _hashed(rows.join(nodes, "h", "left_semi"), size, lambda x: x).groupBy("h").agg(F.first("x").alias("x"))
    sets = materialize(sets, "sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("h").alias("b"), F.col("x").alias("xb")), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    links = materialize(both.where(shared >= least * (F.size("xa") + F.size("xb") - shared)).select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar")
    rest = _apart(crowded.select("band", "value", "h"), links, sets, least)
    return links if rest.isEmpty() else links.unionByName(_block_links(rest, sets, least))


def _apart(crowded: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Rows of the large bands whose texts ``links`` leave in several classes: ``band``, ``value``, ``h``, ``root``, ``block``.

    ``owner`` is the class of a block that has no other, else empty; ``kind`` the logarithm of the number of shingles.
    """
    inside = crowded.select("h").distinct()
    own = links.join(inside.withColumnRenamed("h", "src"), "src", "left_semi").join(inside.withColumnRenamed("h", "dst"), "dst", "left_semi")
    classes = crowded.join(connected_components(own).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    classes = materialize(classes, "classes")
    mixed = classes.groupBy("band", "value").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band", "value")
    weight = F.greatest(F.size("x"), F.lit(TEXT_LEAST)).cast("long").alias("weight")
    kind = F.floor(F.log(F.size("x")) / float(-np.log(least)) + F.lit(1e-9)).cast("int").alias("kind")
    rest = classes.join(mixed, ["band", "value"], "left_semi").join(sets.select("h", weight, kind), "h")
    rest = materialize(rest, "classes-apart")
    keys = ["band", "value", "kind"]
    sums = rest.groupBy(*keys, "root").agg(F.sum("weight").alias("b"))
    small = sums.where(F.col("b") < BLOCK).groupBy(*keys).agg(F.sum("b").alias("small"))
    parts = lambda x: F.ceil(F.col(x) / BLOCK)
    alone = F.col("b") >= BLOCK
    dealt = rest.join(sums, [*keys, "root"]).join(small, keys, "left")
    dealt = dealt.withColumn("owner", F.when(alone, F.col("root")).otherwise(F.lit("")))
    block = F.when(alone, F.pmod(F.xxhash64("h"), parts("b"))).otherwise(F.pmod(F.xxhash64("root"), parts("small")))
    return materialize(dealt.select(*keys, "h", "root", "owner", block.alias("block")), "blocks")


def _block_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between classes of ``rest``, found by comparing each two blocks of a band that can have any."""
    own = ["kind", "owner", "block"]
    name = F.struct(*own)
    blocks = materialize(rest.select("band", "value", name.alias("one")).distinct(), "block-names")
    other = blocks.withColumnRenamed("one", "two")
    able = (F.col("two.kind") - F.col("one.kind") <= 1) & ((F.col("one.owner") != F.col("two.owner")) | (F.col("one.owner") == ""))
    meetings = blocks.join(other, ["band", "value"]).where((F.col("one") <= F.col("two")) & able)
    meetings = meetings.withColumn("meeting", F.xxhash64("band", "value", "one", "two"))
    side = lambda x, i: meetings.select("band", "value", "meeting", f"{x}.*", F.lit(i).alias("side"))
    sides = side("one", 0).unionByName(side("two", 1).join(meetings.where("one = two").select("meeting"), "meeting", "left_anti"))
    dealt = rest.join(materialize(sides, "meetings"), ["band", "value", *own]).join(sets, "h").select("meeting", "side", "h", "root", "x")

    def run(table: pa.Table) -> pa.Table:
        h, root = (table[c].to_pylist() for c in ("h", "root"))
        i, j = _class_links([np.asarray(v) for v in table["x"].to_numpy(zero_copy_only=False)], np.unique(root, return_inverse=True)[1], table["side"].to_numpy(), least)
        give_back()
        return pa.table({"src": pa.array([h[k] for k in i], pa.string()), "dst": pa.array([h[k] for k in j], pa.string())})

    found = dealt.groupBy("meeting").applyInArrow(run, "src string, dst string")
    return materialize(found.distinct(), "class-links")


def _class_links(sets: list[np.ndarray], classes: np.ndarray, side: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """(i, j) of similar sets that join ``classes`` as all similar sets of the two sides (of one, if there is one) do."""
    one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times > 1
    column = (np.cumsum(again) - 1)[value]
    keep = again[value]
    column, owner = column[keep], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    shared = np.zeros((len(one), len(two)), dtype=np.float32)
    for at in range(0, int(again.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        shared += has[one] @ has[two].T
    near = shared >= least * (sizes[one][:, None] + sizes[two][None, :] - shared.astype(np.float64))
    i, j = np.nonzero(near & (classes[one][:, None] != classes[two][None, :]))
    i, j, label = one[i], two[j], classes
    src, dst = [], []
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        _, first = np.unique(high, return_index=True)  # each class links to one that is smaller, so there is no circle
        src += i[first].tolist()
        dst += j[first].tolist()
        label = _roots(int(label.max()) + 1, iter([(low[first], high[first])]))[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return src, dst


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, similar: DataFrame | None = None) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` and ``text_hash`` of every row, and ``root``, its group's smallest fingerprint.

    ``similar``: further links, of hashes of texts.
    """
    marks = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    codes = materialize(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "codes")
    links = near_links(codes.select("fp"), hot)
    if similar is not None:
        named = marks.groupBy("text_hash").agg(F.first("fp").alias("fp"))
        ends = similar.join(named.select(F.col("text_hash").alias("src"), F.col("fp").alias("a")), "src").join(named.select(F.col("text_hash").alias("dst"), F.col("fp").alias("b")), "dst")
        links = links.unionByName(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    groups = connected_components(links)
    rooted = codes.join(groups, codes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "named")
    return marks.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, similar: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``text_hash`` of one row of each group: that of the smallest identifier, null last, then of the smallest hash."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col), F.col("text_hash"))).alias("first")
    return near_duplicates(df, id_col, text_col, hot, similar).groupBy("root").agg(first).select(f"first.{id_col}", "first.text_hash")
