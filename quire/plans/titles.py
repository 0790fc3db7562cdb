"""Queries over titles, folders and labels, on stated renderings of part names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import titles as tt
from quire.plans.base import query, table

_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty-one", "thirty two", "ninety-nine")
_SHAPES = ("07", "Chapter 7", "track ix", "Partridge", "B0BNC37LPW", "Disc 2", "12345", "side")
_SHAPE = "[" + ", ".join(f"'{x}'" for x in _SHAPES) + f"][1 + p_partkey % {len(_SHAPES)}]"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def pick(values: tuple[str, ...], key: str = "p_partkey") -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values)).cast("int"))


@query(f"SELECT p_partkey, regexp_matches(trim(t), '^[0-9]{{1,4}}$') AS track, regexp_matches(trim(t), '^[0-9]{{1,4}}$') OR regexp_matches(trim(t), '(?i)^(chapter|track|part|section|disc|disk|cd|side)\\s*([0-9]+|[ivxlcdm]+)?$') AS label FROM (SELECT p_partkey, {_SHAPE} AS t FROM part)")
def heading_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA11: titles that are only a track number or a heading."""
    t = pick(_SHAPES)
    return parts(spark, sf_dir).select("p_partkey", tt.is_track_number(t).alias("track"), tt.is_chapter_label(t).alias("label"))


_NOISY = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' (B0BNC37LPW LC 128 44100 Stereo)' WHEN 1 THEN ' [Unabridged] -' WHEN 2 THEN ' B0BNC37LPW' ELSE ' (Classics, 1971)' END"


@query(f"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '[(\\[][^)\\]]*(\\bB0[0-9A-Z]{{8}}\\b|\\b(?i:kbps?|stereo|mono|44100|22050|48000)\\b)[^)\\]]*[)\\]]', ' ', 'g'), '\\bB0[0-9A-Z]{{8}}\\b', ' ', 'g'), '\\s+', ' ', 'g')), '^[ –—_-]+|[ –—_-]+$', '', 'g') AS title FROM (SELECT p_partkey, {_NOISY} AS t FROM part)""")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA12, DQ10: titles without shop numbers and sound formats."""
    t = F.concat("p_name", pick((" (B0BNC37LPW LC 128 44100 Stereo)", " [Unabridged] -", " B0BNC37LPW", " (Classics, 1971)")))
    return parts(spark, sf_dir).select("p_partkey", tt.healed_title(t).alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE '' END AS author, p_name AS title FROM part")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA13: author and title of folders named after both."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_brand", F.lit(" – "), "p_name")).when(k == 1, F.concat("p_type", F.lit(" - "), "p_name")).otherwise(F.col("p_name"))
    path = F.concat(F.lit("/books/"), name)
    return parts(spark, sf_dir).select("p_partkey", tt.directory_author(path).alias("author"), tt.directory_title(path).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(replace(p_brand, '#', ' ')) || ' ' || p_name ELSE p_name END AS key, p_partkey % 2 = 1 OR p_partkey % 10 = 0 AS fits FROM part")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA8, SCA9: keys of files, and whether their author may be that of every fifth brand."""
    p = parts(spark, sf_dir)
    author = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")
    other = F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")).otherwise("nobody")
    return p.select("p_partkey", tt.match_key(F.concat("p_name", F.lit(" (64kb LibriVox)")), author).alias("key"), tt.authors_compatible(author, other).alias("fits"))


_NW = "[" + ", ".join(f"'{x}'" for x in _NUMBERS) + f"][1 + p_partkey % {len(_NUMBERS)}]"
_NV = f"[1,2,3,4,5,6,7,8,9,10,11,12,21,32,99][1 + p_partkey % {len(_NUMBERS)}]"


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Chapter ' || {_NV} || ': ' || p_name WHEN 1 THEN 'Part ' || p_size WHEN 2 THEN 'Prologue - ' || p_name WHEN 3 THEN 'Book ' || {_NV} || ': ' || p_name || ' ' || p_type ELSE 'Chapter ' || p_size || ': ' || p_name END AS title FROM part""")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA14, SCA15: headings in one form."""
    n, k = pick(_NUMBERS), F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("ch. "), n, F.lit(": "), "p_name", F.lit(".")))
        .when(k == 1, F.concat(F.lit("PART "), size))
        .when(k == 2, F.concat(F.lit("Prologue - "), "p_name"))
        .when(k == 3, F.concat(F.lit("book "), n, F.lit(" "), "p_name", F.lit(", - "), "p_type"))
        .otherwise(F.concat(F.lit("Chapter "), size, F.lit(" — "), "p_name", F.lit("!")))
    )
    return parts(spark, sf_dir).select("p_partkey", tt.chapter_title(raw).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'iPhone and ' || p_name ELSE upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' of the ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) END AS title FROM part")
def cased_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA20, SCA50: titles shouted or whispered, in title case."""
    spread = F.replace("p_name", F.lit(" "), F.lit(" OF THE "))
    t = F.when(F.col("p_partkey") % 3 == 0, F.upper(spread)).when(F.col("p_partkey") % 3 == 1, F.lower(spread)).otherwise(F.concat(F.lit("iPhone and "), "p_name"))
    return parts(spark, sf_dir).select("p_partkey", tt.title_case(t).alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A ' || p_name WHEN 1 THEN 'The ' || p_name ELSE '' END AS title FROM part")
def spoken_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA18: titles that narrators speak after the number of a chapter."""
    k = F.col("p_partkey") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("Chapter 5. A "), "p_name", F.lit(". They do not sleep.")))
        .when(k == 1, F.concat(F.lit("Chapter seven. The "), "p_name", F.lit(" November 23, 2012. It was late")))
        .when(k == 2, F.concat(F.lit("Chapter 5. Chapter 5. "), "p_name", F.lit(".")))
        .when(k == 3, F.concat(F.lit("Chapter two. and then "), "p_name", F.lit(".")))
        .otherwise(F.concat(F.lit("It was a long way to go before "), "p_name"))
    )
    return parts(spark, sf_dir).select("p_partkey", tt.spoken_title(said).alias("title"))


_ORIGINS = tuple(p[0] for p in tt.PROVENANCE) + ("old_tape",)
_LABEL = " ".join(f"WHEN '{o}' THEN '{a}'" for o, a, _ in tt.PROVENANCE)
_KINDS = " ".join(f"WHEN '{o}' THEN '{b}'" for o, _, b in tt.PROVENANCE)


@query(f"SELECT p_partkey, CASE o {_LABEL} ELSE 'Old Tape' END AS label, CASE o {_KINDS} ELSE 'personal' END AS kind FROM (SELECT p_partkey, [{', '.join(repr(o) for o in _ORIGINS)}][1 + p_partkey % {len(_ORIGINS)}] AS o FROM part)")
def provenance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA44: what readers see of an origin."""
    return parts(spark, sf_dir).select("p_partkey", tt.provenance(pick(_ORIGINS)).alias("p")).select("p_partkey", "p.label", "p.kind")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d = 0 OR e < 2 THEN 'estimating...' WHEN r < 60 THEN '~' || CAST(floor(r) AS BIGINT) || 's remaining' WHEN r < 3600 THEN '~' || CAST(floor(r / 60) AS BIGINT) || 'm remaining'
ELSE '~' || CAST(floor(r / 3600) AS BIGINT) || 'h ' || CAST(floor(r / 60) AS BIGINT) % 60 || 'm remaining' END AS eta FROM (SELECT *, e / nullif(d, 0) * (t - d) AS r FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_linenumber * 10 - 9 AS e, l_partkey % 9 AS d, l_partkey % 9 + l_linenumber AS t FROM lineitem))""")
def job_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA46: what is left of jobs."""
    done = F.col("l_partkey") % 9
    eta = tt.remaining_time(F.col("l_quantity") * F.col("l_linenumber") * 10 - 9, done, done + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", eta.alias("eta"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 'Not checked against the audio' WHEN bad = 0 THEN 'All ' || format('{:,}', n) || ' words match' WHEN 100.0 * bad / n >= 3.0 THEN bad || ' of ' || format('{:,}', n) || ' words (' || printf('%.1f', 100.0 * bad / n) || '%) may not match'
ELSE bad || ' of ' || format('{:,}', n) || ' words (' || printf('%.2f', 100.0 * bad / n) || '%) in doubt' END AS said FROM (SELECT doc_id, doc_id % 40 AS bad, (doc_id * 37) % 5000 AS n FROM documents) WHERE n = 0 OR bad <= n""")
def trust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH22, SCA31, DQ6: what is said of a transcript's trust."""
    from quire.plans.quality import trust_state

    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("bad"), (F.col("doc_id") * 37 % 5000).alias("n")).where("n = 0 or bad <= n")
    return d.select("doc_id", tt.trust_line(trust_state(F.col("n"), F.col("bad")), F.col("bad"), F.col("n")).alias("said"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(t, '[\\s\\x{00A0}\\x{2003}]+'), lambda x: x <> '')) AS BIGINT) AS words FROM (SELECT doc_id, left(text, 400) || chr(160) || 'x' || chr(8195) || 'y' AS t FROM documents)")
def unicode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA1: words between any white space, that of Unicode included."""
    t = F.concat(F.left("text", F.lit(400)), F.lit(" x y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.unicode_fields(t)).cast("long").alias("words"))
