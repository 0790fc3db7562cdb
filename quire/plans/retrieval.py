"""Search, passage retrieval and conversation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vector as vec
from quire.operators import segment
from quire.plans.base import query, table
from quire.plans.segments import _CHUNKS, _TOK

STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunks(table(spark, sf_dir, "documents"), ["doc_id"])


def contains(text: Column, needle: str) -> Column:
    """Whether a text holds ``needle`` literally, in either case."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


@query(f"SELECT doc_id, chunk_idx FROM {_CHUNKS} WHERE contains(lower(content), 'the and') ORDER BY doc_id, chunk_idx LIMIT 20")
def keyword_search_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL1: the first twenty chunks that hold a phrase."""
    return chunks(spark, sf_dir).where(contains(F.col("content"), "the and")).orderBy("doc_id", "chunk_idx").limit(20).select("doc_id", "chunk_idx")


@query(f"SELECT doc_id, CASE WHEN k = '' THEN text ELSE k END AS keyword FROM (SELECT doc_id, text, list_reduce(list_prepend('', list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[?.,!;:''\"]+|[?.,!;:''\"]+$', '', 'g')), lambda w: len(w) > 2 AND w NOT IN ({STOPS}))), lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END) AS k FROM documents)")
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA29: keyword of each text, longest first, earliest of equals."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword("text").alias("keyword"))


@query("""SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substring(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM (
SELECT doc_id, text, greatest(p - 50, 1) AS a, least(p + 8 + 50 - 1, length(text)) AS b FROM (SELECT doc_id, text, instr(text, 'tion the') AS p FROM documents) WHERE p > 0)""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA41: text around the first hit."""
    d = table(spark, sf_dir, "documents").withColumn("p", F.instr("text", "tion the")).where("p > 0")
    return d.select("doc_id", tx.snippet(F.col("text"), F.col("p"), F.lit(8)).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS excerpt FROM documents")
def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA42: beginnings of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt("text").alias("excerpt"))


@query("SELECT conv_id, CASE WHEN t = '' THEN 'New chat' WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS title FROM (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE turn = 0)")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA43: title of each conversation from its first message."""
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", tx.session_title("text").alias("title"))


@query("SELECT conv_id, string_agg(CASE WHEN prev IS NULL OR prev <> role THEN role || ': ' ELSE '' END || left(text, 20), chr(10) ORDER BY turn) AS answer FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def extract_only_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET8: passages word for word, with a heading wherever the key changes."""
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    shown = F.concat(F.when(prev.isNull() | (prev != F.col("role")), F.concat("role", F.lit(": "))).otherwise(""), F.left("text", F.lit(20)))
    c = table(spark, sf_dir, "conversations").withColumn("shown", shown)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shown"))), lambda x: x["shown"]), "\n")
    return c.groupBy("conv_id").agg(joined.alias("answer"))


@query(f"SELECT doc_id FROM (SELECT doc_id, len(t) AS n, ' ' || array_to_string(t, ' ') AS s FROM (SELECT doc_id, {_TOK} AS t FROM documents)) WHERE NOT (n >= 4 AND instr(substr(s || s, 2), s) < length(s))")
def non_repeating_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA28: texts that are not one phrase over and over."""
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return t.where(~tx.is_pure_repetition(F.col("t"))).select("doc_id")


@query("SELECT c.conv_id, c.turn, count(DISTINCT w) AS shared FROM (SELECT conv_id, turn, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM conversations WHERE role = 'user') c JOIN (SELECT DISTINCT conv_id, turn + 1 AS turn, unnest(string_split(lower(text), ' ')) AS w FROM conversations) p USING (conv_id, turn, w) WHERE length(w) > 3 GROUP BY 1, 2")
def follow_up_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET9: words a question shares with the message before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    now = c.where("role = 'user'").select("conv_id", "turn", F.explode("ws").alias("w")).where("length(w) > 3")
    old = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.explode("ws").alias("w"))
    return now.join(old, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.count("*").alias("shared"))
