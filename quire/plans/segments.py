"""Segmentation and cleaning of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import segment
from quire.plans.base import query, table

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_CHUNKS = f"""(SELECT doc_id, CAST(s / 160 AS INT) AS chunk_idx, CAST(s AS INT) AS start_word, CAST(least(s + 200, n) AS INT) AS end_word, array_to_string(w[s + 1:least(s + 200, n)], ' ') AS content
FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w), 160)) AS s FROM (SELECT doc_id, {WORDS} AS w FROM documents)))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT * FROM {_CHUNKS}")
def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1: overlapping retrieval chunks."""
    return segment.chunks(docs(spark, sf_dir), ["doc_id"])


@query(f"SELECT doc_id, count(*) AS chunks, CAST(max(end_word) AS BIGINT) AS words FROM {_CHUNKS} GROUP BY 1")
def chunk_count_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29 over SEG1: chunks and words a document."""
    return segment.chunks(docs(spark, sf_dir), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_word").cast("long").alias("words"))


_LINES = "(SELECT doc_id, source, i - 1 AS line_idx, l[i] AS line FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))"
_LN = f"(SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM {_LINES})"


@query(f"SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS paragraph_idx, CAST(sum(n) OVER w - n AS BIGINT) AS word_start, CAST(sum(n) OVER w AS BIGINT) AS word_end, trim(line) AS text FROM {_LN} WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)")
def paragraphs_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG3: paragraphs with word ranges."""
    return segment.paragraphs(docs(spark, sf_dir), ["doc_id"])


@query("SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG4: sentences a document."""
    return docs(spark, sf_dir).select("doc_id", F.size(tx.sentences("text")).cast("long").alias("sentences"))


@query()
def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG5: speech parts of up to sixty words; packing depends on what came before, so there is no plain SQL."""
    return segment.packed_sentences(docs(spark, sf_dir), ["doc_id"])


_FREQ = f"(SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS chapters FROM {_LN} WHERE n <= 12 AND trim(line) <> '' GROUP BY 1, 2)"
_HEAD = f"(SELECT f.* FROM {_FREQ} f JOIN (SELECT source, count(DISTINCT doc_id) AS k FROM documents GROUP BY 1) t USING (source) WHERE k >= 4 AND chapters >= greatest(4, ceil(k * 0.1)))"


@query(f"SELECT * FROM {_FREQ} WHERE chapters >= 2")
def line_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: short lines that several chapters of a work share."""
    return segment.line_frequency(docs(spark, sf_dir), "source", "doc_id").where("chapters >= 2")


@query(f"SELECT source, line, chapters FROM {_HEAD}")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: running headers, with a share of a tenth to suit the table."""
    return segment.running_headers(docs(spark, sf_dir), "source", "doc_id", share=0.1).select("source", "line", "chapters")


@query(f"SELECT source, doc_id, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM {_LINES} x WHERE NOT EXISTS (SELECT 1 FROM {_HEAD} h WHERE h.source = x.source AND h.line = trim(x.line)) GROUP BY 1, 2")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, SEG16: texts without running headers."""
    d = docs(spark, sf_dir)
    return segment.without_headers(d, segment.running_headers(d, "source", "doc_id", share=0.1), "source", "doc_id")


@query()
def text_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: chapters of plain texts."""
    return segment.text_chapters(docs(spark, sf_dir), ["doc_id"])


_PAGE = "regexp_replace(regexp_replace(html, '(?is)<(head|script|style)\\b.*?</(head|script|style)>', '', 'g'), '(?is)<!--.*?-->', '', 'g')"
_ENT = "x"
for _name, _char in tx.ENTITIES:
    _ENT = f"replace({_ENT}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_ENT}, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t\\r\\f\\v]+', ' ', 'g'))), lambda v: v <> ''), chr(10)) AS text
FROM (SELECT page_id, regexp_replace(regexp_replace({_PAGE}, '(?i)</(p|div|h[1-6]|li|tr|blockquote|section|article|nav|ul|ol|footer|header|table)>|<br\\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS x FROM pages)""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA23: text lines of pages."""
    return table(spark, sf_dir, "pages").select("page_id", tx.html_to_text("html").alias("text"))


@query("SELECT page_id, CAST(len(h) AS BIGINT) AS headings, array_to_string(list_transform(h, lambda v: trim(regexp_replace(v, '(?s)<[^>]*>', '', 'g'))), '|') AS titles FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages)")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA27: headings of pages."""
    h = tx.headings("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(h).cast("long").alias("headings"), F.array_join(h, "|").alias("titles"))


@query("""SELECT page_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(head|script|style)\\b.*?</(head|script|style)>', '', 'g'), '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'),
'(?is)<(/?)(p|br|b|i|em|strong|h[1-6]|ul|ol|li|blockquote)(\\s[^>]*)?/?>', chr(1) || '\\1\\2' || chr(2), 'g'), '(?s)<[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>') AS html FROM pages""")
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA24: pages with a short list of tags and no attributes."""
    return table(spark, sf_dir, "pages").select("page_id", tx.sanitize_html("html").alias("html"))


@query("SELECT page_id FROM pages WHERE html <> '' AND length(trim(regexp_replace(html, '(?s)<h[1-6].*', ''))) >= 20")
def pages_with_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA26, FIL11: pages that are more than a heading."""
    return table(spark, sf_dir, "pages").where((F.col("html") != "") & (F.length(F.trim(F.regexp_replace("html", "(?s)<h[1-6].*", ""))) >= 20)).select("page_id")


@query("SELECT doc_id, regexp_replace(text, '(?im)^licensed under.*$|^copyright.*$|^all rights reserved.*$', '', 'g') AS text FROM documents")
def licence_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA25: texts without licence lines."""
    return docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(?im)^licensed under.*$|^copyright.*$|^all rights reserved.*$", "").alias("text"))


_TOK = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(lower(text), '[‘’]', '''', 'g'), '[^a-z0-9'' ]+', ' ', 'g'), ' +'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: w <> '')"


@query(f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS tokens, array_to_string({_TOK}[1:20], ' ') AS first_tokens FROM documents")
def tokens_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA2: comparable tokens."""
    t = docs(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join(F.slice("t", 1, 20), " ").alias("first_tokens"))


@query()
def compare_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA21, SCA22: run-together form with American spelling; the suffix rules have no short SQL."""
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.compare_form("text")).alias("form_md5"))
