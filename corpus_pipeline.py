"""A corpus from raw documents to token ids: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, langid, queries, simhash, suffix
from quire.llm.scratch import bounded_batches, materialize, text_hash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and Jaccard similarity of near copies, beside those whose fingerprints op2 links.
NEAR_WORDS, NEAR_LEAST = 5, 0.8
#: Words in a row whose repetition makes a passage, as 400 bytes do.
PASSAGE_WORDS = 51


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; ``lang`` becomes the predicted one.

    A null, empty or letterless text has none and goes; repeated rows and rows without an identifier stay as they are.
    """
    bounded_batches(spark)
    found = langid.predict(docs, langid.train(docs, langid.learnable()), keep=COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_id``, the identifier as text (null: empty), so that rows without one join as well."""
    return rows.withColumn("row_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of the smallest identifier, null last, ties to the smallest hash of the text.

    Null counts as empty; of rows with one identifier and text one stays.
    """
    similar = simhash.similar_links(docs, NEAR_WORDS, NEAR_LEAST)
    kept = keyed(simhash.representatives(docs, similar=similar)).select("row_id", "text_hash")
    rows = keyed(docs.select(*COLUMNS)).withColumn("text_hash", text_hash(F.col("text")))
    return rows.join(kept, ["row_id", "text_hash"], "left_semi").dropDuplicates(["row_id", "text_hash"]).select(*COLUMNS)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of repeated passages; a document of which no word is left goes, a null, empty or blank text too."""
    cut = suffix.remove_repeats(docs, keep=("lang", "source"), words=PASSAGE_WORDS, as_text=True)
    return cut.withColumnRenamed("kept", "text").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes contaminated rows; another text of the same identifier stays, and so does a null or wordless one."""
    marked = decontam.overlaps(docs, queries.table(spark, sf_dir, "benchmark")).where("contaminated")
    rows = keyed(docs.select(*COLUMNS)).withColumn("text_hash", text_hash(F.col("text")))
    return rows.join(keyed(marked).select("row_id", "text_hash"), ["row_id", "text_hash"], "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and decoded text; null counts as empty, repeated rows repeat."""
    return queries.bpe_digest(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Fingerprint groups, trained models and byte-level cuts have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
