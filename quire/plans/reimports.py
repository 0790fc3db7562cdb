"""Queries over works that are imported anew.  A document is a work; every seventh one comes anew, read backwards by words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import reimport as ri
from quire.plans.base import query, shared_folder, table

_ANEW = "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN array_to_string(list_reverse(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), ' ') ELSE text END AS text FROM documents)"
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and a sum of each table by work."""
    marks = {"chapters": F.col("chapter_idx") * 7 + F.col("words"), "paragraphs": F.col("word_start") * 7 + F.col("word_end"), "chunks": F.col("start_word") * 7 + F.col("end_word")}
    out = None
    for name, df in tables.items():
        one = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(marks[name].cast("long")).alias("mark")).select(F.lit(name).alias("tbl"), "doc_id", "n", "mark")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, {_WORDS.format('text')} AS w FROM {_ANEW}), c AS (SELECT doc_id, i - 1 AS idx, len({_WORDS.format('l[i]')}) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)), p AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM c WHERE n > 0)
SELECT 'chapters' AS tbl, doc_id, count(*) AS n, CAST(sum(idx * 7 + n) AS BIGINT) AS mark FROM c WHERE n > 0 GROUP BY 2 UNION ALL SELECT 'paragraphs', doc_id, count(*), CAST(sum((e - n) * 7 + e) AS BIGINT) FROM p GROUP BY 2
UNION ALL SELECT 'chunks', doc_id, count(*), CAST(sum(s * 7 + least(s + 200, k)) AS BIGINT) FROM (SELECT doc_id, len(w) AS k, unnest(range(0, len(w), 160)) AS s FROM d) GROUP BY 2""")
def reimported_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH20, SET6: chapters, paragraphs and chunks of all works after some of them were imported anew, partitions of others untouched."""
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_folder(spark)}/imports-{uuid.uuid4().hex[:12]}"
    ri.store(ri.derived(docs, "doc_id", "text"), root, "doc_id")
    anew = docs.where("doc_id % 7 = 3")
    backwards = anew.withColumn("text", F.array_join(F.reverse(tx.fields("text")), " "))
    fresh = ri.derived(backwards, "doc_id", "text")
    ri.reimport(fresh, anew, root, "doc_id")
    return counts({name: ri.stored(spark, root, name) for name in fresh})
