"""Queries over the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, divergence, hnsw, htmltext, langid, lm_score, prefix_trie, quality, simhash, sstable, suffix, token_counts
from quire.llm.scratch import bounded_batches, materialize

END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sstable.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.train(stats, table(spark, sf_dir, "labels"), quality.learnable())
    scored = stats.select("doc_id", (~quality.learnable()).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), kept=F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = langid.learnable()
    found = langid.predict(docs, langid.train(docs, usable))
    return found.select("doc_id", (~usable).alias("held_out"), "lang_pred", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, rows = lm_score.fit(docs, spell=True)
    return lm_score.score_numbered(rows, net)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_sstable": op5_sstable,
    "op6_hnsw": op6_hnsw,
    "op7_suffix": op7_suffix,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_lm_score": op10_lm_score,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

#: DuckDB's SQL for the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS len, array_to_string(w[i:i + 12], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len FROM bw),
dw AS (
  SELECT doc_id, len, i, array_to_string(w[i:i + len - 1], ' ') AS key
  FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, sizes WHERE len(w) >= len)
), hit AS (SELECT dw.doc_id, dw.i, dw.len, bw.item_id FROM dw JOIN bw USING (key, len)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c, c - c % 100 AS base,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS crc
  FROM turns
), shared AS (SELECT c, base, xor(crc, 4294967295) % 6 AS h FROM ids),
full_turns AS (
  SELECT s.c, t.k, t.said FROM shared s JOIN turns t ON t.c = s.base AND t.k <= s.h
  UNION ALL
  SELECT s.c, t.k, t.said FROM shared s JOIN turns t ON t.c = s.c AND t.k > s.h
), numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, said FROM full_turns),
paths AS (
  SELECT c, d, md5(list(said) OVER (PARTITION BY c ORDER BY d)::VARCHAR) AS node, length(said.t) AS chars FROM numbered
  UNION ALL SELECT c, 0, 'root', 0 FROM shared
), nodes AS (SELECT d, node, min(c) AS owner, count(*) AS members, any_value(chars) AS chars FROM paths GROUP BY ALL),
up AS (
  SELECT n.d, n.node, n.owner, n.members, n.chars, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.c = n.owner AND p.d = n.d - 1
), kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.node, sum((u.members - 1) * u.chars)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM up u JOIN paths a ON a.c = u.owner AND a.d <= u.d LEFT JOIN kids k ON k.d = u.d AND k.node = u.node GROUP BY ALL
), lasts AS (SELECT c, max(d) AS d FROM paths GROUP BY ALL),
ends AS (SELECT d, node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM lasts JOIN paths USING (c, d) GROUP BY ALL)
SELECT u.owner AS conv_id, u.d::BIGINT AS depth, p.owner AS parent_conv_id, u.members AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.leaves AS n_leaves,
  b.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM up u JOIN below b USING (d, node) LEFT JOIN kids k USING (d, node) LEFT JOIN ends e USING (d, node) LEFT JOIN nodes p ON p.d = u.d - 1 AND p.node = u.parent
""",
    "op13_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT i, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT i) >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p, 1 + 1000000000 * (lang_n + 2) // (total + 2 * v) AS q
  FROM cells JOIN sizes USING (lang)
), apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON (x.lang, x.source, x.item) = (a.lang, a.source, b.source)),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 10
""",
}
