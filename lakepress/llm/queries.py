"""The opN queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.llm import ann, byte_bpe, line_chunks, media, ngram_join, packing, pii, prefix_trie, secret_scan, sentencepiece_ffbs, sharding, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ffbs.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.span_text("found").alias("spans"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_chunks.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.chunked_media(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_scan.scan_secrets(docs).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secret_spans")).alias("spans"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_pii, op3_ann, op4_line_dedup, op5_toxicity, op6_media, op7_secrets, op8_packing, op9_ngram_join, op10_sharding, op11_prefix_trie, op12_whitening, op13_byte_bpe)
}
ORACLE_SQL: dict[str, str] = {
    # the checksum is worked out bit by bit, a node is its whole text, and subtrees are joins of nodes with their owners' paths
    "op11_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS at
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv, conv::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS acc FROM t
  UNION ALL
  SELECT conv, s, i + 1, xor((CASE WHEN i % 8 = 0 THEN xor(acc, ascii(s[i // 8 + 1])::BIGINT) ELSE acc END) >> 1,
                             3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(acc, ascii(s[i // 8 + 1])::BIGINT) ELSE acc END) & 1))
  FROM crc WHERE i < 8 * length(s)),
heads AS (SELECT conv, conv - conv % 5 AS base, xor(acc, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(s)),
turns AS (
  SELECT h.conv, t.at AS place, t.role, t.text FROM heads h JOIN t ON t.conv = h.base WHERE t.at < h.h
  UNION ALL
  SELECT h.conv, t.at + 100, t.role, t.text FROM heads h JOIN t ON t.conv = h.conv WHERE t.at >= h.h),
path AS (
  SELECT conv, row_number() OVER w AS depth, strlen(text) AS size,
         string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '|') OVER w AS node
  FROM turns WINDOW w AS (PARTITION BY conv ORDER BY place)
  UNION ALL SELECT conv, 0, 0, '' FROM heads),
last AS (SELECT conv, max(depth) AS depth FROM path GROUP BY conv),
node AS (
  SELECT node, depth, min(conv) AS owner, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CASE WHEN is_end THEN conv::VARCHAR END, ',' ORDER BY conv), '')) AS ends
  FROM (SELECT p.*, l.depth = p.depth AS is_end FROM path p JOIN last l ON l.conv = p.conv) GROUP BY node, depth),
up AS (
  SELECT v.node, v.depth, v.owner, v.n, v.size, a.node AS above, a.depth AS above_depth
  FROM node v JOIN path a ON a.conv = v.owner AND a.depth <= v.depth),
kids AS (SELECT above AS node, above_depth AS depth, count(*) FILTER (depth = above_depth + 1) AS n_children, sum((n - 1) * size) AS saved FROM up GROUP BY ALL),
leaf AS (SELECT u.above AS node, u.above_depth AS depth, count(*) AS n_leaves FROM up u JOIN kids k ON k.node = u.node AND k.depth = u.depth WHERE k.n_children = 0 GROUP BY ALL),
parent AS (SELECT u.node, u.depth, p.owner FROM up u JOIN node p ON p.node = u.above AND p.depth = u.above_depth WHERE u.above_depth = u.depth - 1)
SELECT v.owner AS conv_id, v.depth, p.owner AS parent_conv_id, v.n AS n_convs, k.n_children, l.n_leaves, k.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM node v JOIN kids k ON k.node = v.node AND k.depth = v.depth JOIN leaf l ON l.node = v.node AND l.depth = v.depth
LEFT JOIN parent p ON p.node = v.node AND p.depth = v.depth
"""
}
