"""The queries of the training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_knn, quality_rules, suffix_dedup, url_filter
from .common import table


def piece_model_path() -> str:
    """PIECE_MODEL in the environment, else the installed vocabulary file."""
    if "PIECE_MODEL" in os.environ:
        return os.environ["PIECE_MODEL"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs.select("doc_id", "text"), model).drop("text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families per document; licenses is a comma-joined list, '' for none."""
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs.select("doc_id", "text"), license_scan.train(docs)).drop("text")
    return found.withColumn("licenses", F.array_join("licenses", ","))


ALLOW = [("org", "/"), ("com", "/fr/")]
BLOCK = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK).drop("url")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fit ON parts.page_id = fit.page_id AND n = 1
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM per_source),
capped AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][rank % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / [3.0::DOUBLE, 1.0, 2.0][rank % 3 + 1] AS ratio FROM ranked),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM ranked)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
final AS (SELECT max(level) FILTER (WHERE level <= ratio) AS final FROM leveled),
plan AS (SELECT source, source_size, rank, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM leveled, final),
placed AS (
  SELECT doc_id, size, source_size, rank, target, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source),
shaped AS (
  SELECT *, least(1.0::DOUBLE, (2 * start + size)::DOUBLE / 2.0::DOUBLE / greatest(target, 1.0::DOUBLE)) AS share, [1.5::DOUBLE, 0.5, 1.0][rank % 3 + 1] AS a, [0.5::DOUBLE, 1.5, 1.0][rank % 3 + 1] AS b FROM placed)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - source_size - start)))::BIGINT AS taken,
  CASE WHEN a = b THEN share ELSE (sqrt(greatest(a * a + (b - a) * (a + b) * share, 0.0::DOUBLE)) - a) / (b - a) END AS position
FROM shaped
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def coded_rows(docs: DataFrame, model: piece_codec.PieceModel) -> DataFrame:
    """Encodes and decodes every text; the rows of the op7 contract."""
    coded = piece_codec.transcode(docs.select("doc_id", "text"), model)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_rows(table(spark, sf_dir, "documents"), piece_codec.read_model(piece_model_path()))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM docs))),
listed AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(listed.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE listed.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN listed USING (k) GROUP BY r
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_knn.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality_knn.apply(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_piece_codec": op7_piece_codec,
    "op8_line_dedup": op8_line_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_knn": op10_quality_knn,
}
SQL = {"op4_url_filter": OP4_SQL, "op5_mixing": OP5_SQL, "op8_line_dedup": OP8_SQL}
