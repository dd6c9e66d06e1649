"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, linededup, media, mixing, packing, quality, sharding, simhash, toxicity, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_size(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.quality(documents, documents, table(spark, sf_dir, "labels"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_lines").cast("int").alias("n_lines"), F.col("removed_lines").cast("int").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity(documents, documents, table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_quality, op4_fingerprint, op5_simhash, op6_media, op7_linededup, op8_toxicity, op9_mixing, op10_warc)}

ORACLES = {
    "op7_linededup": r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM docs WHERE len(ls) >= 3)
  WHERE trim(ls[i] || ls[i + 1] || ls[i + 2], ' ') <> ''
),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
covered AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS at FROM later GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(c.at), 0)::INT AS removed_lines,
  md5(CASE WHEN c.at IS NULL THEN text
      ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(c.at, i)), lambda i: ls[i]), chr(10)), '') END) AS kept_md5
FROM docs d LEFT JOIN covered c USING (doc_id)
""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') AS u, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, chr(13) || chr(10) AS nl FROM pages),
q AS (SELECT *, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, n >= 100 AND page_id > first AS again FROM q),
s AS (
  SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
    || 'WARC-Date: 2000-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || u || nl || 'WARC-Payload-Digest: sha256:' || digest || nl
    || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || first || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl ELSE '' END
    || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END || nl || nl || CASE WHEN again THEN '' ELSE h END || nl || nl AS record
  FROM r
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to,
  octet_length(encode(record))::BIGINT AS record_bytes, md5(record) AS record_md5
FROM s
""",
}
