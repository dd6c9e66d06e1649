"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 digest, the records' exact header bytes in a
second table, and original records come back by joining the two. Digests are computed from the bytes
read back and compared, so a damaged payload is found and not served.

The payload table is bucketed by digest, so that reading joins shuffle headers only. Payloads of
MIN_BYTES or more have one response each and meet their headers one to one; smaller ones, which very
many records may share, are joined by an ordinary shuffle that adaptive execution splits; a revisit's
block is empty, so it needs the size and not the bytes.

The record with the smallest page_id of those with equal payloads of at least `MIN_BYTES` bytes is a
response; the others are revisits that refer to it. Smaller payloads are always responses.

Defined results: a null payload is an empty one, a null url becomes an empty target; repeated rows
with one page_id are records of their own, and those with the smallest page_id are all responses;
an empty table makes an empty archive; other columns are ignored. Ids that aren't whole numbers are an
error, as a null one is: records are named by them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

MIN_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"


def header(fields: list[tuple[str, Column]]) -> Column:
    """The bytes before a record's block; fields with null values are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF)).cast("binary")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> str:
    """Write pages (page_id, url, html) to folder/payloads and folder/headers. Returns the name under
    which this session knows the payloads and their buckets."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page_id = F.coalesce(F.col("page_id").cast("long"), F.raise_error(F.lit("a page without an id")).cast("long"))
    rows = pages.select(page_id.alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    index = rows.select("page_id", "url", "digest", "n")
    firsts = index.groupBy("digest").agg(F.min("page_id").alias("first"))
    first = index.join(firsts, "digest").withColumn("revisit", (F.col("n") >= min_bytes) & (F.col("page_id") > F.col("first")))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("revisit"), F.col("first"))
    headers = header([
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(F.col("page_id"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", record_id(refers)),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))),
    ])
    first.select(headers.alias("header"), "digest").write.parquet(f"{folder}/headers")
    # one payload for each digest: an aggregate by the digest alone, whose buffer holds one value
    spark, name = pages.sparkSession, f"warc_{uuid.uuid4().hex}"
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(buckets, "digest").option("path", f"{folder}/payloads").saveAsTable(name)
    return name


def read_payloads(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """digest, payload, n and verified: whether the stored bytes still have the digest. name: the
    table's, where this session wrote it."""
    stored = spark.table(name) if name else spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    return stored.withColumn("n", F.octet_length("payload").cast("long")).withColumn("verified", F.sha2("payload", 256) == F.col("digest"))


def field(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The stored headers and what they say."""
    headers = spark.read.schema("header binary, digest string").parquet(f"{folder}/headers")
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).cast("long")
    return headers.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), F.when(field("WARC-Refers-To").isNotNull(), page("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("payload_digest"), field("Content-Length").cast("long").alias("content_length"), "header",
    )


def read_records(spark: SparkSession, folder: str, name: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The original records: page_id, record_type, refers_to, payload_digest, payload_bytes, and the
    record's own bytes (header, block and trailer). A payload that no longer has its digest is an error."""
    index, payloads = read_index(spark, folder), read_payloads(spark, folder, name)
    intact = F.when(F.col("verified"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("long"))
    revisit = F.col("record_type") == "revisit"
    match = F.col("payload_digest") == F.col("digest")

    def record(rows: DataFrame, block: Column) -> DataFrame:
        whole = F.concat("header", block, F.lit((CRLF * 2).encode()))
        return rows.select("page_id", "record_type", "refers_to", "payload_digest", intact.alias("payload_bytes"), whole.alias("record"))

    large = record(index.where(~revisit & (F.col("content_length") >= min_bytes)).join(payloads, match), F.col("payload"))
    small = payloads.where(F.col("n") < min_bytes).select("digest", "payload", "n", "verified")
    small = record(index.where(~revisit & (F.col("content_length") < min_bytes)).join(small.repartition("digest"), match), F.col("payload"))
    again = record(index.where(revisit).join(payloads.select("digest", "n", "verified").repartition("digest"), match), F.lit(b""))
    return large.unionByName(small).unionByName(again)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to an archive, read its records back and report each page's: beside the index, how
    many bytes the whole record has and their MD5."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = read_records(pages.sparkSession, folder, write_archive(pages, folder))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.md5("record").alias("record_md5"))
