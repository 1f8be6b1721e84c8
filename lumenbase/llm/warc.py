"""Content-addressed web archive: payload bytes once by digest, record headers apart, records rebuilt through joins.

Two tables make an archive: `payloads` (digest, length, payload), one row per distinct payload, and `headers` (page_id,
url, record_type, refers_to, digest, the exact header block), one row per record. A record is its header block, an empty
line, and the payload that its digest names, or nothing for a revisit. Payloads are checked on the way in (equal digests
must have equal second digests and lengths) and on the way out (bytes are digested again and compared).

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is the response and the others
revisit it; shorter payloads are always responses. All of it runs on built-in functions in the JVM.

Defined results: null html is the empty payload; rows with a null id are left out and repeated ids count once (see
common.keyed); a null url gives an empty target; an empty table gives an empty archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbase.llm.common import discard, fresh_path, materialize, release_later, write_once

CRLF = "\r\n"
#: Fixed value: the standard's profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def one_row_per_page(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).where(F.col("page_id").isNotNull())
    if rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("page_id").agg(F.min(F.struct("payload", "url")).alias("r")).select("page_id", "r.url", "r.payload")
    return rows


def header_block(page_id: Column, url: Column, kind: Column, refers_to: Column, payload_digest: Column, length: Column, date: str) -> Column:
    """The record's header lines, exact to the byte."""
    record = F.concat(F.lit("<urn:page:"), page_id, F.lit(">"))
    original = F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), refers_to, F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: "), record,
        F.lit(f"{CRLF}WARC-Date: {date}"),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), payload_digest,
        F.coalesce(original, F.lit("")),
        F.when(kind == "revisit", F.lit(f"{CRLF}WARC-Profile: {PROFILE}")).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(length),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `path`/payloads and `path`/headers. A payload moves once, for its first page; headers never carry it. `date`: the
    WARC-Date of all records, for the pages have none of their own."""
    rows = one_row_per_page(pages, id_col, url_col, html_col)
    heads = rows.select("page_id", "url", digest(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("length"), F.md5("payload").alias("second"))
    heads = materialize(heads, "digests")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.min("second").alias("low"), F.max("second").alias("high"))
    same = (F.col("shortest") == F.col("longest")) & (F.col("low") == F.col("high"))
    first = first.select("digest", F.when(same, F.col("first")).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), "digest"))).alias("first"))
    revisit = (F.col("length") >= least) & (F.col("page_id") != F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    records = heads.join(first, "digest").select("page_id", "url", kind.alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), "digest", "length")
    records = records.select(
        "page_id", "url", "record_type", "refers_to", "digest",
        header_block(F.col("page_id"), F.col("url"), F.col("record_type"), F.col("refers_to"), F.col("digest"), F.col("length"), date).alias("header"),
    )
    write_once(records, f"{path}/headers")
    owners = first.select(F.col("first").alias("page_id"), "digest")
    write_once(rows.select("page_id", "payload").join(owners, "page_id").select("digest", F.octet_length("payload").cast("long").alias("length"), "payload"), f"{path}/payloads")
    discard(heads)


def checked_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; one whose bytes don't give its digest ends the query."""
    rows = spark.read.schema("digest string, length long, payload binary").parquet(f"{path}/payloads")
    good = (digest(F.col("payload")) == F.col("digest")) & (F.octet_length("payload") == F.col("length"))
    return rows.withColumn("digest", F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a payload doesn't give its digest "), "digest"))))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, record_type string, refers_to long, digest string, header string").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (the full one, of revisits too), record (its bytes as archived)."""
    joined = read_headers(spark, path).join(checked_payloads(spark, path), "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    record = F.concat(F.encode("header", "UTF-8"), F.lit(CRLF).cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload", record.alias("record"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, all taken from the rebuilt record:
    its header lines, and the body behind them or, of a revisit, the payload that its digest names. A record whose body
    isn't of its Content-Length or whose payload doesn't give its header's digest ends the query."""
    parts = read_records(spark, path).select("payload", "record", F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1).alias("head"))
    head, before = F.col("head"), F.octet_length("head") + 4
    parts = parts.select(
        "head", "payload",
        F.regexp_extract(head, "^WARC/1.1\r\nWARC-Type: ([a-z]+)\r\n", 1).alias("record_type"),
        F.regexp_extract(head, "\r\nContent-Length: ([0-9]+)$", 1).try_cast("long").alias("stated"),
        F.regexp_extract(head, "\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("named"),
        F.substring("record", before + 1, F.octet_length("record") - before - 4).alias("body"),
        F.substring("record", F.octet_length("record") - 3, F.lit(4)).alias("end"),
    )
    whole = (F.octet_length("body") == F.col("stated")) & (F.col("end") == F.lit(CRLF + CRLF).cast("binary"))
    content = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    parts = parts.withColumn("content", F.when(F.coalesce(whole, F.lit(False)), content).otherwise(F.raise_error(F.concat(F.lit("a record isn't of its Content-Length: "), "head"))))
    parts = parts.select("head", "record_type", "named", F.octet_length("content").cast("long").alias("payload_bytes"), digest(F.col("content")).alias("found"))
    return parts.select(
        F.regexp_extract(head, "\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>", 1).cast("long").alias("page_id"),
        "payload_bytes",
        F.when(F.col("found") == F.col("named"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("a record doesn't give its digest: "), "head"))).alias("payload_digest"),
        "record_type",
        F.regexp_extract(head, "\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1).try_cast("long").alias("refers_to"),
    )


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the archive of all pages to the shared folder and read it back."""
    path = fresh_path(pages.sparkSession, "archive")
    release_later(pages.sparkSession, path)
    write_archive(pages, path, **options)
    return read_back(pages.sparkSession, path)
