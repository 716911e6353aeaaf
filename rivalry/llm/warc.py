"""Content-addressed web archive.

Two tables below one folder: ``payloads`` holds each payload's bytes once, under its
SHA-256; ``headers`` holds one row per record with the exact header bytes and the digest.
A record is rebuilt by joining the two. Digests are verified whenever payloads are read.

Defined cases: a null payload is empty; an empty table gives an empty archive; a null URL
leaves its header line out; control characters in a URL are percent-encoded so that a
header cannot be broken. Of equal payloads of at least ``min_bytes`` the record with the
largest id is the response and the others revisit it; rows that repeat that largest id are
responses too (their payload is still stored once). A null id loses against any other.
Other columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(2**63)


def _records(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    return pages.select(
        F.coalesce(F.col(record_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.when(id_ == NO_ID, "none").otherwise(id_.cast("string")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _header(date: str) -> Column:
    """Exact header bytes: the WARC fields, a blank line, then the HTTP head."""
    revisit = F.col("refers_to").isNotNull()
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    safe_url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%00")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", safe_url),
        _line("WARC-Refers-To", _urn(F.col("refers_to"))), _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length),
        F.lit("\r\n" + HTTP_HEAD),
    ).cast("binary")


def _once(batches):
    """Keeps the first row of each digest; equal rows (same id, same payload) share a partition."""
    seen: set[str] = set()
    for batch in batches:
        fresh = []
        for d in batch.column("digest").to_pylist():
            fresh.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes one record per row. Payload bytes cross the network once, keyed by (digest, id),
    so copies of one payload are spread by their ids and only the winner is kept."""
    rows = _records(pages, record_id, url, payload)
    narrow = rows.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    winners = rows.groupBy("digest").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    repeated = winners.where("n > 1").select("digest", F.col("id").alias("winner"))
    heads = (narrow.join(repeated, "digest", "left")
             .withColumn("refers_to", F.when((F.col("n_bytes") >= min_bytes) & (F.col("winner") != F.col("id")), F.col("winner"))))
    heads.select("digest", _header(date).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    chosen = rows.select("digest", "id", "payload").join(winners.select("digest", "id").hint("shuffle_hash"), ["digest", "id"], "left_semi")
    chosen.select("digest", "payload").mapInArrow(_once, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; bytes that do not match their digest raise an error."""
    good = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads").select("digest", checked.alias("payload"))


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"<urn:record:(-?[0-9]+)>", 1).try_cast("long")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the fields that its stored header holds."""
    raw = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    return raw.select(
        "digest", "header", _id_of(_field("WARC-Record-ID")).alias("record_id"), _field("WARC-Type").alias("record_type"),
        _id_of(_field("WARC-Refers-To")).alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_sha1"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records joined to what is measured on the stored, verified payload (not taken from the header)."""
    measured = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                                 F.sha1("payload").alias("payload_digest"))
    return read_headers(spark, path).join(measured, "digest")


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """The exact WARC record bytes of every row, and its full payload."""
    both = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("record_id", "record_type", "refers_to", "url", "payload",
                       F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
