"""Content-addressed WARC archive.

``write_archive`` keeps two tables in one folder:

* ``payloads`` - every payload once, under its SHA-256, with its SHA-1 and
  length, checked while grouping (equal SHA-256 must mean equal SHA-1 and
  length) and again on reading (the digest is recomputed from the stored bytes);
* ``records`` - the exact header bytes of each WARC record and the digest of its
  payload.  Of records with equal payloads the one with the largest ``page_id`` is
  the response, the others are revisits that refer to it.

``read_archive`` parses the headers back and joins them with the verified payloads;
``original_records`` joins header and payload bytes to the records as they would stand in a WARC
file, and ``export`` writes such files.

Payloads are grouped map-side first, so a page copied into a third of all rows sends one payload per
task; records carry only digests through the join, which adaptive execution splits when one digest is hot.

Defined results: null html is the empty payload; empty payloads are deduplicated
like others; payloads under ``min_bytes`` bytes are all responses; rows that repeat the largest
page_id of a payload are all responses, sharing the one stored payload; a null
page_id is smaller than any other; a null url leaves the target header out, line breaks in urls are
percent-encoded; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

from .common import same, text_bytes

DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:tessera:page:"
# WARC/1.1 names this profile for revisits by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    records: DataFrame


def base32(hexed: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them are four base-32 digits."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _addressed(pages: DataFrame) -> DataFrame:
    raw = pages.select("page_id", F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    return raw.select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("address"),
                      F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("size"))


def _header(kind: Column, keeper: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def name(page: Column) -> Column:
        return F.concat(F.lit(f"<{RECORD}"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    empty = F.lit("")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", url), empty),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(keeper)))).otherwise(empty),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))), F.lit(CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> Archive:
    """Write ``pages`` (page_id, url, html) under ``path`` and return the tables as read back."""
    spark = pages.sparkSession
    rows = _addressed(pages)
    ids = F.struct("sha1", "size")
    (rows.groupBy("address").agg(F.max("page_id").alias("keeper"), F.first("payload").alias("payload"),
                                 F.min(ids).alias("least"), F.max(ids).alias("most"))
     .select("address", F.when(F.col("least") == F.col("most"), F.col("payload"))
             .otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("payload"), "least.*", "keeper")
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    payloads = spark.read.parquet(f"{path}/payloads")
    keepers = payloads.select(F.col("address").alias("at"), "keeper")
    light = rows.select("page_id", "url", "address", "sha1", "size")
    kind = F.when((F.col("size") >= min_bytes) & ~same(F.col("page_id"), F.col("keeper")), "revisit").otherwise("response")
    (light.join(keepers, F.col("address") == F.col("at"))
     .select(_header(kind, F.col("keeper")).alias("header"), "address")
     .write.option("compression", "zstd").parquet(f"{path}/records"))
    return open_archive(spark, path)


def open_archive(spark: SparkSession, path: str) -> Archive:
    return Archive(spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/records"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(value: Column) -> Column:
    return F.regexp_extract(value, rf"^<{RECORD}(.*)>$", 1).try_cast("bigint")


def read_archive(archive: Archive) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of every record.

    Headers are parsed; the payload's figures come from the stored bytes, whose address is recomputed.
    """
    stored = archive.payloads.select(
        F.col("address").alias("at"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("found"), (F.unhex(F.sha2("payload", 256)) == F.col("address")).alias("sound"))
    joined = archive.records.join(stored, F.col("address") == F.col("at"), "left")
    digest = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    checked = F.when(F.col("sound") & (F.col("found") == digest), F.col("found")).otherwise(
        F.raise_error(F.lit("a stored payload is missing or does not match its digest")))
    return joined.select(_page(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Target-URI").alias("url"),
                         _field("WARC-Type").alias("record_type"), _page(_field("WARC-Refers-To")).alias("refers_to"),
                         "payload_bytes", checked.alias("payload_digest"))


def original_records(archive: Archive, full: bool = False) -> DataFrame:
    """header and payload bytes of every record; revisits have no payload unless ``full``."""
    stored = archive.payloads.select(F.col("address").alias("at"), "payload")
    kept = F.lit(full) | (_field("WARC-Type") == "response")
    return archive.records.join(stored, F.col("address") == F.col("at")).select(
        "header", F.when(kept, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))


def export(archive: Archive, path: str, compression: str = "gzip") -> None:
    """Write the records as WARC files: header, payload, and the two line breaks that end a record."""
    (original_records(archive).select(F.concat("header", "payload").cast("string").alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", compression).text(path))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    return read_archive(write_archive(pages, scratch_path(pages.sparkSession, "warc"), min_bytes))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (
  SELECT page_id, body, h, max(page_id) OVER (PARTITION BY body) AS keeper FROM p),
b AS (
  SELECT page_id, body, keeper,
         [CAST('0x' || substr(h, CAST(1 + 5 * i AS INT), 5) AS BIGINT) FOR i IN range(0, 8)] AS v
  FROM k)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((v[1 + j // 4] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) AS INT), 1) FOR j IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""
