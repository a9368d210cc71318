"""WARC as a content-addressed archive.

``write_archive`` stores two Parquet tables: ``payloads`` holds the bytes of
each distinct payload once, under its SHA-256; ``headers`` holds the exact
header block of every record and the digest of its payload. ``read_archive``
joins them back to the original records, re-computes both digests of every
stored payload and fails on any difference. ``export_warc`` writes the records
as WARC files.

Of records with equal payloads the one with the largest id is the ``response``
and carries the payload; the others are ``revisit`` records that refer to it.
``least_revisit`` sets the payload size from which this holds (0: all sizes);
smaller payloads are all responses.

Defined cases: a null payload is the empty one; a null id or URL leaves its
header field empty; rows repeated in full are records of their own (all but
the one that is the response are revisits); of equal payloads with equal
largest ids, one is the response; other columns are ignored; an empty table
gives an empty archive. Payloads of any size stay in one cell."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import scratch_root, written

CRLF = "\r\n"
#: Base-32 digits as conv() writes them and as RFC 4648 does.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """A 160-bit hexadecimal digest in base 32: five hex digits make four."""
    fours = [F.lpad(F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), CONV_DIGITS, RFC_DIGITS)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page: Column) -> Column:
    """The record id of a page: a name-based UUID's form of its id's MD5."""
    h = F.md5(F.concat(F.lit("page:"), page))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                                                     F.substring(h, 13, 4), F.substring(h, 17, 4),
                                                     F.substring(h, 21, 12)), F.lit(">"))


def build_headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: str,
                  least_revisit: int) -> tuple[DataFrame, DataFrame]:
    """The headers table and the payloads table of an archive of ``pages``."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # the copies of a digest shrink to one before the shuffle
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    records = written(rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("length"),
                                  base32(F.sha1("payload")).alias("sha1"),
                                  F.monotonically_increasing_id().alias("record")), "records")
    first = written(records.groupBy("digest").agg(F.max(F.struct("id", "record")).alias("first")), "first")
    joined = records.join(first, "digest")
    revisit = (F.col("length") >= least_revisit) & (F.col("record") != F.col("first.record"))
    shown = F.coalesce(F.col("id").cast("string"), F.lit(""))
    target = F.coalesce(F.col("first.id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _urn(F.concat_ws("#", shown, "record"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(""))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _header("X-Page-ID", shown),
        _header("X-Payload-Length", F.col("length").cast("string")),
        F.when(revisit, F.concat(
            _header("WARC-Profile", F.lit(IDENTICAL)),
            _header("WARC-Refers-To", _urn(F.concat_ws("#", target, F.col("first.record")))),
            _header("X-Refers-To-Page", target))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit(CRLF))
    return joined.select("record", head.alias("header"), "digest"), payloads


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", least_revisit: int = 0) -> None:
    headers, payloads = build_headers(pages, id_col, url_col, payload_col, date, least_revisit)
    payloads.write.parquet(f"{path}/payloads")
    headers.write.parquet(f"{path}/headers")


def header_field(name: str) -> Column:
    """A named field of the ``header`` block (null if absent)."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"{CRLF}{name}: "), found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: ``header``, ``block`` (the payload, or nothing for a
    revisit), ``payload`` (of revisits that of the record referred to),
    ``sha1``. A payload that is missing or does not match its SHA-256, its
    SHA-1 field or its length field ends the read with an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    stored = stored.select("digest", "payload", base32(F.sha1("payload")).alias("sha1"),
                           F.octet_length("payload").cast("long").alias("length"),
                           (F.sha2("payload", 256) == F.col("digest")).alias("whole"))
    records = spark.read.parquet(f"{path}/headers").join(stored, "digest", "left")
    sound = (F.col("whole") & (header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")))
             & (header_field("X-Payload-Length").cast("long") == F.col("length")))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("archive payload differs from its digest: "), F.col("digest"))).cast("binary"))
    return records.select("record", "header", checked.alias("payload"), "sha1", "length",
                          F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
                          .alias("block"))


def export_warc(records: DataFrame, path: str) -> None:
    """The records of ``read_archive`` as gzipped WARC files: header block,
    content block, two line ends."""
    whole = F.concat(F.col("header").cast("binary"), F.col("block"), F.lit(CRLF.encode()))
    (records.select(whole.cast("string").alias("value")).write.option("lineSep", CRLF)
     .option("compression", "gzip").text(path))


def page_digests(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as an archive in the shared folder, reads it back and
    returns what the records say of each page."""
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/llm-archive-{uuid.uuid4().hex}"
    write_archive(pages, path, **options)
    id_type = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    return read_archive(spark, path).select(
        header_field("X-Page-ID").try_cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        header_field("X-Refers-To-Page").try_cast(id_type).alias("refers_to"),
        F.octet_length("block").cast("long").alias("block_bytes"))


#: DuckDB's to_base writes the same digits as conv().
_GROUPS = " || ".join(f"to_base(('0x' || substr(h, {5 * k + 1}, 5))::BIGINT, 32, 4)" for k in range(8))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html AS same, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       translate({_GROUPS}, '{CONV_DIGITS}', '{RFC_DIGITS}') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
       CAST(CASE WHEN page_id = top THEN strlen(html) ELSE 0 END AS BIGINT) AS block_bytes
FROM p JOIN m ON html = same
"""
