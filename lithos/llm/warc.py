"""Content-addressed WARC archive.

An archive is two Parquet tables: `payloads` holds every distinct payload once under its SHA-256,
`headers` holds the exact header block of every record (the WARC header, and the HTTP header its
block begins with) with the digest of its payload. The records come back through a join, which
carries digests and lengths and a payload only where it's asked for; each payload is verified once
against its digests. `write_files` writes the records as WARC/1.1 files that any reader takes.

A response's block is the HTTP header and the payload, a revisit's only the HTTP header: it refers to
the response by the payload's digest (profile identical-payload-digest). Every record has an id of
its own. The page's id stands in a header field Page-ID, that of a revisit's response in
Refers-To-Page-ID.

Nulls: a null html is an empty payload, a null url is written as `urn:no-url:` and read as null, a
null page_id sorts after all others (if a payload has only null ids, all its records are responses).
Rows that repeat a page_id and a payload are one capture listed twice: the same record type for each.
Empty input gives an empty archive, very long payloads are like others (2 GB is a value's bound).
Only page_id, url and html are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed

CRLF = "\r\n"
# Digits of Spark's base 32, the alphabet of RFC 4648, and the profile of revisits.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:no-url:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight times 20, each four digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def write_archive(pages: DataFrame, path: str, least_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Writes the records of `pages` (page_id, url, html) to `path`, dated `date` (now by default).

    Of records with equal payloads of `least_revisit_bytes` or more the one with the smallest
    page_id is a response and the others revisit it."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.unhex(F.sha2(payload, 256)).alias("digest")
    stored = pages.select(payload.alias("payload"), digest).groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.withColumns({"sha1": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")}).write.parquet(f"{path}/payloads")
    # The ids are random, so they are written before anything is derived from them.
    entries = checkpointed(pages.select("page_id", F.coalesce(url, F.lit(NO_URL)).alias("url"), digest, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("id")))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "id"))
    first = entries.groupBy("digest").agg(least.alias("first")).select("digest", F.col("first.page_id").alias("first_page"), F.col("first.id").alias("first_id"))
    known = spark.read.parquet(f"{path}/payloads").select("digest", "sha1", "bytes").join(first, "digest")

    revisit = (F.col("bytes") >= least_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, F.col("first_id"))),
        line("Page-ID", F.col("page_id").cast("string")),
        line("Refers-To-Page-ID", F.when(revisit, F.col("first_page").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )
    entries.join(known, "digest").withColumn("http", http).select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of an archive: page_id, url, record_type, refers_to, record_id, payload,
    payload_digest, payload_bytes, record (the record's bytes), verified (the payload has its digests).
    A payload that hasn't is an error, or just told if not `strict`."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value=r"([^\r\n]*)": F.nullif(F.regexp_extract(text, rf"\n{name}: {value}\r\n", 1), F.lit(""))
    fields = spark.read.parquet(f"{path}/headers").select(
        "digest",
        "header",
        field("Page-ID").cast("long").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit(NO_URL)).alias("url"),
        field("WARC-Type").alias("record_type"),
        field("Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)").alias("stated_digest"),
    )
    # Measured and verified once for a payload, before the join.
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("sound"),
    )
    verified = F.col("sound") & (F.col("payload_digest") == F.col("stated_digest"))
    if strict:
        verified = F.when(verified, True).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its digest: "), "stated_digest")).cast("boolean"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return fields.join(payloads, "digest").select("page_id", "url", "record_type", "refers_to", "record_id", "payload", "payload_digest", "payload_bytes", F.concat("header", body).alias("record"), verified.alias("verified"))


def write_files(spark: SparkSession, path: str, out: str, records_a_file: int = 10_000) -> None:
    """Writes an archive's records as WARC files below `out`: Spark's text files, with the two line
    ends that follow a WARC record for separators."""
    records = read_archive(spark, path).filter("verified")
    records.select(F.decode("record", "UTF-8").alias("record")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_a_file).text(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, header, block of each record of the WARC files below a folder, a file at
    a time, by the lengths that the headers state."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data, at, rows = content.as_py(), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    header = data[at:end].decode()
                    fields = dict(line.split(": ", 1) for line in header.split(CRLF)[1:])
                    size = int(fields["Content-Length"])
                    rows.append((fields["WARC-Type"], fields["WARC-Record-ID"], header, data[end + 4 : end + 4 + size]))
                    at = end + 4 + size + 4
                for k in range(0, len(rows), 256):
                    part = rows[k : k + 256]
                    kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)], ["record_type", "record_id", "header", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, "record_type string, record_id string, header string, block binary")
