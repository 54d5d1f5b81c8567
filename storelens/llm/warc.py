"""A content-addressed WARC archive.

Two Parquet tables make the archive.  ``payloads`` holds the bytes of each
distinct payload once, under its SHA-256; ``records`` holds the exact header
block of each record and the digest of its payload.  A record is its header
block, its payload and two line ends; joining the tables on the digest gives
back each record byte for byte.

Of the records with equal payloads (at least ``revisit_from`` bytes long) the
one with the largest key is the response; the others are revisits and refer to
it.  Digests are verified when payloads are read back.

Only digests and keys are shuffled to find equal payloads, combined before the
shuffle, so a payload with very many copies is no hot group.

Nulls: a null payload is empty; a null URL is written as an empty target, and
control characters of a URL are percent-encoded.  Keys should be unique: of
repeated rows of the largest key each is a response.  A null key is kept as a
record of its own text ``null``.  Columns other than the three named are not
archived, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import storage

_BASE_32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits are four groups of eight base-32 digits."""
    digits = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0"), _BASE_32_DIGITS, _BASE_32) for at in (1, 11, 21, 31)))


def one_line(url: Column) -> Column:
    """The URL with its control characters percent-encoded, so that it cannot end its header line."""
    safe = url
    for code in (*range(0x20), 0x7F):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), safe).otherwise(url)


def _headers(fields: list[tuple[str, Column]]) -> Column:
    """The exact header block; fields that are null are left out."""
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", revisit_from: int = 0) -> None:
    """Writes ``payloads`` and ``records`` below path."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    raw = pages.select(F.col(key).alias("record_id"), one_line(F.coalesce(F.col(url), F.lit(""))).alias("target"), body.alias("payload"))
    digested = raw.withColumns({"sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "sha1": base32_sha1(F.col("payload"))})
    slim = digested.drop("payload")
    heads = storage.written(slim, "digests", f"{path}/digests")
    chosen = heads.groupBy("sha256").agg(F.max("record_id").alias("response_id"))
    owners = heads.where(F.col("payload_bytes") >= revisit_from).join(chosen, "sha256", "left").unionByName(heads.where(F.col("payload_bytes") < revisit_from).withColumn("response_id", F.col("record_id")))
    typed = owners.withColumns({"record_type": F.when(F.col("record_id").eqNullSafe(F.col("response_id")), "response").otherwise("revisit")})
    revisit = F.col("record_type") == "revisit"
    block = _headers(
        [
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("record_id").cast("string"), F.lit("null")), F.lit(">"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("target")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">")))),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        ]
    )
    typed.select("record_id", "sha256", block.alias("header")).write.parquet(f"{path}/records")
    # The copies of a payload are merged before the shuffle; only one of each is sent from a task.
    digested.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    storage.drop(pages.sparkSession, f"{path}/digests")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt from the two tables: record_id, header, payload, record.

    ``record`` is the record's exact bytes (a revisit's has no payload);
    ``payload`` is the full payload it stands for, verified against its SHA-256.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    verified = payloads.where(F.when(F.sha2("payload", 256) == F.col("sha256"), True).otherwise(F.raise_error(F.concat(F.lit("payload differs from digest "), F.col("sha256")))))
    joined = spark.read.parquet(f"{path}/records").join(verified, "sha256", "left")
    empty = F.lit(bytearray(b""))
    content = F.when(header_field(F.col("header"), "WARC-Type") == "revisit", empty).otherwise(F.col("payload"))
    return joined.select("record_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), content, F.lit(bytearray(_END))).alias("record"))


def header_field(header: Column, name: str) -> Column:
    """A named field of a header block, or null."""
    found = F.regexp_extract(header, rf"(?:^|\r\n)(?i:{name}): ?([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """What the archives say: record_id, record_type, refers_to, and length and digest of the full payload.

    Content length and digest in the header are checked against the bytes.
    """
    header = F.col("header")
    header_bytes = F.octet_length(header)
    content_length = header_field(header, "Content-Length").cast("long")
    held = F.octet_length("record") - header_bytes - len(_END)
    digest = base32_sha1(F.col("payload"))
    sound = (content_length == held) & (header_field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("digest")))
    read = records.withColumn("digest", digest)
    return read.select(
        "record_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id").cast("string")))).alias("payload_digest"),
        header_field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(header_field(header, "WARC-Refers-To"), r"urn:page:(-?\d+)", 1).cast("long").alias("refers_to"),
    )
