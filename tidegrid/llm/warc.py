"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: ``payloads`` holds each distinct payload once under its
SHA-256, ``headers`` holds the exact header bytes of each record with the digest of its payload. Original
records are put together again by a join; the digest of every payload read is verified.

Defined results: a null payload counts as empty; a null url gives a record without a target; of records
with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response and the
others revisit it, smaller payloads are all responses; rows repeated with the smallest id are all
responses; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize, scratch_path

HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are eight groups of 20, each of four digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    address = F.unhex(F.sha2("payload", 256)).alias("address")

    firsts = materialize(rows.select(address, "id").groupBy("address").agg(F.min("id").alias("first_id")), "warc-firsts")
    # Dealt by digest and id, no key is hot, and repeats of one row meet without another exchange.
    owner = lambda c: F.coalesce(c, F.lit(-(2**63)))
    owners = rows.select("payload", address, owner(F.col("id")).alias("owner")).join(firsts.select("address", owner(F.col("first_id")).alias("owner")), ["address", "owner"], "left_semi")
    owners.groupBy("address", "owner").agg(F.first("payload").alias("payload")).select("address", "payload").write.parquet(f"{path}/payloads")

    facts = rows.select("id", "url", address, F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    target = F.coalesce(_line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))),
        target,
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", urn(F.col("first_id"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    facts.join(firsts, "address").select(header.cast("binary").alias("header"), "address").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: header, payload (whole, also of revisits) and record (the bytes as archived).

    Reading fails where a payload no longer has the digest it is stored under.
    """
    headers = spark.read.schema("header binary, address binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("address")
    payloads = payloads.select("address", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("payload digest mismatch")).cast("binary")).alias("payload"))
    text = F.col("header").cast("string")
    body = F.when(text.contains(f"{END}WARC-Type: revisit{END}"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return headers.join(payloads, "address").select("header", "payload", F.concat("header", body, F.lit(END + END).cast("binary")).alias("record"))


def describe_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from archived headers and payloads."""
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    digest = sha1_base32(F.col("payload"))
    checked = F.when(F.concat(F.lit("sha1:"), digest) == field("WARC-Payload-Digest"), digest).otherwise(F.raise_error(F.lit("payload differs from its header")).cast("string"))
    as_id = lambda name: F.nullif(number(field(name)), F.lit("")).cast("long")
    return records.select(
        as_id("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        checked.alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        as_id("WARC-Refers-To").alias("refers_to"),
    )


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    return describe_records(read_archive(spark, path))
