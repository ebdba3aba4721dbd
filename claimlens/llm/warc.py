"""Content-addressed WARC archive: payload bytes once per digest, exact record headers beside them.

``write_archive`` stores two tables: ``payloads`` (SHA-256, bytes), one row per different payload, and ``headers``, one
row per record with the record's header bytes as they stand in a WARC file. ``records`` joins them back into the
original records, ``read_back`` parses headers and checks every stored payload against its digests.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.cluster import shared_path

DATE = "2024-01-01T00:00:00Z"
_EOL = "\r\n"


class Archive(NamedTuple):
    payloads: str
    headers: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(kind: Column, page: Column, url: Column, digest: Column, n: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A")
    revisit = kind == "revisit"
    return F.encode(F.concat(
        F.lit(f"WARC/1.1{_EOL}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(page)), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(refers)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(n).cast("string")), F.lit(_EOL)), "UTF-8")


def write_archive(pages: DataFrame, min_bytes: int = 0, root: str | None = None) -> Archive:
    """Writes ``payloads`` and ``headers`` for a table of (page_id, url, html) and returns their paths.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is the response, the
    others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url an empty target, a
    null page_id counts as smaller than any other. Repeated rows of the winning page_id are all responses. Line ends in
    urls are escaped. Other columns are ignored; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    archive = Archive(shared_path(spark, "warc-payloads"), shared_path(spark, "warc-headers")) if root is None else Archive(f"{root}/payloads", f"{root}/headers")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    # equal payloads are reduced before the shuffle, so a payload of a third of all pages moves once per task
    base.groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(archive.payloads)
    slim = base.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    latest = slim.groupBy("sha256").agg(F.max("page_id").alias("latest"))
    kind = F.when((F.col("n") >= min_bytes) & F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest")), "revisit").otherwise("response")
    headers = slim.join(latest, "sha256").withColumn("kind", kind)
    headers.select("page_id", "url", "sha256", _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"), F.col("latest")).alias("header")).write.parquet(archive.headers)
    return archive


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: (page_id, record), header bytes, payload of responses, two line ends."""
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    end = F.encode(F.lit(_EOL * 2), "UTF-8")
    body = F.when(_field(F.decode("header", "UTF-8"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "sha256").select("page_id", F.concat("header", body, end).alias("record"))


def read_back(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, and length and digest of its full payload, taken from the stored bytes.

    Fails if stored bytes do not have the SHA-256 they are stored by, or a header names another SHA-1.
    """
    stored = spark.read.parquet(archive.payloads).select("sha256", (F.sha2("payload", 256) == F.col("sha256")).alias("sound"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(_field(text, "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    parsed = spark.read.parquet(archive.headers).select(
        "page_id", "url", "sha256", _field(text, "WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"), _field(text, "WARC-Payload-Digest").alias("said"))
    sound = F.col("sound") & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    both = parsed.join(stored, "sha256").withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("string")))
    return both.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
