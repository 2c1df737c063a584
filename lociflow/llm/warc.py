"""A content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest.  Each record's exact header block is stored apart, with the
digest of its payload.  Reading verifies every stored payload against its digest and joins it to the headers,
which gives back the original records.  ``export`` writes the records as standard WARC files.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_dir, tidy

CRLF = "\r\n"
#: Fixed value: the profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, path: str, least_bytes: int = 100, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (record_id, digest, header).

    Of records with equal payloads of at least ``least_bytes``, the one with the least key is the response and the
    others revisit it; smaller payloads are all responses.  A null payload counts as empty, a null URL as ``about:blank``.
    A null key sorts after all others; rows that repeat the least key are all responses.  A record's id follows from its
    key, URL and payload, so only rows that repeat in full share one.  ``date`` is every record's WARC-Date, now if left out.
    An empty table gives an empty archive, and other columns are ignored.
    """
    rows = pick(pages, key, url, payload).toDF("record_id", "url", "text").withColumn("payload", F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.select("record_id", F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]", "%0A").alias("url"), "payload", F.sha2("payload", 256).alias("digest"))
    with tidy(pages.sparkSession):
        # copies meet before the shuffle, in the partial aggregate
        rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
        facts = rows.select("record_id", "url", "digest", F.octet_length("payload").alias("length"))
        least = F.min(F.when(F.col("record_id").isNotNull(), F.struct("record_id", "url")))
        firsts = facts.where(f"length >= {int(least_bytes)}").groupBy("digest").agg(least.alias("first"))
        typed = facts.join(firsts, "digest", "left").withColumn("revisit", F.expr("first is not null and not (record_id <=> first.record_id)"))
        typed.select("record_id", "digest", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _header(date: str | None):
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def uri(key: str, url: str):
        h = F.md5(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(url), F.col("digest")).cast("binary"))
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))

    revisit = F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", uri("first.record_id", "first.url")), line("Refers-To-Key", text("first.record_id")))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("record_id", "url")),
        line("WARC-Date", F.lit(date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("Record-Key", text("record_id")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.when(F.col("revisit"), revisit).otherwise(F.lit("")),
        F.lit(CRLF),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, header, payload_digest, payload: the original records, each stored payload verified once.

    An archive of no pages gives no rows.  Record ids may be null or repeat; every header has its record.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    verified = stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from digest "), "digest"))))
    return spark.read.parquet(f"{path}/headers").join(verified, "digest").select("record_id", "header", F.col("digest").alias("payload_digest"), "payload")


def header_field(name: str, column: str = "header"):
    """A field of the header block, or null."""
    found = F.regexp_extract(F.col(column), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def catalog(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to (key as text), payload_bytes, payload_digest, from the records of read_archive().

    One row per record; a null record_id stays null, refers_to is null for responses, and no records give no rows.
    """
    digest, payload = F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha256:", ""), F.sha2("payload", 256)
    return records.select(
        "record_id",
        header_field("WARC-Type").alias("record_type"),
        header_field("Refers-To-Key").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(payload == digest, payload).otherwise(F.raise_error(F.concat(F.lit("record differs from its header: "), "header"))).alias("payload_digest"),
    )


def export(spark: SparkSession, path: str, to: str, records_per_file: int = 20_000, compression: str = "none") -> None:
    """Standard WARC files: header, payload (none for a revisit), and the blank lines that end a record.

    A compression is that of a whole file, not of each record.  Payloads are written whole, however long; an archive of no pages leaves no records.
    """
    block = F.when(header_field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    (read_archive(spark, path).select(F.concat("header", block).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(to))


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
