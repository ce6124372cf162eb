"""Content-addressed WARC archive.

Payload bytes are stored once under a verified SHA-256 digest, the exact record headers are
stored separately, and the original records come back by joining the two tables. Record
building, hashing and reading are DataFrame expressions; both tables are Parquet in a folder
that the caller names.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored

MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).select(
        "*", F.unhex(F.sha2("payload", 256)).alias("digest")
    )


def _header(kind: Column, refers: Column, date: str) -> Column:
    """The bytes before a record's payload, WARC/1.1; a revisit names the record it repeats."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "suffix"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">")),
        F.when(refers.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")


def write_archive(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write ``path/payloads`` (each content once) and ``path/headers`` (one row per page).

    Of pages with equal payloads of ``MIN_REVISIT_BYTES`` or more the largest page_id is the
    response and the others are revisits of it; smaller payloads are all responses. Null html is an
    empty payload, a null url an empty one. A null page_id ranks below all others: if a group has
    no other id, all its records are responses. Rows that repeat page_id and html are each
    archived; those with the largest page_id are all responses. A row whose page_id is null or repeated has a number of
    its own behind the id in WARC-Record-ID, so that record ids are unique. ``date`` (the time of writing if not given) is each record's
    WARC-Date; line breaks in urls are percent-encoded; an empty table gives an empty archive. Other columns are ignored. Two
    contents under one SHA-256 digest stop the job, as the archive could not tell them apart.
    """
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = _payloads(pages)
    (
        records.groupBy("digest", "payload")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("records"))
        .select(
            "digest", "payload", "response_id", "records",
            F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"),
        )
        .write.parquet(f"{path}/payloads")
    )
    index = spark.read.parquet(f"{path}/payloads").drop("payload")
    if index.groupBy("digest").count().filter("count > 1").count():
        raise RuntimeError("two different payloads share a SHA-256 digest")
    index = index.withColumnRenamed("digest", "stored_digest")
    first = F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when((F.col("bytes") < MIN_REVISIT_BYTES) | first, "response").otherwise("revisit")
    refers = F.when(kind == "revisit", F.col("response_id"))
    repeated = pages.filter("page_id is not null").groupBy(F.col("page_id").alias("repeated_id")).count().filter("count > 1").select("repeated_id")
    own = records.select("page_id", "url", "digest", F.monotonically_increasing_id().alias("number")).join(
        stored(repeated, "repeated-pages"), F.col("page_id") == F.col("repeated_id"), "left"
    )
    suffix = F.when(F.col("page_id").isNull() | F.col("repeated_id").isNotNull(), F.col("number").cast("string"))
    (
        own.select("page_id", "url", "digest", suffix.alias("suffix"))
        .join(index, F.col("digest") == F.col("stored_digest"))
        .select("page_id", "digest", _header(kind, refers, date).alias("header"))
        .write.parquet(f"{path}/headers")
    )


def _field(name: str, value: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?md)^{name}: {value}\r$", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The stored headers, parsed: page_id, digest, header, record_type, refers_to, declared_sha1, url."""
    def number(name: str) -> Column:
        return _field(name, "<urn:page:(-?[0-9]+)(?::[0-9]+)?>").try_cast("bigint")

    return spark.read.parquet(f"{path}/headers").select(
        number("WARC-Record-ID").alias("page_id"),
        "digest",
        "header",
        _field("WARC-Type", r"(\w+)").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest", r"sha1:(\w+)").alias("declared_sha1"),
        _field("WARC-Target-URI", r"(.*?)").alias("url"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every original record: its header bytes joined with its full payload.

    A payload that does not have the SHA-1 its header declares fails the read. Revisits get the payload that they repeat, so ``payload`` is the page's html in each row and
    ``record`` is the record as it stands in a WARC file (a revisit has no body there).
    """
    bodies = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("stored_digest"), "payload")
    joined = read_headers(spark, path).join(bodies, F.col("digest") == F.col("stored_digest"))
    checked = F.when(F.sha1("payload") == F.col("declared_sha1"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its declared digest: "), "declared_sha1")).cast("binary")
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("payload", checked).select(
        "page_id", "url", "record_type", "refers_to", "declared_sha1", "payload",
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )
