"""Helpers shared by the operators: native text expressions, and the session's durable tables by a shorter name."""

from __future__ import annotations

from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import new_path, scratch, shared_dir, shuffles_cleaned, stored

__all__ = ["ascii_lower", "file_at", "new_path", "running_totals", "scratch", "shared_dir", "shuffles_cleaned", "small_batches", "small_or_shuffled", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: A side of a join with at most so many short rows (keys and digests, some 50 bytes each) is broadcast.
BROADCAST_ROWS = 500_000


#: Rows of whole texts, and about as many bytes of them, that go to a Python worker at once. A longer text goes alone.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH_ROWS and BATCH_BYTES, so that a batch of long texts fits into a worker."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))


def small_or_shuffled(rows: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most BROADCAST_ROWS; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def file_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path that Spark's URI of a file names."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def running_totals(values: Column, block: int = 256) -> Column:
    """Inclusive running totals of an array of longs, with no Python.

    The array is cut into blocks so that growing the result copies ``block`` elements at a
    time: n * block / 2 steps rather than n * n / 2 for the arrays of very long texts.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    n_blocks = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * block + 1, F.lit(block))
    )
    within = F.transform(
        blocks,
        lambda blk: F.aggregate(
            blk,
            F.struct(zero.alias("sum"), none.alias("seen")),
            lambda acc, v: F.struct(
                (acc["sum"] + v).alias("sum"),
                F.concat(acc["seen"], F.array(acc["sum"] + v)).alias("seen"),
            ),
        ),
    )
    joined = F.aggregate(
        within,
        F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("seen")),
        lambda acc, w: F.struct(
            (acc["sum"] + w["sum"]).alias("sum"),
            F.concat(
                acc["seen"], F.array(F.transform(w["seen"], lambda x: x + acc["sum"]))
            ).alias("seen"),
        ),
        lambda acc: F.flatten(acc["seen"]),
    )
    return F.when(F.size(values) == 0, none).otherwise(joined)
