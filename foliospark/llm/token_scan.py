"""Token counts from flat token files by a separator scan.

A token file is nothing but little-endian ids, documents ended by an end-of-document id; there is
no index. Files are cut into blocks, numpy finds the separators of a block at once, and a prefix
scan over block summaries stitches documents that span blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import file_at, small_batches, stored
from foliospark.llm.tokens import WORD_BPE, encode_all, forget_words

#: The vocabulary's <|endoftext|>. Ids fit into 16 bits.
END_OF_DOCUMENT = 49407
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
BLOCKS_A_TASK = 64


def write_token_files(docs: DataFrame, path: str, tokenizer: str = WORD_BPE) -> None:
    """Write the ids of every whole text to flat files, one end-of-document id after each text.

    Null texts are empty documents, strings that look like special tokens are ordinary text (so that no text can hold a
    separator), an empty table gives no documents, and columns other than text are ignored.
    The text writer's line separator is the end-of-document id, so that any store Spark can
    write to may hold the files.
    """
    separator = np.array([END_OF_DOCUMENT], DTYPE).tobytes().decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encode_all(batch.column(0).to_pylist(), tokenizer, DTYPE, plain=True))
            yield pa.record_batch([pa.array(ids, pa.binary())], ["ids"])
        forget_words()

    small_batches(docs.sparkSession)
    (
        docs.select("text")
        .mapInArrow(run, "ids binary")
        .select(F.col("ids").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", separator)
        .text(path)
    )


def _blocks(spark: SparkSession, path: str, width: int, size: int) -> DataFrame:
    """path, block, length (of the file) of all blocks, dealt to tasks regardless of the file they are from."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").filter("length > 0")
    whole = F.when(F.col("length") % width == 0, F.ceil(F.col("length") / size)).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of tokens: "), "path")).cast("bigint")
    )
    total = files.select(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, min(total, max(spark.sparkContext.defaultParallelism, total // BLOCKS_A_TASK)))
    return files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("block")).repartition(tasks, "path", "block")


def scan_token_files(
    spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per document of the files below ``path``: file, doc_index, start_token, n_tokens, terminated.

    ``n_tokens`` leaves the separator out; an empty document counts 0. Tokens after a file's last
    separator are a document with terminated = false. Files that are empty have no documents. A file
    that is no whole number of tokens fails the scan. A task reads the byte ranges of its blocks only, so the blocks of a
    file of any size are scanned side by side and no more than a block is in memory. Files are read with Arrow's file systems
    (a shared folder, hdfs, s3).
    """
    width = np.dtype(dtype).itemsize
    size = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, length in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "length")), strict=True):
                store, name = file_at(file)
                with store.open_input_file(name) as f:
                    raw = f.read_at(min(size, length - block * size), block * size)
                cuts = np.flatnonzero(np.frombuffer(raw, dtype) == end_id).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(raw) // width], pa.int64()), pa.array([cuts], pa.list_(pa.int64()))],
                    ["path", "block", "tokens", "cuts"],
                )

    found = _blocks(spark, path, width, size).mapInArrow(run, "path string, block bigint, tokens bigint, cuts array<bigint>")
    summary = stored(found, "token-blocks")
    base = F.col("block") * block_tokens
    # the prefix scan sees one short row a block, not the cuts
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.array_max("cuts") + base
    scanned = summary.select("path", "block", F.size("cuts").alias("n"), last.alias("last")).select(
        F.col("path").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open_start"),
    )
    ends = F.transform("cuts", lambda c: c + base)
    stitched = (
        summary.filter(F.size("cuts") > 0)
        .join(scanned, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
        .select("path", ends.alias("ends"), "docs_before", "open_start")
    )
    starts = F.concat(
        F.array("open_start"), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1)
    )
    done = stitched.select("path", "docs_before", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e")))).select(
        "path",
        (F.col("docs_before") + F.col("pos")).alias("doc_index"),
        F.col("col.s").alias("start_token"),
        (F.col("col.e") - F.col("col.s")).alias("n_tokens"),
        F.lit(True).alias("terminated"),
    )
    tails = (
        summary.groupBy("path")
        .agg(
            F.sum("tokens").alias("total"),
            F.sum(F.size("cuts")).alias("doc_index"),
            F.coalesce(F.max(last) + 1, F.lit(0)).alias("start_token"),
        )
        .filter("total > start_token")
        .select("path", "doc_index", "start_token", (F.col("total") - F.col("start_token")).alias("n_tokens"), F.lit(False).alias("terminated"))
    )
    return done.unionByName(tails).withColumnRenamed("path", "file")
