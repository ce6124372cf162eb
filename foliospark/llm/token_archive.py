"""Token ids in range-coded files.

A file is a sequence of blocks. Each has a header, a directory of its documents (ids and lengths) and the documents' token ids, coded by
``range_coder`` from an empty model; a newline ends it. Checksums cover the stored bytes and the decoded ids. Files and blocks are in
ascending order of doc_id, so positions in the whole archive follow from the headers alone. Blocks are written, found and read by many tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import range_coder
from foliospark.llm.common import file_at, small_batches, stored
from foliospark.llm.tokens import BYTE_BPE, encode_bytes

VOCABULARY = 50257
END_ID = 0
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 20
BLOCKS_A_TASK = 16
#: So many files form a group of the prefix sum over files.
FILES_A_GROUP = 1024

MAGIC = b"TRC1"
#: magic, vocabulary, documents, ids, bytes of the directory, bytes of the coded ids, crc32 of both, crc32 of the ids (16-bit)
_HEADER = struct.Struct("<4sIQQQQII")
HEADER_BYTES = _HEADER.size


def block_header(block: bytes) -> tuple[int, int, int]:
    """Documents, ids and size of the block that begins with these bytes."""
    magic, _, docs, n, directory, coded, _, _ = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("damaged file: no block begins here")
    return docs, n, HEADER_BYTES + directory + coded

DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def block_bytes(doc_ids: list[int | None], ids: list[bytes], vocabulary: int = VOCABULARY) -> bytes:
    """One block, without its newline: documents with their ids as little-endian 16-bit integers."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(i) // 2 for i in ids], "<u8")
    directory = zlib.compress(known.tobytes() + numbers.tobytes() + lengths.tobytes(), 1)
    raw = b"".join(ids)
    coded = range_coder.encode(np.frombuffer(raw, "<u2"), vocabulary)
    check = zlib.crc32(coded, zlib.crc32(directory))
    return _HEADER.pack(MAGIC, vocabulary, len(ids), len(raw) // 2, len(directory), len(coded), check, zlib.crc32(raw)) + directory + coded


def block_documents(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a block; a damaged one is an error."""
    magic, vocabulary, docs, n, directory, coded, check, ids_check = _HEADER.unpack_from(block)
    body = block[HEADER_BYTES : HEADER_BYTES + directory + coded]
    if magic != MAGIC or len(body) != directory + coded or zlib.crc32(body) != check:
        raise ValueError("damaged block: its bytes do not have their checksum")
    listed = zlib.decompress(body[:directory])
    known = np.frombuffer(listed, np.uint8, docs)
    numbers = np.frombuffer(listed, "<i8", docs, docs)
    lengths = np.frombuffer(listed, "<u8", docs, 9 * docs).astype(np.int64)
    ids = range_coder.decode(body[directory:], n, vocabulary)
    if zlib.crc32(ids.astype("<u2").tobytes()) != ids_check:
        raise ValueError("damaged block: its ids do not have their checksum")
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], lengths, ids


def write_archive(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, vocabulary: int = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every whole text, ``end_id`` after each, to files below ``path`` in ascending doc_id order.

    Null texts are empty: their end id only. Strings that look like special tokens get the special tokens' ids, as in the library's default.
    Null doc_ids come first; rows of one doc_id keep the table's order, and any number of them is dealt to several files. An empty
    table gives an archive without blocks; further columns are ignored. A task holds one block: at most ``block_ids`` ids and one document.
    """
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def written() -> pa.RecordBatch:
            block = block_bytes(names, ids, vocabulary)
            names.clear()
            ids.clear()
            return pa.record_batch([pa.array([block], pa.binary())], ["block"])

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode_bytes(batch.column("text"), tokenizer), strict=True):
                names.append(doc_id)
                ids.append(own + end)
                held += len(own) // 2 + 1
                if held >= block_ids:
                    yield written()
                    held = 0
        if names:
            yield written()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    # the text writer adds no more than the newline, in any store that Spark can write to
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per block, from the headers: path, block, offset, size, docs, ids, and start (the ids of all blocks before it)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").filter("length > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block", "offset", "size", "docs", "ids"]
        for batch in batches:
            for file, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, name = file_at(file)
                found, offset = [], 0
                with store.open_input_file(name) as f:
                    while offset < length:
                        docs, n, size = block_header(f.read_at(HEADER_BYTES, offset))
                        if offset + size >= length:
                            raise ValueError(f"damaged file: its last block is not whole: {file}")
                        found.append((file, len(found), offset, size, docs, n))
                        offset += size + 1
                yield pa.record_batch(list(map(pa.array, zip(*found, strict=True))), names)

    found = files.mapInArrow(run, "path string, block bigint, offset bigint, size bigint, docs bigint, ids bigint")
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("bigint")
    headers = stored(found.withColumn("file", number), "archive-blocks")
    before = (Window.unboundedPreceding, -1)
    # running totals in three steps, so that no task sees more than the blocks of a file, the files of a group or the groups
    groups = F.floor(F.col("file") / FILES_A_GROUP).alias("group")
    by_file = headers.groupBy(groups, "file").agg(F.sum("ids").alias("n"))
    by_file = by_file.withColumn("in_group", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("file").rowsBetween(*before)), F.lit(0)))
    by_group = headers.groupBy(groups).agg(F.sum("ids").alias("n"))
    by_group = by_group.select("group", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(*before)), F.lit(0)).alias("base"))
    starts = by_file.join(by_group, "group").select("file", (F.col("in_group") + F.col("base")).alias("base"))
    in_file = F.coalesce(F.sum("ids").over(Window.partitionBy("file").orderBy("block").rowsBetween(*before)), F.lit(0))
    return headers.withColumn("in_file", in_file).join(starts, "file").select(
        "path", "block", "offset", "size", "docs", "ids", (F.col("base") + F.col("in_file")).alias("start")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of an archive: doc_id, start (the ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    A task reads the byte ranges of its blocks with Arrow's file systems and holds one block. Damaged blocks fail the read.
    """
    placed = stored(blocks(spark, path), "archive-index")
    total = placed.count()
    tasks = max(1, min(total, max(spark.sparkContext.defaultParallelism, total // BLOCKS_A_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size", "start")), strict=True):
                store, name = file_at(file)
                with store.open_input_file(name) as f:
                    names, lengths, ids = block_documents(f.read_at(size, offset))
                ends = np.cumsum(lengths)
                bounds = np.concatenate([[0], ends]) * 4
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), binary.cast(pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    dealt = placed.select("path", "block", "offset", "size", "start").repartition(tasks, "path", "block")
    return dealt.mapInArrow(run, DOCUMENTS)
