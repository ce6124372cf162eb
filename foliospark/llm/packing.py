"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (the binary digits of its
length, the longest piece ``max_tokens``), and pieces of equal length form a bucket. A piece is a
whole sequence, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliospark.llm.common import small_batches
from foliospark.llm.tokens import WORD_BPE, encode_all, forget_words

MAX_TOKENS = 2048
END_ID = 1
#: A task writes out a bucket's pieces when they hold so many bytes.
FLUSH_BYTES = 1 << 20

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, bucket bigint"
)
_ARROW = pa.schema(
    [(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket")]
)


def binary_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Piece lengths of n tokens, longest first: copies of ``most``, then the binary digits."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit), its sequence and its bucket (the length).

    ``max_tokens`` is a power of two. Null text is empty: such a document is its end id only.
    Strings that look like special tokens get the special tokens' ids, as in the tokenizer's own encode.
    Rows are packed one by one, so repeated rows and null doc_ids each get pieces of their own;
    an empty table gives none. Other columns are ignored. Pieces of equal length form a bucket: a task writes them
    together, and ``write_buckets`` makes a folder of each. ``sequence_id`` is the task's number and a counter: unique, with
    gaps between tasks. No shuffle takes place, so a bucket that holds most pieces needs no care.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        buckets: dict[int, list[tuple]] = {}

        def written(n: int) -> pa.RecordBatch:
            return pa.record_batch(list(map(list, zip(*buckets.pop(n), strict=True))), schema=_ARROW)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encode_all(batch.column("text").to_pylist(), tokenizer), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                for n in binary_lengths(total, max_tokens):
                    rows = buckets.setdefault(n, [])
                    rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], total, sequence, 0, n))
                    sequence += 1
                    start += n
                    if len(rows) * (4 * n + 64) >= FLUSH_BYTES:
                        yield written(n)
        forget_words()
        for n in list(buckets):
            yield written(n)

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces to one folder per length, so that a training job can read batches of equal rows."""
    pieces.write.partitionBy("bucket").parquet(path)
