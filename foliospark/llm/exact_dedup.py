"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so (the first sentence or line end after
``MIN_CHUNK`` characters), every distinct chunk is moved once to verify that its SHA-256
identifier stands for one content only, and documents are then compared by their ordered
identifier lists: 32 bytes a chunk travel, never the documents themselves. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, scratch, shuffles_cleaned, small_or_shuffled, stored

MIN_CHUNK = 512
MAX_CHUNK = 4096


def normalised(text: Column) -> Column:
    """Text as it is compared: null is empty, A-Z in lower case."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text; joined they give the text, an empty text has none."""
    cut = rf"(?s).{{{least},{most - 2}}}?(?:[.!?]\s|\n)|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe (the ordered chunk identifiers, 32 bytes each)."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    ids = F.transform(chunks(F.col("norm")), lambda c: F.sha2(c, 256))
    return norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.unhex(F.array_join(ids, "")).alias("recipe"),
    )


def verify_chunks(docs: DataFrame) -> None:
    """Raise if one chunk identifier stands for two contents.

    Equal chunks are combined in the map tasks, so a chunk that many documents share is
    moved at most once per task.
    """
    distinct = (
        docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
        .groupBy("chunk")
        .agg(F.count("*").alias("n"))
    )
    clash = (
        distinct.groupBy(F.unhex(F.sha2("chunk", 256)).alias("id"))
        .agg(F.count("*").alias("contents"))
        .filter("contents > 1")
    )
    with shuffles_cleaned(docs.sparkSession):
        clashes = clash.count()
    if clashes:
        raise RuntimeError("two different chunks share a SHA-256 identifier")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. The largest doc_id of a group stays; null ids rank below all
    others, and a group of null ids only has a null keep_id and kept = true. Rows that repeat
    both doc_id and text cannot be told apart: each is reported, with the same values. An empty
    table gives an empty result. Columns other than doc_id and text are ignored.
    """
    with scratch(docs.sparkSession) as block:
        verify_chunks(docs)
        own = stored(recipes(docs), "recipes")
        shared = stored(
            own.groupBy("recipe")
            .agg(F.max("doc_id").alias("largest"), F.count("*").alias("members"))
            .filter("members > 1")
            .withColumnRenamed("recipe", "shared_recipe"),
            "shared-recipes",
        )
        alone = F.col("members").isNull()
        keep = F.when(alone, F.col("doc_id")).otherwise(F.col("largest"))
        return block.keep(own.join(shared, F.col("recipe") == F.col("shared_recipe"), "left")).select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("members", F.lit(1)).cast("bigint").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows equal in doc_id and text, one.

    Needs doc_id and text; any other columns, whatever their names, are carried along. Null texts count as
    empty, null doc_ids rank below all others; an empty table stays empty.
    """
    with scratch(docs.sparkSession) as block:
        groups = exact_groups(docs)
        gone = small_or_shuffled(stored(groups.filter(~F.col("kept")).select("doc_id", F.unhex("text_sha256").alias("text_sha256")), "exact-gone"))
        repeated = stored(
            groups.filter(F.col("kept") & (F.col("group_size") > 1))
            .groupBy("doc_id", "text_sha256")
            .agg(F.count("*").alias("n"))
            .filter("n > 1")
            .select("doc_id", F.unhex("text_sha256").alias("text_sha256")),
            "repeated-rows",
        )
        rows = docs.select(
            F.struct("*").alias("row"),
            F.col("doc_id").alias("own_id"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("own_sha"),
        )

        def same(other: DataFrame) -> Column:
            return rows["own_id"].eqNullSafe(other["doc_id"]) & (rows["own_sha"] == other["text_sha256"])

        left = rows.join(gone, same(gone), "left_anti")
        if repeated.isEmpty():
            return block.keep(left).select("row.*")
        twice = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["own_id", "own_sha"])
        once = left.join(repeated, same(repeated), "left_anti")
        return block.keep(once.unionByName(twice)).select("row.*")
