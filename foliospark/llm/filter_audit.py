"""Filter interaction audit: what five quality filters remove, alone and in every order.

A relational word pipeline: words are exploded, counted by (document, word) and then by document, the flags that need no words are
joined, and 32 conditional counts a part (one for each set of failed filters) give every order's figures by addition.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, small_or_shuffled, stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = r"[#$%&*|]"

_COUNTS = ("docs", "good", "toxic")


def word_counts(keyed: DataFrame) -> DataFrame:
    """row_id, words and distinct (words) of each row that has a word.

    Whole texts are dealt by row_id once, so the words need no further shuffle: counts by (row_id, word) and by row_id keep that dealing.
    """
    words = keyed.select("row_id", "text").repartition("row_id").select("row_id", F.explode(F.split("text", WHITE)).alias("word"))
    by_word = words.filter("word <> ''").groupBy("row_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("row_id").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, failed (bit k for filter k), good, toxic.

    A: under 100 words; B: under 80 % of them distinct; C: over 10 % capitals; D: holds a symbol; E: a smaller doc_id has the same text.
    Null text is empty (it fails A, never B or C), null lang is the part ''. A null doc_id has no labels, is smaller than none and has none smaller.
    Rows are told apart by their place, so repeated rows each count, and rows of one doc_id do not fail E by one another. Of several
    labels of a document one that says 1 suffices. Further columns are ignored, empty tables give no rows. ``docs`` is read twice, so it must be
    a table whose reads give the same rows in the same order, as files do.
    """
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    capitals = F.char_length(F.col("text")) - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    own = keyed.select(
        "row_id", "doc_id", "part",
        (100 * capitals > MAX_CAPITAL_PERCENT * F.char_length("text")).alias("c"),
        F.col("text").rlike(SYMBOLS).alias("d"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    words, distinct = (F.coalesce(n, F.lit(0)) for n in ("words", "distinct"))
    a, b = words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words
    with scratch(docs.sparkSession) as tables:
        narrow = stored(
            own.join(word_counts(keyed), "row_id", "left").select("doc_id", "part", "digest", _bits(a, b, F.col("c"), F.col("d")).alias("failed")),
            "audit-rows",
        )
        shared = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
        shared = small_or_shuffled(stored(shared.drop("last_id"), "audit-copies"))
        marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        marks = small_or_shuffled(stored(marks, "audit-labels"))
        copied = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
        return tables.keep(
            narrow.join(shared, "digest", "left")
            .join(marks, "doc_id", "left")
            .select(
                "doc_id", "part", (F.col("failed") + copied).alias("failed"),
                F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
            )
        )


def _bits(*flags: Column) -> Column:
    return sum((F.when(flag, 1 << k).otherwise(0) for k, flag in enumerate(flags)), F.lit(0))


def subset_counts(failed: DataFrame) -> DataFrame:
    """One row per part: docs, good and toxic, arrays of 32 counts by the exact set of failed filters."""
    conditions = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = [F.count_if((F.col("failed") == s) & conditions[c]).alias(f"{c}_{s}") for c in _COUNTS for s in range(SUBSETS)]
    wide = failed.groupBy("part").agg(*counted)
    return wide.select("part", *(F.array(*(f"{c}_{s}" for s in range(SUBSETS))).alias(c) for c in _COUNTS))


def _steps() -> list[dict]:
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, own in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[f] for f in order), "step": k + 1, "own": 1 << own, "before": before})
            before |= 1 << own
    return steps


def _added(counts: str, condition: str, weight: str = "1") -> Column:
    """The counts of the subsets ``s`` for which the condition holds, added up."""
    return F.expr(f"aggregate(sequence(0, {SUBSETS - 1}), 0L, (n, s) -> n + if({condition}, {counts}[s] * {weight}, 0L))")


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, each of the 120 orders and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document that fails m filters is removed by each of them in 120 / m orders, so shapley needs no sum over orders.
    """
    every = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = counts.select("*", F.explode(every).alias("at")).select("*", "at.*")
    fails, first = "(s & own) <> 0", "(s & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        _added("docs", "(s & (before | own)) = 0").alias("kept"),
        _added("docs", f"{fails} and {first}").alias("removed"),
        _added("docs", f"{fails} and not {first}").alias("redundant"),
        F.expr("docs[own]").alias("unique_fails"),
        _added("good", f"{fails} and {first}").alias("good_lost"),
        _added("toxic", f"{fails} and {first}").alias("toxic_lost"),
        _added("docs", fails, "(120 div bit_count(s))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes in each order and part; ``failures`` defines nulls, ties, repeats and empty tables."""
    return interactions(subset_counts(failures(docs, labels)))
