"""Reports: reviews as JSON and Markdown, the activity of a day, lists of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import rfc3339


def review_name(saved_at: Column) -> Column:
    """The name of a review by the second (since 1970) in which it was saved."""
    return F.concat(F.lit("validation-"), F.coalesce(saved_at, F.lit(0)).cast("bigint").cast("string"))


def review_reports(reviews: DataFrame) -> DataFrame:
    """name, json, markdown of reviews: document_id, timestamp (milliseconds), actions (array), status, notes, saved_at (seconds).

    Null texts are empty, null actions none, null times 0. Times are shown in UTC. Two reviews of one second have one name, as their documents do not
    count for it. One row a review; a sink may split them as it likes.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    acts = F.coalesce(F.col("actions"), F.array().cast("array<string>"))
    bullets = F.when(F.size(acts) == 0, "- (none)\n").otherwise(F.array_join(F.transform(acts, lambda a: F.concat(F.lit("- "), F.coalesce(a, F.lit("")), F.lit("\n"))), ""))
    noted = F.when(empty("notes") == "", "(no notes)\n").otherwise(F.concat(empty("notes"), F.lit("\n")))
    name, ms = review_name(F.col("saved_at")), F.coalesce(F.col("timestamp"), F.lit(0)).cast("bigint")
    # The headings of the report; two spaces at a line's end break it.
    markdown = F.concat(
        F.lit("# Validation Session: "), name, F.lit("\n\n**Document ID:** "), empty("document_id"), F.lit("  \n**Timestamp:** "), rfc3339(F.floor(ms / 1000) * 1000),
        F.lit("  \n**Status:** "), empty("status"), F.lit("\n\n## Actions Performed\n\n"), bullets, F.lit("\n## Review Notes\n\n"), noted,
    )
    review = F.struct(empty("status").alias("status"), empty("notes").alias("notes"))
    json = F.to_json(F.struct(empty("document_id").alias("documentId"), acts.alias("actions"), review.alias("review"), ms.alias("timestamp")))
    return reviews.select(name.alias("name"), json.alias("json"), markdown.alias("markdown"))


def day_listing(entries: DataFrame, hours: int) -> DataFrame:
    """day, line of entries (day, name, is_dir, modified) in the order of days and lines: local time, a mark and the name.

    ``hours`` is added to UTC. A null time is shown as ``??:??``, a null kind is a file. Sorted by ranges, so a day of any size is split.
    """
    at = F.coalesce(F.date_format(F.col("modified") + F.make_dt_interval(hours=F.lit(hours)), "HH:mm"), F.lit("??:??"))
    mark = F.when(F.coalesce(F.col("is_dir"), F.lit(False)), "\U0001f4c1").otherwise("\U0001f4c4")
    line = F.concat(at, F.lit("  "), mark, F.lit(" "), F.coalesce(F.col("name"), F.lit("")))
    return entries.select("day", line.alias("line")).orderBy("day", "line")


def both_lists(a: DataFrame, b: DataFrame, place: str = "place") -> DataFrame:
    """The rows of ``a`` and then those of ``b``, with side (0 and 1); within a side ``place`` keeps its order. Repeats stay."""
    sided = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return sided.orderBy("side", place)
