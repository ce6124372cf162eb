"""Sheets of drawn layers over source pages, and the comparison of documents by structure and by pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry, ink


def sheets(pages: DataFrame) -> DataFrame:
    """Every page of ``pages`` with its sheet: all columns, then canvas, place (``geometry.placement``), layer and source matrices.

    Pages have box (of their strokes, null without any), width, height and degrees of the source page. One projection, no shuffle.
    A null size gives a null place.
    """
    size = ink.displayed_size(F.col("width").cast("double"), F.col("height").cast("double"), F.pmod(F.col("degrees"), F.lit(360)))
    known = pages.withColumn("canvas", geometry.canvas(F.col("box"))).withColumn("_size", size)
    whole = F.col("_size.width").isNotNull() & F.col("_size.height").isNotNull()
    placed = known.withColumn("place", F.when(whole, geometry.placement(F.col("canvas"), F.col("_size.width"), F.col("_size.height"))))
    return placed.withColumn("layer", geometry.layer_matrix(F.col("canvas"), F.col("place"))).withColumn(
        "source", geometry.source_matrix(F.col("place"), F.col("degrees"), F.col("width").cast("double"), F.col("height").cast("double"))
    ).drop("_size")


def on_sheets(strokes: DataFrame, sheet_rows: DataFrame, page: str = "page") -> DataFrame:
    """The strokes (``page``, points, dx and dy of their group) with points moved by their group and then onto their page's sheet.

    The two matrices are composed once a stroke. Strokes on a page without a sheet are left out; a page's strokes need not meet in one task.
    """
    other = sheet_rows.select(F.col(page).alias("_page"), F.col("layer").alias("_layer"))
    both = strokes.join(other, F.col(page) == F.col("_page"))
    whole = geometry.composed(F.col("_layer"), geometry.shifted(F.col("dx"), F.col("dy")))
    points = F.transform("points", lambda p: geometry.moved(F.col("_matrix"), p["x"], p["y"]))
    return both.withColumn("_matrix", whole).withColumn("points", points).drop("_page", "_layer", "_matrix")


def style_changes(strokes: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Adds set_width, set_alpha, set_cap and set_color: what a renderer has to set before a stroke, null where it stays.

    Strokes have width, opacity, cap and color and none is without points. A page starts with opacity 1 and cap 1; its first stroke
    always sets the colour and the width. Opacities are compared by their key of thousandths, widths to 1e-9.
    """
    before = Window.partitionBy(*page).orderBy(*order)
    last = lambda c: F.lag(c).over(before)
    key = ink.alpha_key(F.col("opacity"))
    old_key, first = F.coalesce(F.lag(key).over(before), F.lit(1000)), F.row_number().over(before) == 1
    return strokes.select(
        "*", F.when(first | (F.abs(F.col("width") - last("width")) > 1e-9), F.col("width")).alias("set_width"),
        F.when(key != old_key, key).alias("set_alpha"), F.when(F.col("cap") != F.coalesce(last("cap"), F.lit(1)), F.col("cap")).alias("set_cap"),
        F.when(first | ~F.col("color").eqNullSafe(last("color")), F.col("color")).alias("set_color"),
    )


def _words(c: Column) -> Column:
    """A text with runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def _sided(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Pages of two versions side by side: doc_id, page, in_a, in_b and ``columns`` of both as ``_a`` and ``_b``."""
    named = lambda df, s: df.select(F.col("doc_id").alias(f"doc_{s}"), F.col("page").alias(f"page_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    both = named(a, "a").join(named(b, "b"), (F.col("doc_a") == F.col("doc_b")) & (F.col("page_a") == F.col("page_b")), "full_outer")
    return both.select(
        F.coalesce("doc_a", "doc_b").alias("doc_id"), F.coalesce("page_a", "page_b").alias("page"), F.col("page_a").isNotNull().alias("in_a"),
        F.col("page_b").isNotNull().alias("in_b"), *[F.col(f"{c}_{s}") for c in columns for s in "ab"],
    )


def structural_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, page, in_a, in_b, reason of the pages of two versions (doc_id, page, annotations, degrees, text).

    The reason is the first that holds of: annotations, rotation, text (its words' SHA-256), else match; null where one version
    lacks the page. A null count or rotation is 0. Rotations are compared as they are: 0 and 360 differ.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sha = lambda c: F.sha2(_words(F.col(c)), 256)
    both = _sided(a, b, ["annotations", "degrees", "text"])
    reason = (
        F.when(~F.col("in_a") | ~F.col("in_b"), F.lit(None)).when(zero("annotations_a") != zero("annotations_b"), "annotation count mismatch")
        .when(zero("degrees_a") != zero("degrees_b"), "rotation mismatch").when(sha("text_a") != sha("text_b"), "extracted text mismatch").otherwise("match")
    )
    return both.select("doc_id", "page", "in_a", "in_b", reason.alias("reason"))


def structural_verdict(compared: DataFrame) -> DataFrame:
    """doc_id, pages_a, pages_b, compared, match: unequal page counts are no match and no page of them is compared.

    Takes the rows of ``structural_pages``; sums by document are combined before the shuffle.
    """
    n = lambda c: F.count_if(c)
    counted = compared.groupBy("doc_id").agg(n(F.col("in_a")).alias("pages_a"), n(F.col("in_b")).alias("pages_b"), n(F.col("reason") == "match").alias("_same"), F.count("*").alias("_all"))
    equal = F.col("pages_a") == F.col("pages_b")
    return counted.select(
        "doc_id", "pages_a", "pages_b", F.when(equal, F.col("pages_a")).otherwise(0).alias("compared"), (equal & (F.col("_same") == F.col("_all"))).alias("match")
    )


def compare_rasters(a: DataFrame, b: DataFrame, tolerance: float = 0.01, channels: int = 4) -> DataFrame:
    """doc_id, page, ratio, reason, match of two versions' page images (doc_id, page, width, height, data: rows of pixels from the top).

    Sizes may differ by one pixel in each direction, then the common upper left part is compared; else, and where one version lacks
    the page, the ratio of differing pixels is 1. A pixel differs if any of its channels does. Pixels are only looked at in rows whose bytes differ.
    """
    both = _sided(a, b, ["width", "height", "data"])
    w, h = F.least("width_a", "width_b"), F.least("height_a", "height_b")
    near = (F.abs(F.col("width_a") - F.col("width_b")) <= 1) & (F.abs(F.col("height_a") - F.col("height_b")) <= 1)

    def bytes_of(side: str, x: Column, y: Column, n: Column) -> Column:
        return F.substr(F.col(f"data_{side}"), ((y * F.col(f"width_{side}") + x) * channels + 1).cast("int"), (n * channels).cast("int"))

    def differing(y: Column) -> Column:
        pixels = F.filter(F.sequence(F.lit(0), F.col("_w") - 1), lambda x: bytes_of("a", x, y, F.lit(1)) != bytes_of("b", x, y, F.lit(1)))
        return F.when(bytes_of("a", F.lit(0), y, F.col("_w")) == bytes_of("b", F.lit(0), y, F.col("_w")), 0).otherwise(F.size(pixels))

    empty = (F.col("_w") < 1) | (F.col("_h") < 1)
    wrong = F.aggregate(F.sequence(F.lit(0), F.col("_h") - 1), F.lit(0).cast("bigint"), lambda n, y: n + differing(y))
    total = F.col("_w").cast("double") * F.col("_h")
    ratio = F.when(~F.coalesce(F.col("_near"), F.lit(False)), 1.0).when(empty, 0.0).otherwise(wrong / F.greatest(total, F.lit(1.0)))
    sized = both.withColumn("_w", w.cast("int")).withColumn("_h", h.cast("int")).withColumn("_near", near).withColumn("ratio", ratio)
    lost = ~F.col("in_a") | ~F.col("in_b")
    reason = (
        F.when(lost, "page missing").when(~F.coalesce(F.col("_near"), F.lit(False)), "rendered image size mismatch").when(empty, "empty image bounds")
        .when(F.col("ratio") <= tolerance, "within tolerance").otherwise("diff exceeds tolerance")
    )
    fits = F.coalesce(F.col("_near"), F.lit(False)) & (F.col("ratio") <= tolerance)
    return sized.select("doc_id", "page", "ratio", reason.alias("reason"), fits.alias("match"))
