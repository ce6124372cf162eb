"""Where drawn layers and source pages meet on one sheet: canvases, placements and 2x3 matrices, as Catalyst expressions.

A matrix is a struct<a,b,c,d,e,f> that takes (x, y) to (a*x + c*y + e, b*x + d*y + f). Sheets have y from below, screens from above.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.ink import SCALE

# The screen's size, and what is left of the scale on a sheet without a source page.
SCREEN_WIDTH, SCREEN_HEIGHT = 1404.0, 1872.0
BARE_SCALE = SCALE * 72 / 96


def canvas(box: Column) -> Column:
    """The box around the whole screen and the strokes' ``box`` (struct<min_x,min_y,max_x,max_y>, null without strokes)."""
    half = SCREEN_WIDTH / 2
    # least and greatest skip nulls
    return F.struct(
        F.least(box["min_x"], F.lit(-half)).alias("min_x"), F.least(box["min_y"], F.lit(0.0)).alias("min_y"),
        F.greatest(box["max_x"], F.lit(half)).alias("max_x"), F.greatest(box["max_y"], F.lit(SCREEN_HEIGHT)).alias("max_y"),
    )


def _side(low: Column, high: Column, scale: float) -> Column:
    return (high - low + 1) * scale


def bare_sheet(box: Column, widest: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y, width, height> of a sheet with strokes alone.

    The canvas grows by half the widest stroke (1 at least) on all sides; then the side of the screen on which the strokes leave
    less room is moved out, so that both margins are equal. Without strokes nothing is moved.
    """
    whole, pad = canvas(box), F.greatest(F.coalesce(widest, F.lit(0.0)) / 2, F.lit(1.0))
    left = F.greatest(box["min_x"] + SCREEN_WIDTH / 2, F.lit(0.0))
    right = F.greatest(F.lit(SCREEN_WIDTH / 2) - box["max_x"], F.lit(0.0))
    more = F.coalesce(left - right, F.lit(0.0))
    low, high = whole["min_x"] - pad - F.greatest(-more, F.lit(0.0)), whole["max_x"] + pad + F.greatest(more, F.lit(0.0))
    bottom, top = whole["min_y"] - pad, whole["max_y"] + pad
    return F.struct(
        low.alias("min_x"), bottom.alias("min_y"), high.alias("max_x"), top.alias("max_y"),
        _side(low, high, BARE_SCALE).alias("width"), _side(bottom, top, BARE_SCALE).alias("height"),
    )


def placement(whole: Column, width: Column, height: Column) -> Column:
    """Where the canvas ``whole`` and a displayed source page of ``width`` x ``height`` lie on their common sheet.

    struct<width, height, layer_x, layer_y, layer_height, source_x, source_y, highlight_x>: the sheet is as wide and high as the
    larger of both. In each direction the smaller one is shifted by the canvas's corner against the larger one, sideways from the
    middle; equal ones are not shifted. highlight_x is the middle of the source page.
    """
    w, h = _side(whole["min_x"], whole["max_x"], SCALE), _side(whole["min_y"], whole["max_y"], SCALE)
    dx, dy = whole["min_x"] * SCALE, whole["min_y"] * SCALE
    source_x = F.when(w > width, -dx - width / 2).otherwise(0.0)
    layer_top, source_top = F.when(h < height, dy).otherwise(0.0), F.when(h > height, -dy).otherwise(0.0)
    sheet = F.greatest(h, height)
    return F.struct(
        F.greatest(w, width).alias("width"), sheet.alias("height"), F.when(w < width, width / 2 + dx).otherwise(0.0).alias("layer_x"),
        (sheet - layer_top - h).alias("layer_y"), h.alias("layer_height"), source_x.alias("source_x"),
        (sheet - source_top - height).alias("source_y"), (source_x + width / 2).alias("highlight_x"),
    )


def matrix(a, b, c, d, e, f) -> Column:
    part = lambda v, name: (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(name)
    return F.struct(*[part(v, n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)])


def turned(degrees: Column, width: Column, height: Column) -> Column:
    """The matrix that shows a page of ``width`` x ``height`` (before turning) upright, with its lower left corner at 0, 0.

    ``degrees`` is the page's own rotation, which is turned back; anything but a multiple of 90 turns nothing.
    """
    back = F.pmod(-degrees, F.lit(360))
    sin = F.when(back == 90, 1.0).when(back == 270, -1.0).otherwise(0.0)
    cos = F.when(back.isin(90, 270), 0.0).when(back == 180, -1.0).otherwise(1.0)
    lowest = lambda p, q: -F.least(F.lit(0.0), p, q, p + q)
    return matrix(cos, sin, -sin, cos, lowest(cos * width, -sin * height), lowest(sin * width, cos * height))


def composed(outer: Column, inner: Column) -> Column:
    """The matrix that applies ``inner`` and then ``outer``."""
    corner = moved(outer, inner["e"], inner["f"])
    row = lambda p, q, i, j: outer[p] * inner[i] + outer[q] * inner[j]
    return matrix(row("a", "c", "a", "b"), row("b", "d", "a", "b"), row("a", "c", "c", "d"), row("b", "d", "c", "d"), corner["x"], corner["y"])


def moved(m: Column, x: Column, y: Column) -> Column:
    """struct<x, y> of a point under a matrix."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def shifted(dx: Column, dy: Column) -> Column:
    return matrix(1, 0, 0, 1, dx, dy)


def layer_matrix(whole: Column, place: Column) -> Column:
    """From screen points to the sheet of ``placement``."""
    return matrix(SCALE, 0, 0, -SCALE, place["layer_x"] - whole["min_x"] * SCALE, place["layer_y"] + place["layer_height"] + whole["min_y"] * SCALE)


def source_matrix(place: Column, degrees: Column, width: Column, height: Column) -> Column:
    """From points of the source page (``width`` x ``height`` before turning) to the sheet."""
    return composed(shifted(place["source_x"], place["source_y"]), turned(degrees, width, height))
