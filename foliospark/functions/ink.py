"""Pen strokes: styles, colours, boxes and page geometry, as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Red, green, blue of the pen colours 0 to 27.
RGB = [
    (0.0, 0.0, 0.0), (144 / 255, 144 / 255, 144 / 255), (1.0, 1.0, 1.0), (251 / 255, 247 / 255, 25 / 255), (0.0, 1.0, 0.0),
    (1.0, 192 / 255, 203 / 255), (78 / 255, 105 / 255, 201 / 255), (179 / 255, 62 / 255, 57 / 255), (125 / 255, 125 / 255, 125 / 255),
    (247 / 255, 232 / 255, 81 / 255), (161 / 255, 216 / 255, 125 / 255), (139 / 255, 208 / 255, 229 / 255), (183 / 255, 130 / 255, 205 / 255),
    (247 / 255, 232 / 255, 81 / 255), (1.0, 0.929412, 0.458824), (0.745098, 0.917647, 0.996078), (0.949020, 0.619608, 1.0),
    (1.0, 0.764706, 0.549020), (0.674510, 1.0, 0.521569), (0.780392, 0.780392, 0.776471), (0.129412, 0.117647, 0.109804),
    (0.996078, 0.698039, 0.0), (0.752941, 0.498039, 0.823529), (0.188235, 0.290196, 0.878431), (0.760784, 0.192157, 0.196078),
    (0.568627, 0.854902, 0.443137), (0.980392, 0.905882, 0.098039), (0.454902, 0.823529, 0.909804),
]
# Alpha of the shader colours, of 255.
SHADER_ALPHA = {20: 64, 21: 115, 22: 128, 23: 77, 24: 102, 25: 128, 26: 115, 27: 102}
# Colours by the red, green, blue and alpha bytes of a marker.
MARKED = {
    (255, 237, 117, 255): 14, (190, 234, 254, 255): 15, (242, 158, 255, 255): 16, (255, 195, 140, 255): 17, (172, 255, 133, 255): 18,
    (199, 199, 198, 255): 19, (33, 30, 28, 64): 20, (254, 178, 0, 115): 21, (192, 127, 210, 128): 22, (48, 74, 224, 77): 23,
    (194, 49, 50, 102): 24, (145, 218, 113, 128): 25, (250, 231, 25, 115): 26, (116, 210, 232, 102): 27,
}
SCALE = 72 / 226


def stroke_style(tool: Column, thickness: Column, color: Column) -> Column:
    """struct<width, opacity, cap> of a pen."""
    alphas = F.create_map(*[F.lit(x) for c, a in SHADER_ALPHA.items() for x in (c, a / 255)])
    shade = F.coalesce(F.element_at(alphas, color.cast("int")), F.lit(1.0))
    highlighter, shader = tool.isin(5, 18), tool == 23
    width = (
        F.when(highlighter, 25.0).when(shader, 12.0).when(tool.isin(4, 17), thickness * 1.8)
        .when(tool.isin(7, 13), thickness * thickness).otherwise(thickness)
    )
    opacity = F.when(highlighter, 0.3).when(shader, shade).when(tool.isin(7, 13), 0.7).otherwise(1.0)
    return F.struct(width.alias("width"), opacity.alias("opacity"), F.when(highlighter, 2).otherwise(1).alias("cap"))


def alpha_key(alpha: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) * 1000).cast("int")


def rgb(color: Column, highlight: bool = False) -> Column:
    """array of three doubles; an unknown colour is yellow for highlights, black for strokes."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in RGB])
    unknown = (1.0, 0.93, 0.46) if highlight else (0.0, 0.0, 0.0)
    return F.when(color.between(0, len(RGB) - 1), F.get(table, color.cast("int"))).otherwise(F.array(*[F.lit(x) for x in unknown]))


def marked_color(color: Column, marker: Column) -> Column:
    """The colour that a marker (its four bytes as one signed int) names; ``color`` without one or with an unknown one."""
    pairs = [F.lit(v) for rgba, c in MARKED.items() for v in (int.from_bytes(bytes(rgba), "big", signed=True), c)]
    return F.coalesce(F.element_at(F.create_map(*pairs), marker.cast("int")), color.cast("int"))


def points_box(points: Column, pad: float = 0.0) -> Column:
    """struct<min_x, min_y, max_x, max_y> of an array of points with x and y; null if there are none."""
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.when(
        F.size(points) > 0,
        F.struct(
            (side(F.array_min, "x") - pad).alias("min_x"), (side(F.array_min, "y") - pad).alias("min_y"),
            (side(F.array_max, "x") + pad).alias("max_x"), (side(F.array_max, "y") + pad).alias("max_y"),
        ),
    )


def union_boxes(df: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """The box around all boxes of a key; rows without a box count for nothing."""
    return df.groupBy(*keys).agg(
        F.min(f"{box}.min_x").alias("min_x"), F.min(f"{box}.min_y").alias("min_y"), F.max(f"{box}.max_x").alias("max_x"),
        F.max(f"{box}.max_y").alias("max_y"), F.count(box).alias("boxes"),
    )


def translated(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rotation(degrees: Column) -> Column:
    """Page rotation as one of 0, 90, 180, 270."""
    return F.pmod(F.floor(degrees / 90) * 90, F.lit(360)).cast("int")


def displayed_size(width: Column, height: Column, turn: Column) -> Column:
    sideways = turn.isin(90, 270)
    return F.struct(F.when(sideways, height).otherwise(width).alias("width"), F.when(sideways, width).otherwise(height).alias("height"))


def overlay_point(x: Column, y: Column, min_x: Column, min_y: Column, page_height: Column, scale: float = SCALE) -> Column:
    """A screen point in page units, y from below."""
    return F.struct(((x - min_x) * scale).alias("x"), (page_height - (y - min_y) * scale).alias("y"))


def ellipse_points(cx: Column, cy: Column, rx: Column, ry: Column, steps: int = 256) -> Column:
    """A closed outline of ``steps`` parts (8 at least)."""
    n = max(8, steps)
    angle = lambda i: i * (2 * math.pi / n)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((cx + rx * F.cos(angle(i))).alias("x"), (cy + ry * F.sin(angle(i))).alias("y"))
    )


def file_version(header: Column) -> Column:
    """V3, V5 or V6 of a page file's header text, else null."""
    return F.when(header.contains("version=6"), "V6").when(header.contains("version=5"), "V5").when(header.contains("version=3"), "V3")


def block_name(kind: Column) -> Column:
    # Names of the block types that are decoded.
    names = {
        0: "migration_info", 1: "scene_tree", 2: "tree_node", 3: "glyph", 4: "group", 5: "line", 6: "text", 7: "root_text", 8: "tombstone", 10: "page_info",
    }
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind.cast("int")), F.lit("other"))


def rectangle_points(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> Column:
    """The closed outline (5 points) of a rectangle turned about its centre."""
    cx, cy, a = x + width / 2, y + height / 2, F.radians(degrees)
    corners = F.array(*[F.struct((width / 2 * sx).alias("x"), (height / 2 * sy).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    return F.transform(
        corners, lambda p: F.struct((cx + p["x"] * F.cos(a) - p["y"] * F.sin(a)).alias("x"), (cy + p["x"] * F.sin(a) + p["y"] * F.cos(a)).alias("y"))
    )


def shape_points(kind: Column, shape: Column) -> Column:
    """The points of a drawn shape (x, y, width, height, degrees, points): its own for a stroke, an outline for ellipse and rect.

    A kind that is not known has null.
    """
    half = lambda c: shape[c] / 2
    oval = ellipse_points(shape["x"] + half("width"), shape["y"] + half("height"), half("width"), half("height"))
    box = rectangle_points(shape["x"], shape["y"], shape["width"], shape["height"], shape["degrees"])
    return F.when(kind == "stroke", shape["points"]).when(kind == "ellipse", oval).when(kind == "rect", box)


def page_letters(i: Column) -> Column:
    """Sort keys of pages by their place from 0: ``ba``, ``bb`` and so on to ``bz``, then ``ca``.

    Behind ``zz`` come ``za`` to ``zz`` again, and page 676 begins anew with ``ba``; a place below 0 is ``ba``.
    """
    letter = lambda n: F.chr(F.lit(97) + n.cast("int"))
    at = F.greatest(i, F.lit(0)) % 676
    return F.concat(letter(F.least(F.floor(at / 26) + 1, F.lit(25))), letter(at % 26))
