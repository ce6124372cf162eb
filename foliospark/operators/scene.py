"""Scenes of page files: group positions, strokes and highlights in page coordinates, typed text, boxes.

Works on the rows of ``pagefile.page_blocks`` keyed by ``page`` (any column that names a page). Groups form a tree by their
items; positions come from pointer doubling, as paths do in file trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.ink import marked_color, points_box
from foliospark.operators.pages import paragraph_positions
from foliospark.operators.sequences import sequence_order
from foliospark.session import scratch, stored
from foliospark.sources.pagefile import decoded_glyph, decoded_line

# The id of the scene's root, and the two anchors that every page has, with their height.
ROOT = (0, 1)
END_ANCHORS = ((0, 281474976710654), (0, 281474976710655))
END_ANCHOR_Y = 100.0
NEWLINE = "\n"


def _root() -> Column:
    return F.struct(F.lit(ROOT[0]).alias("p1"), F.lit(ROOT[1]).cast("bigint").alias("p2"))


def _coloured(decoded: Column) -> Column:
    """A decoded stroke or highlight with the colour that its marker names."""
    return decoded.withField("color", marked_color(decoded["color"], decoded["marker"]))


def groups(blocks: DataFrame) -> DataFrame:
    """page, node, parent, anchor, origin_x of every group: its place in the tree is that of the item that shows it."""
    known = blocks.filter("type = 1 and not malformed").select("page", "node").distinct()
    shown = blocks.filter("kind = 'group' and not malformed").select(F.col("page").alias("sp"), F.col("node").alias("sn"), F.col("parent"))
    about = blocks.filter("type = 2 and not malformed").groupBy(F.col("page").alias("ap"), F.col("node").alias("an")).agg(
        F.max_by("anchor", "block").alias("anchor"), F.max_by("origin_x", "block").alias("origin_x")
    )
    placed = shown.join(known, (F.col("sp") == F.col("page")) & (F.col("sn") == F.col("node")), "left").select(
        F.col("sp").alias("page"),
        F.when(F.col("node").isNull(), F.raise_error(F.lit("a group item names a group that is not there")).cast("struct<p1:int,p2:bigint>")).otherwise(F.col("sn")).alias("node"),
        "parent",
    )
    rooted = placed.unionByName(blocks.select("page").distinct().select("page", _root().alias("node"), F.lit(None).cast("struct<p1:int,p2:bigint>").alias("parent")))
    return rooted.join(about, (F.col("page") == F.col("ap")) & (F.col("node") == F.col("an")), "left").drop("ap", "an")


def checked_items(blocks: DataFrame) -> DataFrame:
    """The scene items; one whose parent group does not exist fails."""
    known = blocks.filter("type = 1 and not malformed").select(F.col("page").alias("kp"), F.col("node").alias("kn")).distinct()
    items = blocks.filter("item is not null and not malformed")
    both = items.join(known, (F.col("page") == F.col("kp")) & (F.col("parent") == F.col("kn")), "left")
    lost = F.col("kn").isNull() & (F.col("parent") != _root())
    parent = F.when(lost, F.raise_error(F.lit("an item's parent group is not there")).cast("struct<p1:int,p2:bigint>")).otherwise(F.col("parent"))
    return both.withColumn("parent", parent).drop("kp", "kn")


def group_offsets(blocks: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """page, node, dx, dy of the groups that hang on the root: their own and all outer groups' anchors added up.

    ``anchors`` has page, anchor, y; an anchor that it does not have is at 0. Groups on a cycle or a missing group are left out.
    """
    found = groups(blocks)
    if anchors is None:
        placed = found.withColumn("y", F.lit(0.0))
    else:
        side = anchors.select(F.col("page").alias("yp"), F.col("anchor").alias("ya"), "y")
        placed = found.join(side, (F.col("page") == F.col("yp")) & (F.col("anchor") == F.col("ya")), "left")
    start = placed.select("page", "node", F.col("parent").alias("up"), F.coalesce("origin_x", F.lit(0.0)).alias("dx"), F.coalesce("y", F.lit(0.0)).alias("dy"))
    with scratch(blocks.sparkSession) as block:
        state = stored(start, "group-offsets")
        left, before = state.filter("up is not null").count(), None
        while left and left != before:
            above = state.select(*[F.col(c).alias(f"a_{c}") for c in state.columns])
            both = state.join(above, (F.col("page") == F.col("a_page")) & (F.col("up") == F.col("a_node")), "left")
            here = F.col("a_node").isNotNull()
            step = both.select(
                "page", "node", F.when(here, F.col("a_up")).otherwise(F.col("up")).alias("up"),
                *[(F.col(c) + F.coalesce(F.col(f"a_{c}"), F.lit(0.0))).alias(c) for c in ("dx", "dy")],
            )
            state = stored(step, "group-offsets")
            left, before = state.filter("up is not null").count(), left
        return block.keep(state).filter("up is null").drop("up")


def strokes(blocks: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """page, block, item, parent, dx, dy, stroke, points (moved by their group's offset) of all lines on the root's tree.

    The blocks are stored once: groups, checks and strokes each read them, and files are decoded a single time.
    """
    with scratch(blocks.sparkSession) as block:
        blocks = stored(blocks, "scene-blocks")
        lines = checked_items(blocks).filter("kind = 'line'")
        drawn = lines.select("page", "block", "item", "parent", _coloured(decoded_line(F.col("value"), F.col("current_version"))).alias("stroke"))
        at = group_offsets(blocks, anchors).select(F.col("page").alias("gp"), F.col("node").alias("gn"), "dx", "dy")
        moved = F.transform("stroke.points", lambda p: p.withField("x", p["x"] + F.col("dx")).withField("y", p["y"] + F.col("dy")))
        placed = drawn.join(at, (F.col("page") == F.col("gp")) & (F.col("parent") == F.col("gn")))
        return block.keep(placed.select("page", "block", "item", "parent", "dx", "dy", "stroke", moved.alias("points")))


def highlights(blocks: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """page, block, item, glyph, boxes (moved) and box (around them) of all highlights on the root's tree."""
    found = blocks.filter("kind = 'glyph' and not malformed").select("page", "block", "item", "parent", _coloured(decoded_glyph(F.col("value"))).alias("glyph")).filter("glyph is not null")
    at = group_offsets(blocks, anchors).select(F.col("page").alias("gp"), F.col("node").alias("gn"), "dx", "dy")
    boxes = F.transform("glyph.boxes", lambda r: r.withField("x", r["x"] + F.col("dx")).withField("y", r["y"] + F.col("dy")))
    moved = found.join(at, (F.col("page") == F.col("gp")) & (F.col("parent") == F.col("gn"))).select("page", "block", "item", "glyph", boxes.alias("boxes"))
    corners = F.flatten(F.transform("boxes", lambda r: F.array(F.struct(r["x"].alias("x"), r["y"].alias("y")), F.struct((r["x"] + r["w"]).alias("x"), (r["y"] + r["h"]).alias("y")))))
    return moved.withColumn("box", points_box(corners))


def stroke_report(drawn: DataFrame) -> DataFrame:
    """Per stroke: points, raw box, moved box, and its width and height."""
    raw, moved = points_box(F.col("stroke.points")), points_box(F.col("points"))
    return drawn.select(
        "page", "block", F.size("points").alias("n_points"), "dx", "dy", raw.alias("raw_box"), moved.alias("box"),
        (moved["max_x"] - moved["min_x"]).alias("width"), (moved["max_y"] - moved["min_y"]).alias("height"),
    )


def widest_strokes(drawn: DataFrame) -> DataFrame:
    """page, width: the largest point width of a page."""
    return drawn.groupBy("page").agg(F.max(F.array_max(F.transform("points", lambda p: p["width"]))).alias("width"))


def page_boxes(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """page, plain (the box of all strokes, whatever group they are in) and anchored (of the strokes on the root's tree, moved)."""
    lines = blocks.filter("kind = 'line' and not malformed").select("page", points_box(decoded_line(F.col("value"), F.col("current_version"))["points"]).alias("b"))
    moved = strokes(blocks, anchors).select(F.col("page").alias("mp"), points_box(F.col("points")).alias("b"))

    def around(df: DataFrame, page: str, name: str) -> DataFrame:
        sides = F.struct(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y"))
        return df.filter("b is not null").groupBy(page).agg(sides.alias(name))

    return around(lines, "page", "plain").join(around(moved, "mp", "anchored"), F.col("page") == F.col("mp"), "left").drop("mp")


def characters(blocks: DataFrame) -> DataFrame:
    """page, p1, p2, left, right and ch of every character of typed text; those of deleted spans are empty.

    A span's characters follow one another: character k has the span's second id plus k.
    """
    span = blocks.filter("type = 7 and not malformed").select("page", F.explode("spans").alias("s"))
    gone = F.col("s.deleted") > 0
    chars = F.when(gone, F.array_repeat(F.lit(""), F.col("s.deleted").cast("int"))).otherwise(F.filter(F.split(F.coalesce("s.text", F.lit("")), ""), lambda c: c != ""))
    one = span.select("page", "s", F.size(chars).alias("n"), F.posexplode(chars).alias("k", "ch"))
    own = lambda k: F.struct(F.col("s.item.p1").alias("p1"), (F.col("s.item.p2") + k).alias("p2"))
    return one.select(
        "page", F.col("s.item.p1").alias("p1"), (F.col("s.item.p2") + F.col("k")).alias("p2"),
        F.when(F.col("k") == 0, F.col("s.left")).otherwise(own(F.col("k") - 1)).alias("left"),
        F.when(F.col("k") == F.col("n") - 1, F.col("s.right")).otherwise(own(F.col("k") + 1)).alias("right"), "ch",
    )


def ordered_characters(blocks: DataFrame) -> DataFrame:
    """page, p1, p2, place, ch, paragraph: characters in text order; a line break begins a paragraph. ``page`` is a long."""
    chars = characters(blocks)
    items = chars.select(
        F.col("page").alias("seq_id"), "p1", "p2", F.col("left.p1").alias("left_p1"), F.col("left.p2").alias("left_p2"), F.col("right.p1").alias("right_p1"), F.col("right.p2").alias("right_p2")
    )
    order = sequence_order(items).select("seq_id", F.col("p1").alias("o1"), F.col("p2").alias("o2"), "place")
    placed = chars.join(order, (F.col("page") == F.col("seq_id")) & (F.col("p1") == F.col("o1")) & (F.col("p2") == F.col("o2"))).drop("seq_id", "o1", "o2")
    so_far = Window.partitionBy("page").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("paragraph", F.sum(F.when(F.col("ch") == NEWLINE, 1).otherwise(0)).over(so_far))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("p1"), F.lit(0).cast("bigint").alias("p2"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """page, paragraph, start, style, text (without the line break) of typed text.

    A paragraph starts at the line break before it, the text before the first one at id 0:0; its style is the one set at its
    start, else 1, plain.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ch"))), lambda c: c["ch"]), "")
    grouped = ordered_characters(blocks).groupBy("page", "paragraph").agg(
        F.min_by(F.struct("p1", "p2"), "place").alias("first"), F.replace(text, F.lit(NEWLINE), F.lit("")).alias("text")
    )
    begun = grouped.select("page", "paragraph", F.when(F.col("paragraph") == 0, _zero()).otherwise(F.col("first")).alias("start"), "text")
    styled = blocks.filter("type = 7 and not malformed").select(F.col("page").alias("tp"), F.explode("styles").alias("t")).select("tp", F.col("t.at").alias("at"), "t.style")
    return begun.join(styled, (F.col("page") == F.col("tp")) & (F.col("start") == F.col("at")), "left").select(
        "page", "paragraph", "start", F.coalesce("style", F.lit(1)).alias("style"), "text"
    )


def has_text(paragraph_rows: DataFrame) -> DataFrame:
    """page, has_text: whether some paragraph is more than blank."""
    return paragraph_rows.groupBy("page").agg(F.bool_or(F.trim("text") != "").alias("has_text"))


def anchor_positions(blocks: DataFrame) -> DataFrame:
    """page, anchor, y of every character and paragraph start, and of the two anchors at the end that each page has."""
    heights = paragraph_positions(paragraphs(blocks), "page", "paragraph", "style")
    top = blocks.filter("type = 7 and not malformed").select(F.col("page").alias("pp"), F.col("pos_y"))
    high = heights.join(top, F.col("page") == F.col("pp")).select(F.col("page").alias("hp"), F.col("paragraph").alias("hn"), (F.col("y") + F.col("pos_y")).alias("y"))
    chars = ordered_characters(blocks)
    own = chars.join(high, (F.col("page") == F.col("hp")) & (F.col("paragraph") == F.col("hn"))).select("page", F.struct("p1", "p2").alias("anchor"), "y")
    own = own.unionByName(high.filter("hn = 0").select(F.col("hp").alias("page"), _zero().alias("anchor"), "y"))
    ends = F.array(*[F.struct(F.lit(a).alias("p1"), F.lit(b).cast("bigint").alias("p2")) for a, b in END_ANCHORS])
    fixed = blocks.select("page").distinct().select("page", F.explode(ends).alias("anchor"), F.lit(END_ANCHOR_Y).alias("y"))
    return own.unionByName(fixed)


def exported(drawn: DataFrame) -> DataFrame:
    """page, drawing: the strokes of each page in order as JSON of the drawing language, one layer, for another compile.

    Only strokes, those of fewer than two points are left out, every width is 1; tool and colour are their numbers as text. A page
    whose strokes are all left out has an empty layer. A page is one drawing, so its strokes meet in one row.
    """
    points = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    style = F.struct(F.col("stroke.tool").cast("string").alias("tool"), F.col("stroke.color").cast("string").alias("color"), F.lit(1).alias("width"))
    item = F.when(F.size("points") >= 2, F.struct(F.lit("stroke").alias("kind"), style.alias("stroke"), points.alias("points")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("block", item.alias("item"))))), lambda x: x["item"])
    # The canvas of a drawing.
    canvas = F.struct(F.lit("rm_screen_v6").alias("space"), F.lit(1404).alias("width"), F.lit(1872).alias("height"))
    layer = F.struct(F.lit("strokes").alias("name"), F.col("items"))
    return drawn.groupBy("page").agg(listed.alias("items")).select("page", F.to_json(F.struct(canvas.alias("canvas"), F.array(layer).alias("layers"))).alias("drawing"))
