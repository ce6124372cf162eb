"""Sheets and matrices against plain arithmetic, style changes, markers, and comparisons by structure and pixels."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry, ink
from foliospark.operators import placement

S = 72 / 226
BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def box(x1, y1, x2, y2):
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in ((x1, "min_x"), (y1, "min_y"), (x2, "max_x"), (y2, "max_y"))])


def test_canvas_is_the_screen_at_least(spark):
    assert tuple(value(spark, geometry.canvas(F.lit(None).cast(BOX)))) == (-702.0, 0.0, 702.0, 1872.0)
    assert tuple(value(spark, geometry.canvas(box(-800, 5, 10, 2000)))) == (-800.0, 0.0, 702.0, 2000.0)


@pytest.mark.parametrize("degrees", [0, 90, 180, 270, -90, 450, 45])
def test_turned_pages_stand_upright_at_the_origin(spark, degrees):
    """The corners of a turned page are those of the displayed one, and each goes where turning it back by hand takes it."""
    w, h = 300.0, 500.0
    m = geometry.turned(F.lit(degrees), F.lit(w), F.lit(h))
    at = {(x, y): tuple(value(spark, geometry.moved(m, F.lit(x), F.lit(y)))) for x in (0.0, w) for y in (0.0, h)}
    want = {0: lambda x, y: (x, y), 90: lambda x, y: (y, w - x), 180: lambda x, y: (w - x, h - y), 270: lambda x, y: (h - y, x)}.get(degrees % 360, lambda x, y: (x, y))
    assert at == {p: want(*p) for p in at}


def test_composed_is_one_after_the_other(spark):
    draw = random.Random(1)
    for _ in range(5):
        a, b = ([draw.uniform(-3, 3) for _ in range(6)] for _ in range(2))
        x, y = draw.uniform(-9, 9), draw.uniform(-9, 9)
        inner = geometry.moved(geometry.matrix(*b), F.lit(x), F.lit(y))
        both = value(spark, geometry.moved(geometry.composed(geometry.matrix(*a), geometry.matrix(*b)), F.lit(x), F.lit(y)))
        step = value(spark, geometry.moved(geometry.matrix(*a), inner["x"], inner["y"]))
        assert tuple(both) == pytest.approx(tuple(step))


def test_placement_of_smaller_larger_and_equal_pages(spark):
    whole = geometry.canvas(box(-800, -100, 0, 0))
    w, h = (702 + 800 + 1) * S, (1872 + 100 + 1) * S

    def place(width, height):
        return value(spark, geometry.placement(whole, F.lit(width), F.lit(height))).asDict()

    small = place(w - 100, h - 50)
    assert (small["width"], small["height"], small["layer_x"], small["layer_y"]) == pytest.approx((w, h, 0, 0))
    assert small["source_x"] == pytest.approx(w / 2 - (w - 100) / 2 - (w / 2 - 800 * S))
    assert small["source_y"] == pytest.approx(h - 100 * S - (h - 50))
    assert small["highlight_x"] == pytest.approx(800 * S)
    large = place(w + 100, h + 50)
    assert (large["width"], large["height"], large["source_x"], large["source_y"]) == pytest.approx((w + 100, h + 50, 0, 0))
    assert large["layer_x"] == pytest.approx((w + 100) / 2 - w / 2 + (w / 2 - 800 * S))
    assert large["layer_y"] == pytest.approx(h + 50 + 100 * S - h)
    same = place(w, h)
    assert all(same[k] == 0 for k in ("layer_x", "source_x")) and same["layer_y"] == pytest.approx(0) and same["highlight_x"] == pytest.approx(w / 2)


def test_bare_sheet_has_equal_margins(spark):
    # strokes leave 602 at the left and 2 at the right: the right side moves out by the difference
    got = value(spark, geometry.bare_sheet(box(-100, 10, 700, 20), F.lit(6.0)))
    assert tuple(got)[:4] == (-705.0, -3.0, 702.0 + 3 + 600, 1875.0)
    assert got["width"] == pytest.approx((1305 + 705 + 1) * S * 0.75) and got["height"] == pytest.approx((1875 + 3 + 1) * S * 0.75)
    # beyond the right side there is no margin
    assert value(spark, geometry.bare_sheet(box(-702, 0, 900, 1), F.lit(None).cast("double")))["min_x"] == -703.0
    assert tuple(value(spark, geometry.bare_sheet(F.lit(None).cast(BOX), F.lit(0.0))))[:4] == (-703.0, -1.0, 703.0, 1873.0)


def test_strokes_and_source_meet_on_the_sheet(spark):
    """A screen's corners lie at the layer's place, also through a group; pages without a sheet or a size give no point."""
    pages = spark.createDataFrame([(1, None, 100, 200, 90, "x"), (2, None, None, 200, 0, "y")], f"page int, box {BOX}, width int, height int, degrees int, layer2 string")
    sheet = placement.sheets(pages)
    rows = {r["page"]: r for r in sheet.collect()}
    assert rows[2]["place"] is None and rows[1]["layer2"] == "x"
    strokes = spark.createDataFrame(
        [(1, [(-702.0, 0.0)], 0.0, 0.0), (1, [(0.0, 1872.0)], -702.0, 0.0), (1, [], 0.0, 0.0), (3, [(0.0, 0.0)], 0.0, 0.0)],
        "page int, points array<struct<x:double,y:double>>, dx double, dy double",
    )
    got = sorted([tuple(p) for p in r["points"]] for r in placement.on_sheets(strokes, sheet).collect())
    h = 1873 * S
    assert len(got) == 3 and got[0] == []
    assert got[1][0] == pytest.approx((0, h - 1872 * S)) and got[2][0] == pytest.approx((0, h))
    assert placement.on_sheets(strokes.limit(0), sheet).count() == 0


def test_style_changes(spark):
    rows = [(1, 1, 2.0, 1.0, 1, 0), (1, 2, 2.0, 0.3, 2, 0), (1, 3, 25.0, 0.3, 2, 9), (1, 4, 25.0, 1.0, 1, None), (1, 5, 25.0, 1.0, 1, None), (2, 1, 25.0, 0.3, 2, 0)]
    df = spark.createDataFrame(rows, "page int, k int, width double, opacity double, cap int, color int")
    got = placement.style_changes(df, ["page"], ["k"]).orderBy("page", "k").select("set_width", "set_alpha", "set_cap", "set_color").collect()
    assert [tuple(r) for r in got] == [
        (2.0, None, None, 0), (None, 300, 2, None), (25.0, None, None, 9), (None, 1000, 1, None), (None, None, None, None), (25.0, 300, 2, 0)
    ]


def test_marked_colors(spark):
    marker = lambda *b: int.from_bytes(bytes(b), "big", signed=True)
    rows = [(3, marker(255, 237, 117, 255)), (3, marker(116, 210, 232, 102)), (3, marker(1, 2, 3, 4)), (3, None)]
    df = spark.createDataFrame(rows, "color int, marker int")
    assert [r[0] for r in df.select(ink.marked_color(F.col("color"), F.col("marker"))).collect()] == [14, 27, 3, 3]


PAGES = "doc_id string, page int, annotations int, degrees int, text string, other string"


def test_structure_reasons_have_an_order(spark):
    a = [("same", 1, 1, 0, "a  b\r\n c", "x"), ("all", 1, 1, 0, "a", "x"), ("turn", 1, 1, 90, "a", "x"), ("text", 1, None, None, "a", "x"), ("text", 2, 0, 0, None, "x"), ("less", 1, 0, 0, "a", "x"), ("turned", 1, 0, 360, "a", "x")]
    b = [("same", 1, 1, 0, " a b c ", "y"), ("all", 1, 2, 90, "b", "x"), ("turn", 1, 1, 0, "b", "x"), ("text", 1, 0, 0, "b", "x"), ("text", 2, 0, 0, "", "x"), ("less", 1, 0, 0, "a", "x"), ("less", 2, 0, 0, "a", "x"), ("turned", 1, 0, 0, "a", "x")]
    pages = placement.structural_pages(spark.createDataFrame(a, PAGES), spark.createDataFrame(b, PAGES))
    reasons = {(r["doc_id"], r["page"]): r["reason"] for r in pages.collect()}
    assert reasons == {
        ("same", 1): "match", ("all", 1): "annotation count mismatch", ("turn", 1): "rotation mismatch", ("text", 1): "extracted text mismatch", ("text", 2): "match",
        ("less", 1): "match", ("less", 2): None, ("turned", 1): "rotation mismatch",
    }
    verdict = {r["doc_id"]: tuple(r)[1:] for r in placement.structural_verdict(pages).collect()}
    assert verdict == {"same": (1, 1, 1, True), "all": (1, 1, 1, False), "turn": (1, 1, 1, False), "text": (2, 2, 2, False), "less": (1, 2, 0, False), "turned": (1, 1, 1, False)}
    assert placement.structural_verdict(placement.structural_pages(*[spark.createDataFrame([], PAGES)] * 2)).count() == 0


def test_rasters_equal_a_plain_loop(spark):
    draw, a, b, want = random.Random(5), [], [], {}
    for k in range(40):
        w, h = draw.randint(0, 6), draw.randint(0, 6)
        v, g = max(0, w + draw.choice([0, 0, 1, -1, 2])), max(0, h + draw.choice([0, 0, 1, -1]))
        x = [[bytes(draw.choices(range(3), k=4)) for _ in range(w)] for _ in range(h)]
        y = [[x[j][i] if j < h and i < w and draw.random() < 0.8 else bytes(draw.choices(range(3), k=4)) for i in range(v)] for j in range(g)]
        a.append((k, 0, w, h, b"".join(b"".join(r) for r in x)))
        b.append((k, 0, v, g, b"".join(b"".join(r) for r in y)))
        cw, ch = min(w, v), min(h, g)
        if abs(w - v) > 1 or abs(h - g) > 1:
            want[k] = (1.0, "rendered image size mismatch", False)
        elif not cw * ch:
            want[k] = (0.0, "empty image bounds", True)
        else:
            ratio = sum(x[j][i] != y[j][i] for j in range(ch) for i in range(cw)) / (cw * ch)
            want[k] = (ratio, "within tolerance" if ratio <= 0.2 else "diff exceeds tolerance", ratio <= 0.2)
    a.append((99, 0, 1, 1, b"abcd"))
    want[99] = (1.0, "page missing", False)
    kinds = "doc_id int, page int, width int, height int, data binary"
    found = placement.compare_rasters(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), 0.2).collect()
    assert {r["doc_id"]: (r["ratio"], r["reason"], r["match"]) for r in found} == want
