"""Page files made by a small writer, decoded and placed."""

import struct

import pytest
from pyspark.errors import PythonException

from foliospark.operators import scene
from foliospark.sources import pagefile

HEADER = b"made for tests .lines file, version=6".ljust(pagefile.HEADER_BYTES)


def varuint(n):
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def tag(index, kind):
    return varuint(index << 4 | kind)


def ident(index, a, b):
    return tag(index, 0xF) + bytes([a]) + varuint(b)


def sub(index, body):
    return tag(index, 0xC) + struct.pack("<I", len(body)) + body


def u32(index, n):
    return tag(index, 4) + struct.pack("<I", n)


def f32(index, x):
    return tag(index, 4) + struct.pack("<f", x)


def flag(index, b):
    return tag(index, 1) + bytes([b])


def string(index, text):
    raw = text.encode()
    return sub(index, varuint(len(raw)) + bytes([1]) + raw)


def block(kind, body, version=2):
    return struct.pack("<IBBBB", len(body), 0, 1, version, kind) + body


def tree(node, parent):
    return block(1, ident(1, *node) + ident(2, 0, 0) + flag(3, 1) + sub(4, ident(1, *parent)))


def node(own, anchor=None, origin=None):
    body = ident(1, *own) + sub(2, ident(1, 0, 1) + string(2, "layer")) + sub(3, ident(1, 0, 1) + flag(2, 1))
    if anchor:
        body += sub(7, ident(1, 0, 1) + ident(2, *anchor)) + sub(8, ident(1, 0, 1) + flag(2, 1)) + sub(9, ident(1, 0, 1) + f32(2, 0.0))
        body += sub(10, ident(1, 0, 1) + f32(2, origin))
    return block(2, body)


def item(kind, parent, own, value=b"", inner=None, version=2, deleted=0):
    body = ident(1, *parent) + ident(2, *own) + ident(3, 0, 0) + ident(4, 0, 0) + u32(5, deleted)
    return block(kind, body + (sub(6, bytes([inner]) + value) if inner else b""), version)


def line(points, version=2, tail=b""):
    body = u32(1, 17) + u32(2, 6) + tag(3, 8) + struct.pack("<d", 2.0) + f32(4, 0.5)
    return body + sub(5, b"".join(struct.pack("<ff" + ("HHBB" if version == 2 else "ffff"), *p) for p in points)) + ident(6, 0, 1) + tail


def root_text(spans, styles=(), pos=(10.0, 200.0)):
    items = b"".join(
        sub(0, ident(2, *own) + ident(3, *left) + ident(4, *right) + u32(5, gone) + (string(6, text) if text is not None else b"")) for own, left, right, gone, text in spans
    )
    formats = b"".join(bytes([a]) + varuint(b) + ident(1, 0, 1) + sub(2, bytes([17, style])) for (a, b), style in styles)
    body = ident(1, 0, 0) + sub(2, sub(1, sub(1, varuint(len(spans)) + items)) + sub(2, sub(1, varuint(len(styles)) + formats)))
    return block(7, body + sub(3, struct.pack("<dd", *pos)) + f32(4, 500.0))


INNER, OUTER = (0, 20), (0, 11)
PAGE = HEADER + b"".join([
    tree(OUTER, (0, 1)), tree(INNER, OUTER), node(OUTER, (1, 5), 7.0), node(INNER, (9, 9), -2.0), block(200, b"abc"), block(5, b"\x00"),
    item(4, (0, 1), (1, 50), ident(2, *OUTER), 2), item(4, OUTER, (1, 51), ident(2, *INNER), 2),
    item(5, INNER, (1, 60), line([(1.0, 2.0, 3, 40, 5, 6), (4.0, -2.0, 1, 9, 0, 0)], tail=b"\x84\x01\x01\x02\x03\xff"), 3),
    item(5, OUTER, (1, 61), line([(0.0, 0.0, 1.0, 3.14159274, 0.625, 0.5)], 1), 3, version=1), item(5, OUTER, (1, 62), deleted=1),
    item(3, INNER, (1, 63), u32(2, 4) + u32(4, 3) + string(5, "two words") + sub(6, varuint(2) + struct.pack("<8d", 0, 0, 5, 1, 2, 3, 4, 2)), 1),
    root_text([((1, 2), (0, 0), (0, 0), 0, "Ab"), ((1, 4), (1, 3), (0, 0), 2, None), ((1, 6), (1, 5), (0, 0), 0, "\nz\n")], [((0, 0), 2), ((1, 6), 4)]),
])


@pytest.fixture(scope="module")
def blocks(spark):
    files = spark.createDataFrame([(1, PAGE), (2, HEADER), (3, None)], "page bigint, bytes binary")
    return pagefile.page_blocks(files, ["page"]).cache()


def test_blocks(blocks):
    rows = blocks.orderBy("block").collect()
    assert [r["type"] for r in rows] == [1, 1, 2, 2, 200, 5, 4, 4, 5, 5, 5, 3, 7] and {r["page"] for r in rows} == {1}
    assert [r["block"] for r in rows if r["malformed"]] == [5]
    assert rows[2]["label"] == "layer" and rows[2]["visible"] and tuple(rows[2]["anchor"]) == (1, 5) and rows[2]["origin_x"] == 7.0
    assert rows[4]["size"] == 3 and rows[10]["deleted"] == 1 and rows[10]["kind"] is None
    assert (rows[12]["pos_y"], rows[12]["width"], [s["text"] for s in rows[12]["spans"]]) == (200.0, 500.0, ["Ab", None, "\nz\n"])


@pytest.mark.parametrize("content", [b"", HEADER.replace(b"6", b"5"), HEADER + block(200, b"abc")[:-1], HEADER + b"\x01"])
def test_broken_files(spark, content):
    with pytest.raises(PythonException):
        pagefile.page_blocks(spark.createDataFrame([(1, content)], "page bigint, bytes binary"), ["page"]).collect()


def test_strokes(blocks):
    anchors = scene.anchor_positions(blocks)
    drawn = {r["block"]: r for r in scene.strokes(blocks, anchors).collect()}
    assert set(drawn) == {8, 9}
    # the outer group hangs on character 1:5, which is deleted but stands in the first paragraph
    assert (drawn[9]["dx"], drawn[9]["dy"]) == (7.0, 112.0) and (drawn[8]["dx"], drawn[8]["dy"]) == (5.0, 112.0)
    first = drawn[8]["points"][0]
    assert (first["x"], first["y"], first["speed"], first["width"], first["direction"], first["pressure"]) == (6.0, 114.0, 3.0, 40.0, 5.0, 6.0)
    old = drawn[9]["stroke"]["points"][0]
    assert (old["speed"], round(old["direction"], 3), old["width"], old["pressure"]) == (4.0, 127.5, 3.0, 127.5)
    assert drawn[8]["stroke"]["marker"] == int.from_bytes(bytes([3, 2, 1, 255]), "big", signed=True) and drawn[9]["stroke"]["marker"] is None
    assert scene.widest_strokes(scene.strokes(blocks, anchors)).first()["width"] == 40.0
    report = {r["block"]: r for r in scene.stroke_report(scene.strokes(blocks, anchors)).collect()}
    assert (report[8]["width"], report[8]["height"], report[8]["n_points"]) == (3.0, 4.0, 2)
    box = scene.page_boxes(blocks, anchors).first()
    assert tuple(box["plain"]) == (0.0, -2.0, 4.0, 2.0) and tuple(box["anchored"]) == (6.0, 110.0, 9.0, 114.0)


def test_highlights(blocks):
    found = scene.highlights(blocks).first()
    assert (found["glyph"]["start"], found["glyph"]["length"], found["glyph"]["text"], tuple(found["box"])) == (4, None, "two words", (5.0, 0.0, 11.0, 5.0))


def test_typed_text(blocks):
    chars = scene.ordered_characters(blocks).orderBy("place").collect()
    assert [(r["p2"], r["ch"]) for r in chars] == [(2, "A"), (3, "b"), (4, ""), (5, ""), (6, "\n"), (7, "z"), (8, "\n")]
    rows = scene.paragraphs(blocks).orderBy("paragraph").collect()
    assert [(tuple(r["start"]), r["style"], r["text"]) for r in rows] == [((0, 0), 2, "Ab"), ((1, 6), 4, "z"), ((1, 8), 1, "")]
    assert scene.has_text(scene.paragraphs(blocks)).first()["has_text"]
    ys = {tuple(r["anchor"]): r["y"] for r in scene.anchor_positions(blocks).collect()}
    assert ys[1, 2] == ys[0, 0] == 112.0 and ys[1, 6] == ys[1, 7] == 262.0 and ys[1, 8] == 297.0 and ys[0, 281474976710655] == 100.0


def test_lost_parents(spark):
    for content in (HEADER + item(5, (0, 77), (1, 60), line([]), 3), HEADER + item(4, (0, 1), (1, 1), ident(2, 5, 5), 2)):
        own = pagefile.page_blocks(spark.createDataFrame([(1, content)], "page bigint, bytes binary"), ["page"])
        with pytest.raises(Exception, match="not there"):
            scene.strokes(own).collect()


def test_cut_points():
    value = u32(1, 1) + u32(2, 1) + tag(3, 8) + struct.pack("<d", 1.0) + f32(4, 0.0) + sub(5, b"12345")
    with pytest.raises(pagefile.Broken):
        pagefile.line_of(value, 2)
