"""Version 6 page files: tagged blocks as rows, strokes, highlights and typed text.

A page file is a header and blocks of tagged values. One Arrow function walks a file's blocks; strokes and highlights are
decoded by column functions of their own, so that a query that needs block counts only pays for nothing more.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header size, value types of tags, block types, item kinds, and the prefixes of a colour marker.
HEADER_BYTES = 43
_HEADER = re.compile(rb".{3,30}lines file, version=6 +", re.S)
ID, BLOCK, F64, B4, B1 = 0xF, 0xC, 0x8, 0x4, 0x1
TREE, NODE, ROOT_TEXT = 1, 2, 7
ITEM_TYPES = {3, 4, 5, 6, 8}
KINDS = {1: "glyph", 2: "group", 3: "line", 5: "text"}
_MARKS = (b"\x84\x01", b"\xa4\x01")

_ID = "struct<p1:int,p2:bigint>"
BLOCKS = (
    "block int, offset bigint, size bigint, type int, min_version int, current_version int, malformed boolean, "
    f"node {_ID}, parent {_ID}, item {_ID}, left {_ID}, right {_ID}, deleted bigint, kind string, value binary, "
    f"label string, visible boolean, anchor {_ID}, origin_x double, "
    f"spans array<struct<item:{_ID},left:{_ID},right:{_ID},deleted:bigint,text:string>>, styles array<struct<at:{_ID},style:int>>, "
    "pos_x double, pos_y double, width double"
)


class Broken(ValueError):
    """Bytes that are not what their place asks for."""


class Values:
    """Tagged values of a stretch of bytes, read in order."""

    def __init__(self, data: memoryview, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> memoryview:
        if self.at + n > self.end:
            raise Broken("ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def plain(self, form: str) -> int | float:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def varuint(self) -> int:
        value = shift = 0
        while True:
            byte = self.plain("B")
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise Broken("number too long")

    def has(self, index: int, kind: int) -> bool:
        """Whether the next value has this tag; nothing is consumed."""
        start = self.at
        try:
            return self.varuint() == index << 4 | kind
        except Broken:
            return False
        finally:
            self.at = start

    def tag(self, index: int, kind: int) -> None:
        if not self.has(index, kind):
            raise Broken(f"no value {index} of type {kind}")
        self.varuint()

    def bare_id(self) -> dict:
        return {"p1": self.plain("B"), "p2": self.varuint()}

    def id(self, index: int) -> dict:
        self.tag(index, ID)
        return self.bare_id()

    def number(self, index: int, form: str = "I") -> int | float:
        self.tag(index, {"I": B4, "f": B4, "d": F64, "B": B1, "?": B1}[form])
        return self.plain(form)

    def inner(self, index: int) -> Values:
        """The values of a sub-block, which is passed over."""
        self.tag(index, BLOCK)
        n = self.plain("I")
        start = self.at
        self.take(n)
        return Values(self.data, start, start + n)

    def string(self, index: int) -> str:
        own = self.inner(index)
        n, _ascii = own.varuint(), own.plain("B")
        return bytes(own.take(n)).decode()

    def stamped(self, index: int, read: Callable[[Values], object]) -> object:
        """A value that carries the time stamp of its last write."""
        own = self.inner(index)
        own.id(1)
        return read(own)

    def rest(self) -> bytes:
        return bytes(self.take(self.end - self.at))


def _tree_node(v: Values) -> dict:
    row = {"node": v.id(1), "label": v.stamped(2, lambda o: o.string(2)), "visible": v.stamped(3, lambda o: o.number(2, "?"))}
    if v.has(7, BLOCK):
        row["anchor"] = v.stamped(7, lambda o: o.id(2))
    for index in (8, 9):
        if v.has(index, BLOCK):
            v.inner(index)
    if v.has(10, BLOCK):
        row["origin_x"] = v.stamped(10, lambda o: o.number(2, "f"))
    return row


def _tree(v: Values) -> dict:
    row = {"node": v.id(1)}
    v.id(2)
    v.number(3, "?")
    return row | {"parent": v.inner(4).id(1)}


def _item(v: Values) -> dict:
    row = {"parent": v.id(1), "item": v.id(2), "left": v.id(3), "right": v.id(4), "deleted": v.number(5)}
    if v.has(6, BLOCK):
        own = v.inner(6)
        row["kind"] = KINDS.get(own.plain("B"), "unknown")
        if row["kind"] == "group":
            row["node"] = own.id(2)
        row["value"] = own.rest()
    return row


def _root_text(v: Values) -> dict:
    v.id(1)
    body = v.inner(2)
    items = body.inner(1).inner(1)
    spans = []
    for _ in range(items.varuint()):
        own = items.inner(0)
        span = {"item": own.id(2), "left": own.id(3), "right": own.id(4), "deleted": own.number(5), "text": None}
        if own.has(6, BLOCK):
            span["text"] = own.string(6)
        spans.append(span)
    formats = body.inner(2).inner(1)
    styles = []
    for _ in range(formats.varuint()):
        at = formats.bare_id()
        formats.id(1)
        own = formats.inner(2)
        own.plain("B")
        styles.append({"at": at, "style": own.plain("B")})
    place = v.inner(3)
    return {"spans": spans, "styles": styles, "pos_x": place.plain("d"), "pos_y": place.plain("d"), "width": v.number(4, "f")}


_READERS = {TREE: _tree, NODE: _tree_node, ROOT_TEXT: _root_text} | dict.fromkeys(ITEM_TYPES, _item)


def blocks_of(content: bytes) -> Iterator[dict]:
    """The blocks of a page file. A wrong header and a block that is cut off fail; a block of other types has no values, one
    whose values cannot be read is malformed."""
    if len(content) < HEADER_BYTES or not _HEADER.fullmatch(content[:HEADER_BYTES]):
        raise Broken("not a version 6 page file")
    whole = Values(memoryview(content), HEADER_BYTES)
    number = 0
    while whole.at < whole.end:
        size, _unknown, least, current, kind = (whole.plain(f) for f in "IBBBB")
        row = {"block": number, "offset": whole.at, "size": size, "type": kind, "min_version": least, "current_version": current, "malformed": False}
        start = whole.at
        whole.take(size)
        if kind in _READERS:
            try:
                row |= _READERS[kind](Values(whole.data, start, start + size))
            except (Broken, UnicodeDecodeError):
                row["malformed"] = True
        yield row
        number += 1


#: Bytes of page files that are read together; a file's blocks stay together.
BATCH_BYTES = 8 << 20
_FEW = 32  # files that are walked one by one
_ID_ARROW = pa.struct([("p1", pa.int32()), ("p2", pa.int64())])
_SPAN = pa.struct([("item", _ID_ARROW), ("left", _ID_ARROW), ("right", _ID_ARROW), ("deleted", pa.int64()), ("text", pa.string())])
#: ``BLOCKS`` for Arrow
BLOCKS_ARROW = pa.schema([
    ("block", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("type", pa.int32()), ("min_version", pa.int32()), ("current_version", pa.int32()),
    ("malformed", pa.bool_()), *((c, _ID_ARROW) for c in ("node", "parent", "item", "left", "right")), ("deleted", pa.int64()), ("kind", pa.string()), ("value", pa.binary()),
    ("label", pa.string()), ("visible", pa.bool_()), ("anchor", _ID_ARROW), ("origin_x", pa.float64()), ("spans", pa.list_(_SPAN)),
    ("styles", pa.list_(pa.struct([("at", _ID_ARROW), ("style", pa.int32())]))), *((c, pa.float64()) for c in ("pos_x", "pos_y", "width")),
])


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, with some zeros behind them, and where each value begins; the last place is their end."""
    wide = values.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    low, high = int(ends[0]), int(ends[-1])
    data = np.zeros(high - low + 64, np.uint8)
    if high > low:
        data[: high - low] = np.frombuffer(wide.buffers()[2], np.uint8)[low:high]
    return data, ends - low


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of bytes one behind the other, and the offsets of an array of them."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def _binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    own, offsets = _gathered(data, starts, np.where(valid, sizes, 0))
    mask = pa.array(valid).buffers()[1] if len(valid) else None
    return pa.Array.from_buffers(pa.binary(), len(valid), [mask, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])


class Columns:
    """Tagged values read from many stretches at once. ``ok`` says where they were as asked for; other stretches have no meaning."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end, self.ok = data, at.copy(), end, np.ones(len(at), bool)

    def _byte(self) -> np.ndarray:
        return self.data[np.minimum(self.at, len(self.data) - 1)].astype(np.int64)

    def byte(self) -> np.ndarray:
        value = self._byte()
        self.at += 1
        return value

    def u32(self) -> np.ndarray:
        return sum(self.byte() << 8 * k for k in range(4))

    def varuint(self) -> np.ndarray:
        value, more = np.zeros(len(self.at), np.int64), np.ones(len(self.at), bool)
        for shift in range(0, 35, 7):
            read = self._byte()
            value += np.where(more, (read & 0x7F) << shift, 0)
            self.at += more
            more &= read >= 0x80
            if not more.any():
                return value
        self.ok &= ~more  # longer numbers are left to the plain reader
        return value

    def has(self, index: int, kind: int) -> np.ndarray:
        """Whether the next byte is this tag; a longer form of a tag is left to the plain reader."""
        read, there = self._byte(), self.at < self.end
        self.ok &= ~there | (read < 0x80)
        return there & (read == (index << 4 | kind))

    def tag(self, index: int, kind: int) -> None:
        self.ok &= self._byte() == (index << 4 | kind)
        self.at += 1

    def id(self, index: int) -> tuple[np.ndarray, np.ndarray]:
        self.tag(index, ID)
        return self.byte(), self.varuint()

    def inner(self, index: int) -> Columns:
        self.tag(index, BLOCK)
        size = self.u32()
        own = Columns(self.data, self.at, self.at + size)
        self.at += size
        return own

    def whole(self, *inner: Columns) -> np.ndarray:
        """Where all was as asked for and within its bounds."""
        return self.ok & (self.at <= self.end) & np.logical_and.reduce([np.ones(len(self.at), bool), *(i.whole() for i in inner)])


def _walked(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """file, block, place of the body, size, and the four bytes of the head of each block, in order; fails as ``blocks_of`` does."""
    starts, ends = places[:-1], places[1:]
    if (ends - starts < HEADER_BYTES).any():
        raise Broken("not a version 6 page file")
    heads = data[starts[:, None] + np.arange(HEADER_BYTES)].tobytes()
    if not all(_HEADER.fullmatch(h) for h in {heads[i : i + HEADER_BYTES] for i in range(0, len(heads), HEADER_BYTES)}):
        raise Broken("not a version 6 page file")
    found, files, at, number = [], np.arange(len(starts)), starts + HEADER_BYTES, 0
    while len(files := files[keep := at < ends[files]]) >= _FEW:
        head = data[(at := at[keep])[:, None] + np.arange(8)].astype(np.int64)
        size = head[:, 0] | head[:, 1] << 8 | head[:, 2] << 16 | head[:, 3] << 24
        at = at + 8
        found.append((files, np.full(len(files), number), at, size, *head[:, 5:].T))
        at, number = at + size, number + 1
        if (at > ends[files]).any():
            raise Broken("ends too early")
    at, rest = at[keep], []
    for file, place in zip(files.tolist(), at.tolist(), strict=True):
        k, end = number, int(ends[file])
        while place < end:
            if place + 8 > end:
                raise Broken("ends too early")
            size, _, least, current, kind = struct.unpack_from("<IBBBB", data, place)
            rest.append((file, k, place + 8, size, least, current, kind))
            place, k = place + 8 + size, k + 1
        if place > end:
            raise Broken("ends too early")
    found.append(tuple(np.array(rest, np.int64).reshape(-1, 7).T))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort(columns[1::-1])
    return tuple(c[order] for c in columns)


def _block_batch(content: pa.Array) -> tuple[np.ndarray, pa.Table]:
    """The file of each block, and the blocks of files as a table of ``BLOCKS``, read column by column; what a kind seldom has is left to the plain readers."""
    data, places = _bytes_of(content)
    file, number, at, size, least, current, kind = _walked(data, places)
    n = len(file)
    ids = {c: (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)) for c in ("node", "parent", "item", "left", "right")}
    deleted, visible = np.zeros(n, np.int64), np.zeros(n, bool)
    shown, value_at, value_size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    label_at, label_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    plain = np.isin(kind, list(_READERS))

    def keep(name: str, rows: np.ndarray, pair: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> None:
        for column, values in zip(ids[name], (*pair, np.ones(len(rows), bool)), strict=True):
            column[rows[which]] = values[which]

    def start(rows: np.ndarray) -> Columns:
        return Columns(data, at[rows], at[rows] + size[rows])

    rows = np.flatnonzero(kind == TREE)
    v = start(rows)
    node = v.id(1)
    v.id(2)
    v.tag(3, B1)
    v.byte()
    parent = (own := v.inner(4)).id(1)
    done = v.whole(own)
    keep("node", rows, node, done)
    keep("parent", rows, parent, done)
    plain[rows[done]] = False

    rows = np.flatnonzero(kind == NODE)
    v = start(rows)
    node = v.id(1)
    (name := v.inner(2)).id(1)
    text = name.inner(2)
    length = text.varuint()
    text.byte()
    begun = text.at.copy()
    text.at += length
    (own := v.inner(3)).id(1)
    own.tag(2, B1)
    seen = own.byte()
    done = v.whole(name, text, own) & (v.at == v.end)
    keep("node", rows, node, done)
    label_at[rows[done]], label_size[rows[done]], visible[rows[done]] = begun[done], length[done], seen[done] > 0
    plain[rows[done]] = False

    rows = np.flatnonzero(np.isin(kind, list(ITEM_TYPES)))
    v = start(rows)
    pairs = {"parent": v.id(1), "item": v.id(2), "left": v.id(3), "right": v.id(4)}
    v.tag(5, B4)
    gone, has = v.u32(), v.has(6, BLOCK)
    before = v.at.copy()
    own = Columns(data, before + 5, before + 5)
    v.at += 1
    own.end = np.where(has, before + 5 + v.u32(), own.at + 1)
    what = own.byte()
    group = Columns(data, own.at, own.end)
    node = group.id(2)
    groups = has & (what == 2)
    done = v.ok & np.where(has, (own.end <= v.end) & own.whole() & (~groups | group.whole()), before <= v.end)
    for name, pair in pairs.items():
        keep(name, rows, pair, done)
    keep("node", rows, node, done & groups)
    deleted[rows[done]] = gone[done]
    filled = done & has
    begun = np.where(groups, group.at, own.at)
    shown[rows[filled]] = np.where(np.isin(what, list(KINDS)), what, -1)[filled]
    value_at[rows[filled]], value_size[rows[filled]] = begun[filled], (own.end - begun)[filled]
    plain[rows[done]] = False

    labelled = (kind == NODE) & ~plain
    try:
        labels = _binary(data, label_at, label_size, labelled).cast(pa.string())
    except pa.ArrowInvalid:
        plain |= labelled
        labels = pa.nulls(n, pa.string())
    item = np.isin(kind, list(ITEM_TYPES))
    some = shown != 0
    names = pa.array([KINDS.get(k, "unknown") for k in range(1, 6)] + ["unknown"])
    columns = {
        "block": number, "offset": at - places[file], "size": size, "type": kind, "min_version": least, "current_version": current, "malformed": np.zeros(n, bool),
        **{c: pa.StructArray.from_arrays([pa.array(p1, pa.int32()), pa.array(p2, pa.int64())], fields=list(_ID_ARROW), mask=pa.array(~has)) for c, (p1, p2, has) in ids.items()},
        "deleted": pa.array(deleted, mask=~item), "kind": names.take(pa.array(np.where(shown > 0, shown - 1, 5), mask=~some)), "value": _binary(data, value_at, value_size, some),
        "label": labels, "visible": pa.array(visible, mask=~labelled),
    }
    table = pa.table([pa.array(columns[c], k) if isinstance(columns.get(c), np.ndarray) else columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(BLOCKS_ARROW.names, BLOCKS_ARROW.types, strict=True)], schema=BLOCKS_ARROW)
    if plain.any():
        slow = np.flatnonzero(plain)
        read = [_read_block(memoryview(data), int(at[i]), int(size[i]), int(kind[i])) for i in slow]
        head = ("block", "offset", "size", "type", "min_version", "current_version")
        rows = [dict(zip(head, map(int, h), strict=True)) | r for h, r in zip(zip(*(columns[c][slow] for c in head), strict=True), read, strict=True)]
        order = np.arange(n)
        order[slow] = n + np.arange(len(slow))
        table = pa.concat_tables([table, pa.Table.from_pylist(rows, schema=table.schema)]).take(pa.array(order))
    return file, table


def _read_block(data: memoryview, at: int, size: int, kind: int) -> dict:
    try:
        return {"malformed": False} | _READERS[kind](Values(data, at, at + size))
    except (Broken, UnicodeDecodeError):
        return {"malformed": True}


def page_blocks(files: DataFrame, keys: list[str], content: str = "bytes") -> DataFrame:
    """The ``keys`` of each file and one row per block (``BLOCKS``), in file order by ``block``. Null contents have no blocks."""
    chosen = files.select(*keys, F.col(content).alias("_content")).filter("_content is not null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("_content")
            part = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low < high:
                    file, table = _block_batch(values.slice(low, high - low))
                    own = pa.Table.from_batches([batch.slice(low, high - low)]).select(keys).take(pa.array(file))
                    for name in table.column_names:
                        own = own.append_column(table.schema.field(name), table.column(name))
                    yield from own.combine_chunks().to_batches()

    return chosen.mapInArrow(run, f"{kinds}, {BLOCKS}")


_POINT = {1: np.dtype([(n, "<f4") for n in ("x", "y", "speed", "direction", "width", "pressure")]), 2: np.dtype([("x", "<f4"), ("y", "<f4"), ("speed", "<u2"), ("width", "<u2"), ("direction", "u1"), ("pressure", "u1")])}
POINT = "struct<x:double,y:double,speed:double,direction:double,width:double,pressure:double>"
LINE = f"struct<tool:int,color:int,thickness:double,starting_length:double,marker:int,points:array<{POINT}>>"


def _marker(v: Values) -> int | None:
    """The red, green, blue and alpha bytes of a trailing colour marker as one number."""
    left = bytes(v.data[v.at : v.at + 6])
    return int.from_bytes(bytes([left[4], left[3], left[2], left[5]]), "big", signed=True) if len(left) == 6 and left[:2] in _MARKS else None


_POINT_NAMES = ("x", "y", "speed", "direction", "width", "pressure")


def line_of(value: bytes, version: int) -> tuple[tuple, np.ndarray]:
    """A stroke: tool, color, thickness, starting_length and marker, and its points, a row for each.

    Points of version 1 are floats and are scaled, those of version 2 are stored as they are.
    """
    v = Values(memoryview(value))
    head = (v.number(1), v.number(2), v.number(3, "d"), v.number(4, "f"))
    if version not in _POINT:
        raise Broken(f"unknown point version {version}")
    raw = v.inner(5).rest()
    kind = _POINT[version]
    if len(raw) % kind.itemsize:
        raise Broken("not a whole number of points")
    read = np.frombuffer(raw, kind)
    points = np.column_stack([read[n].astype(np.float64) for n in _POINT_NAMES])
    if version == 1:
        points *= (1, 1, 4, 1, 4, 255)
        points[:, 3] = 255 * points[:, 3] / (2 * np.pi)
        points[:, 4] = np.floor(points[:, 4] + 0.5)
    for index in (6, 7):
        if v.has(index, ID):
            v.id(index)
    return (*head, _marker(v)), points


GLYPH = "struct<start:bigint,length:bigint,color:int,text:string,marker:int,boxes:array<struct<x:double,y:double,w:double,h:double>>>"


def glyph_of(value: bytes) -> dict:
    """A highlighted range of text: optional start and length, colour, text and rectangles."""
    v = Values(memoryview(value))
    row = {name: v.number(index) if v.has(index, B4) else None for name, index in (("start", 2), ("length", 3))}
    row |= {"color": v.number(4), "text": v.string(5)}
    own = v.inner(6)
    boxes = [dict(zip("xywh", (own.plain("d") for _ in range(4)), strict=True)) for _ in range(own.varuint())]
    return row | {"marker": _marker(v), "boxes": boxes}


_POINT_ARROW = pa.struct([(n, pa.float64()) for n in ("x", "y", "speed", "direction", "width", "pressure")])
_ARROWS = {
    LINE: pa.struct([("tool", pa.int32()), ("color", pa.int32()), ("thickness", pa.float64()), ("starting_length", pa.float64()), ("marker", pa.int32()), ("points", pa.list_(_POINT_ARROW))]),
    GLYPH: pa.struct([("start", pa.int64()), ("length", pa.int64()), ("color", pa.int32()), ("text", pa.string()), ("marker", pa.int32()), ("boxes", pa.list_(pa.struct([(c, pa.float64()) for c in "xywh"])))]),
}


def _line_array(values: pa.Array, versions: pa.Array) -> pa.Array | None:
    """Strokes with points of version 2 and nothing behind them but one short id, read column by column; None if a value has more, less or another version."""
    gone = values.is_null().to_numpy(zero_copy_only=False)
    data, places = _bytes_of(values)
    v = Columns(data, places[:-1], places[1:])
    head = {}
    for name, index, kind, size in (("tool", 1, B4, 4), ("color", 2, B4, 4), ("thickness", 3, F64, 8), ("starting_length", 4, B4, 4)):
        v.tag(index, kind)
        head[name] = v.at.copy()
        v.at += size
    points = v.inner(5)
    v.id(6)
    size = points.end - points.at
    whole = v.whole() & (v.at == v.end) & (points.end <= v.end) & (size % _POINT[2].itemsize == 0)
    if not (gone | (whole & (pc.fill_null(versions, 0).to_numpy(zero_copy_only=False) == 2))).all():
        return None

    def column(name: str, form: str) -> np.ndarray:
        at = np.where(gone, 0, head[name])
        return data[at[:, None] + np.arange(np.dtype(form).itemsize)].copy().view(form).reshape(-1)

    numbers = {name: column(name, form) for name, form in (("tool", "<u4"), ("color", "<u4"), ("thickness", "<f8"), ("starting_length", "<f4"))}
    numbers |= {name: np.where(gone, 0, numbers[name]) for name in numbers}
    if max((int(numbers[n].max(initial=0)) for n in ("tool", "color"))) > 0x7FFFFFFF:
        return None
    heads = [pa.array(numbers[n].astype(k), mask=gone) for n, k in (("tool", "<i4"), ("color", "<i4"), ("thickness", "<f8"), ("starting_length", "<f8"))]
    raw, offsets = _gathered(data, points.at, np.where(gone, 0, size))
    read = raw.view(_POINT[2])
    columns = [pa.array(read[n].astype(np.float64)) for n in _POINT_NAMES]
    lists = pa.ListArray.from_arrays(pa.array((offsets // _POINT[2].itemsize).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_POINT_ARROW)))
    return pa.StructArray.from_arrays([*heads, pa.nulls(len(values), pa.int32()), lists], fields=list(_ARROWS[LINE]), mask=pa.array(gone))


def _line_list(values: pa.Array, versions: pa.Array) -> pa.Array:
    """The same, one value after the other; values that are no stroke fail."""
    kinds = {f.name: f.type for f in _ARROWS[LINE]}
    nothing = ((None,) * 5, np.zeros((0, len(_POINT_NAMES))))
    pairs = zip(values.to_pylist(), versions.to_pylist(), strict=True)
    found = [nothing if value is None else line_of(value, version) for value, version in pairs]
    heads = [pa.array([h[k] for h, _ in found], kinds[name]) for k, name in enumerate(("tool", "color", "thickness", "starting_length", "marker"))]
    points = np.concatenate([p for _, p in found] or [nothing[1]])
    columns = [pa.array(np.ascontiguousarray(points[:, k])) for k in range(len(_POINT_NAMES))]
    ends = np.cumsum([0, *[len(p) for _, p in found]], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_POINT_ARROW)))
    return pa.StructArray.from_arrays([*heads, lists], fields=list(_ARROWS[LINE]), mask=values.is_null())


def _lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for values, versions in batches:
        found = _line_array(values, versions)
        yield _line_list(values, versions) if found is None else found


def _glyph_or_none(value: bytes | None) -> dict | None:
    try:
        return None if value is None else glyph_of(value)
    except Broken:
        return None


def _glyphs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield pa.array([_glyph_or_none(v) for v in values.to_pylist()], _ARROWS[GLYPH])


def decoded_line(value: Column, version: Column) -> Column:
    """The stroke of a line item's value; values that are no stroke fail."""
    return F.arrow_udf(_lines, LINE)(value, version)


def decoded_glyph(value: Column) -> Column:
    """The highlight of a glyph item's value; null where it cannot be read."""
    return F.arrow_udf(_glyphs, GLYPH)(value)
