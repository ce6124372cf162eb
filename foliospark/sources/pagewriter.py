"""Page files from strokes: the blocks that ``pagefile`` reads, for exports and for tests of round trips."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.sources.pagefile import B1, B4, BLOCK, F64, HEADER_BYTES, ID, NODE, TREE

LAYER, ROOT = (0, 11), (0, 1)


def varuint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def tagged(index: int, kind: int, body: bytes) -> bytes:
    return varuint(index << 4 | kind) + body


def ident(index: int, own: tuple[int, int]) -> bytes:
    return tagged(index, ID, bytes([own[0]]) + varuint(own[1]))


def inner(index: int, body: bytes) -> bytes:
    return tagged(index, BLOCK, struct.pack("<I", len(body)) + body)


def string(index: int, text: str) -> bytes:
    raw = text.encode()
    return inner(index, varuint(len(raw)) + bytes([raw.isascii()]) + raw)


def block(kind: int, body: bytes, version: int = 2) -> bytes:
    return struct.pack("<IBBBB", len(body), 0, 1, version, kind) + body


def layer(name: str) -> bytes:
    """One layer below the root: its place, its name and the item that shows it."""
    stamp = ident(1, (0, 1))
    place = ident(1, LAYER) + ident(2, (0, 0)) + tagged(3, B1, b"\1") + inner(4, ident(1, ROOT))
    about = ident(1, LAYER) + inner(2, stamp + string(2, name)) + inner(3, stamp + tagged(2, B1, b"\1"))
    shown = item(ROOT, (1, 1), 2, ident(2, LAYER))
    return block(TREE, place) + block(NODE, about) + block(4, shown)


def item(parent: tuple[int, int], own: tuple[int, int], kind: int, value: bytes) -> bytes:
    ends = ident(3, (0, 0)) + ident(4, (0, 0)) + tagged(5, B4, struct.pack("<I", 0))
    return ident(1, parent) + ident(2, own) + ends + inner(6, bytes([kind]) + value)


def stroke(number: int, tool: int, color: int, thickness: float, points: list[dict]) -> bytes:
    body = tagged(1, B4, struct.pack("<I", tool)) + tagged(2, B4, struct.pack("<I", color)) + tagged(3, F64, struct.pack("<d", thickness))
    raw = b"".join(struct.pack("<ffHHBB", p["x"], p["y"], 0, int(p["width"]), 0, 255) for p in points)
    body += tagged(4, B4, struct.pack("<f", 0.0)) + inner(5, raw) + ident(6, (0, 1))
    return block(5, item(LAYER, (1, 2 + number), 3, body))


STROKES = "array<struct<tool:int,color:int,thickness:double,points:array<struct<x:double,y:double,width:double>>>>"


def _head(title: str | None) -> bytes:
    return f"{title or ''} .lines file, version=6".encode().ljust(HEADER_BYTES)[:HEADER_BYTES]


#: rows that are placed at once, which bounds the index arrays
_PLACED = 1 << 18


def _place(out: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
    """Write rows of bytes, all of one length, to their places."""
    for i in range(0, len(starts), _PLACED):
        out[starts[i : i + _PLACED, None] + np.arange(rows.shape[1])] = rows[i : i + _PLACED]


def _plain_numbers(arrays: list[pa.Array]) -> list[np.ndarray] | None:
    return None if any(a.null_count for a in arrays) else [a.to_numpy(zero_copy_only=False) for a in arrays]


def _file_array(titles: pa.Array, drawings: pa.Array) -> pa.Array | None:
    """The files of a batch, written column by column; None where a value is null or does not fit its place, or the files are too large for one array."""
    tool, color, thickness, lists = drawings.flatten().flatten()
    x, y, width = lists.flatten().flatten()
    heads, dots = _plain_numbers([tool, color, thickness]), _plain_numbers([x, y, width])
    if heads is None or dots is None or lists.null_count:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        narrow = [d.astype("<f4") for d in dots[:2]]
        whole = np.trunc(dots[2])
    if any((n < 0).any() for n in heads[:2]) or not ((whole >= 0) & (whole <= 0xFFFF)).all() or any((np.isinf(n) & ~np.isinf(d)).any() for n, d in zip(narrow, dots, strict=False)):
        return None
    per_file = pc.fill_null(pc.list_value_length(drawings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_points = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(per_file)
    file_of = np.repeat(np.arange(len(per_file)), per_file)
    number = np.arange(len(file_of)) - (ends - per_file)[file_of]
    digits = np.ones(len(number), np.int64)
    for shift in range(7, 35, 7):
        digits += (number + 2) >> shift > 0
    # a stroke is a block whose bytes but for its numbers are those of an empty one
    bare = {d: stroke((1 << 7 * (d - 1)) - 2 if d > 1 else 0, 0, 0, 0.0, []) for d in np.unique(digits)}
    size = np.array([len(bare.get(d, b"")) for d in range(7)])[digits] + 14 * n_points
    front = np.frombuffer(layer("layer 1"), np.uint8)
    file_size = np.bincount(file_of, weights=size, minlength=len(per_file)).astype(np.int64) + HEADER_BYTES + len(front)
    offsets = np.concatenate([[0], np.cumsum(file_size)])
    if offsets[-1] >= 1 << 31:
        return None
    out = np.zeros(offsets[-1], np.uint8)
    names = titles.dictionary_encode()
    known = [_head(t) for t in [*names.dictionary.to_pylist(), None]]
    which = pc.fill_null(names.indices, len(known) - 1).to_numpy(zero_copy_only=False)
    _place(out, offsets[:-1], np.frombuffer(b"".join(known), np.uint8).reshape(-1, HEADER_BYTES)[which])
    _place(out, offsets[:-1] + HEADER_BYTES, np.broadcast_to(front, (len(per_file), len(front))))
    before = np.cumsum(size) - size
    first = np.concatenate([before, [0]])[np.minimum(ends - per_file, len(before))] if len(before) else np.zeros(len(per_file), np.int64)
    at = offsets[file_of] + HEADER_BYTES + len(front) + before - first[file_of]
    point_at = np.zeros(len(at), np.int64)
    for d, plain in bare.items():
        mine = np.flatnonzero(digits == d)
        rows = np.tile(np.frombuffer(plain, np.uint8), (len(mine), 1))
        tail = len(plain) - len(ident(6, (0, 1)))

        def put(place: int, values: np.ndarray, form: str, rows: np.ndarray = rows) -> None:
            rows[:, place : place + np.dtype(form).itemsize] = values.astype(form)[:, None].view(np.uint8)

        more = 14 * n_points[mine]
        item_at = 8 + 3 + 2  # behind the block's header, its parent, and the tag and first number of its own id
        for k in range(d):
            rows[:, item_at + k] = (number[mine] + 2 >> 7 * k & 0x7F) | (0x80 if k < d - 1 else 0)
        inner_at = item_at + d + 3 + 3 + 5
        put(0, len(plain) - 8 + more, "<u4")
        put(inner_at + 1, len(plain) - inner_at - 5 + more, "<u4")
        value_at = inner_at + 6
        put(value_at + 1, heads[0][mine], "<u4")
        put(value_at + 6, heads[1][mine], "<u4")
        put(value_at + 11, heads[2][mine], "<f8")
        put(tail - 4, more, "<u4")
        _place(out, at[mine], rows[:, :tail])
        _place(out, at[mine] + tail + more, rows[:, tail:])
        point_at[mine] = at[mine] + tail
    points = np.zeros(len(dots[0]), [("x", "<f4"), ("y", "<f4"), ("speed", "<u2"), ("width", "<u2"), ("direction", "u1"), ("pressure", "u1")])
    points["x"], points["y"], points["width"], points["pressure"] = *narrow, whole, 255
    within = np.arange(len(points)) - np.repeat(np.cumsum(n_points) - n_points, n_points)
    _place(out, np.repeat(point_at, n_points) + 14 * within, points.view(np.uint8).reshape(-1, 14))
    return pa.Array.from_buffers(pa.binary(), len(per_file), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _file_list(titles: pa.Array, drawings: pa.Array) -> pa.Array:
    """The same, one value after the other; values that do not fit their places fail."""
    out = []
    for title, strokes in zip(titles.to_pylist(), drawings.to_pylist(), strict=True):
        body = b"".join(stroke(i, s["tool"], s["color"], s["thickness"], s["points"]) for i, s in enumerate(strokes or []))
        out.append(_head(title) + layer("layer 1") + body)
    return pa.array(out, pa.binary())


def _files(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for titles, drawings in batches:
        found = _file_array(titles, drawings)
        yield _file_list(titles, drawings) if found is None else found


def page_file(strokes: Column, title: str) -> Column:
    """The bytes of a page file of one layer with these strokes (``STROKES``); null strokes are an empty page.

    ``title`` is the product's name at the beginning of the header: 3 to 18 characters.
    """
    return F.arrow_udf(_files, "binary")(F.lit(title), strokes)
