"""Page files read column by column against the plain readers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliospark.sources import pagefile, pagewriter

HEAD = b"made for tests .lines file, version=6".ljust(pagefile.HEADER_BYTES)


def plain(files):
    rows = [(k, b) for k, f in enumerate(files) for b in pagefile.blocks_of(f)]
    return [k for k, _ in rows], pa.Table.from_pylist([b for _, b in rows], schema=pagefile.BLOCKS_ARROW).to_pylist()


def read(files):
    file, table = pagefile._block_batch(pa.array(files, pa.binary()))
    return file.tolist(), table.to_pylist()


def some_block(draw):
    w, number = pagewriter, draw.choice([0, 5, 127, 128, 1 << 20, 1 << 40])
    points = [{"x": draw.random(), "y": 1.0, "width": 3.0} for _ in range(draw.randint(0, 3))]
    tail = w.ident(1, (0, 1)) + w.tagged(2, w.B1, bytes([draw.randint(0, 2)]))
    about = w.ident(1, (3, number)) + w.inner(2, w.ident(1, (0, 1)) + w.string(2, draw.choice(["", "é", "layer"]))) + w.inner(3, tail)
    return draw.choice([
        w.layer(draw.choice(["", "layer 1", "ü"])), w.stroke(number, 17, 2, 1.5, points), w.block(9, b"abc"), w.block(7, b"\x1f"), w.block(2, about),
        w.block(2, about + w.inner(7, w.ident(1, (0, 1)) + w.ident(2, (1, 9)))), w.block(3, w.item((0, 11), (1, number), 1, b"glyph")), w.block(6, w.item((0, 11), (1, 2), 9, b"")),
        w.block(8, w.item((0, 11), (1, number), 2, b"")[:-6]), w.block(4, w.item((0, 1), (2, 2), 2, w.ident(2, (9, number)) + b"rest")), w.block(5, b""), w.block(1, b""),
    ])


def test_blocks_by_columns_equal_plain_blocks():
    """Blocks of all types, with bytes cut off, changed and added inside them, in files of few and of many blocks."""
    draw, files = random.Random(7), []
    for k in range(600):
        out = bytearray(HEAD)
        for _ in range(draw.choice([0, 1, 4, 60 if k % 50 == 0 else 9])):
            raw = bytearray(some_block(draw))
            if draw.random() < 0.5 and len(raw) < 120:
                body = raw[8:]
                for _ in range(draw.randint(0, 2)):
                    if body:
                        i = draw.randrange(len(body))
                        body[i : i + draw.randint(0, 2)] = bytes(draw.choices([0, 1, 2, 0x1F, 0x2F, 0x6C, 0x80, 0xEC, 255], k=draw.randint(0, 2)))
                raw = bytearray(pagewriter.block(raw[7], bytes(body)))
            out += raw
        files.append(bytes(out))
    for part in (files, files[:5], files[:1], []):
        try:
            want = plain(part)
        except (pagefile.Broken, pa.ArrowInvalid) as e:
            pytest.fail(f"the files are not whole: {e}")
        assert read(part) == want
    kinds = {(b["type"], b["malformed"]) for b in want[1]} | {(b["type"], b["malformed"]) for b in plain(files)[1]}
    assert {(t, m) for t in (1, 2, 3, 4, 5, 6) for m in (True, False)} <= kinds


@pytest.mark.parametrize("bad", [b"", HEAD[:-1], b"x" * 43, HEAD + b"\1", HEAD + pagewriter.block(5, b"abc")[:-1], HEAD + b"\0" * 8 + b"\xff" * 8])
@pytest.mark.parametrize("others", [0, 50])
def test_broken_files_fail(bad, others):
    files = [HEAD + pagewriter.layer("a")] * others + [bad]
    with pytest.raises(pagefile.Broken):
        plain(files)
    with pytest.raises(pagefile.Broken):
        read(files)


def test_strokes_by_columns_equal_plain_strokes():
    draw = random.Random(3)
    values = [pagewriter.stroke(3, k % 30, k % 9, k / 7, [{"x": draw.random(), "y": -k, "width": k} for _ in range(k % 5)]) for k in range(60)]
    values = [next(pagefile.blocks_of(HEAD + v))["value"] for v in values] + [None]
    a, versions = pa.array(values, pa.binary()), pa.array([2] * 60 + [None], pa.int32())
    want = pagefile._line_list(a, versions)
    for low, n in ((0, 61), (7, 20), (0, 0), (60, 1)):
        assert pagefile._line_array(a.slice(low, n), versions.slice(low, n)).to_pylist() == want.slice(low, n).to_pylist()
    for other in (values[5] + b"\x84\x01abcd", values[5][:-3], values[5] + b"x", b"", values[5][:30], b"\x14\xff\xff\xff\xff" + values[5][5:]):
        assert pagefile._line_array(pa.array([other], pa.binary()), pa.array([2], pa.int32())) is None
    assert pagefile._line_array(pa.array(values[:1], pa.binary()), pa.array([1], pa.int32())) is None
    assert np.isfinite(want.field("points").flatten().field("x").to_numpy()).all()
