"""Sequence order by joins against plain peeling of layers."""

import random

import pytest

from foliospark.operators import sequences

SCHEMA = "seq_id int, p1 int, p2 int, left_p1 int, left_p2 int, right_p1 int, right_p2 int, left_q int"


def plain_order(rows):
    ids = {r[:2] for r in rows}
    before = {i: set() for i in ids}
    for p1, p2, l1, l2, r1, r2 in rows:
        if (l1, l2) in ids:
            before[p1, p2].add((l1, l2))
        if (r1, r2) in ids:
            before[r1, r2].add((p1, p2))
    out = []
    while before:
        ready = sorted(i for i, b in before.items() if not b)
        if not ready:
            return None
        out += ready
        before = {i: b - set(ready) for i, b in before.items() if b}
    return out


def ordered(spark, sequences_by_id):
    rows = [(k, *r, 7) for k, rows in sequences_by_id.items() for r in rows]
    found = sequences.sequence_order(spark.createDataFrame(rows, SCHEMA)).orderBy("seq_id", "place").collect()
    out = {}
    for r in found:
        assert r["place"] == len(out.setdefault(r["seq_id"], []))
        out[r["seq_id"]].append((r["p1"], r["p2"]))
    return out


def edited(draw, n):
    """A text typed in runs, at random places: each item between the neighbours that it was typed between."""
    text, rows, at = [], [], 0
    for k in range(n):
        if draw.random() < 0.05:
            at = draw.randint(0, len(text))
        own = (draw.randint(1, 2), k + 10)
        left, right = (text[at - 1] if at else (0, 0)), (text[at] if at < len(text) else (0, 0))
        rows.append((*own, *left, *right))
        text.insert(at, own)
        at += 1
    draw.shuffle(rows)
    return rows


def test_equals_plain_peeling(spark):
    draw = random.Random(5)
    made = {k: edited(draw, draw.randint(1, 60)) for k in range(12)}
    made[50] = [(1, k, 1, k - 1, None, None) for k in range(1, 2500)]  # one straight run
    made[51] = [(1, k, 1, draw.randint(0, k - 1), None, None) for k in range(1, 80)] + [(1, k, None, None, 1, draw.randint(k + 1, 99)) for k in range(80, 95)]
    assert ordered(spark, made) == {k: plain_order(rows) for k, rows in made.items()}


def test_repeated_items_nulls_and_empty(spark):
    assert ordered(spark, {}) == {}
    assert ordered(spark, {1: [(1, 2, None, None, None, None)] * 3 + [(1, 1, 9, 9, 1, 2)]}) == {1: [(1, 1), (1, 2)]}
    row = spark.createDataFrame([(None, 1, 2, 1, 1, None, None, 0), (None, 1, 1, None, None, None, None, 0)], SCHEMA)
    assert [r["p2"] for r in sequences.sequence_order(row).orderBy("place").collect()] == [1, 2]


@pytest.mark.parametrize("rows", [
    [(1, 1, 1, 2, None, None), (1, 2, 1, 1, None, None)], [(1, 1, 1, 1, None, None)],
    [(1, 1, 1, 3, None, None), (1, 2, 1, 1, None, None), (1, 3, 1, 2, None, None), (1, 4, 1, 2, None, None)],
])
def test_cycles_fail(spark, rows):
    assert plain_order(rows) is None
    with pytest.raises(ValueError, match="cycle"):
        ordered(spark, {1: rows})
