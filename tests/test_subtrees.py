"""Intervals, deletion orders and hashed snapshots against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import ranks, subtrees, tree
from foliospark.session import new_path

ENTRIES = "id string, parent_id string, type string"


def children_of(rows):
    ids, found = {r[0] for r in rows}, {}
    for i, up, *_ in rows:
        found.setdefault(up if up in ids else "", []).append(i)
    return {k: sorted(v) for k, v in found.items()}


def postorder(kids, top=""):
    """Iterative, since trees here are deeper than Python's stack."""
    out, todo = [], [(k, False) for k in reversed(kids.get(top, []))]
    while todo:
        i, done = todo.pop()
        if done:
            out.append(i)
        else:
            todo.append((i, True))
            todo.extend((k, False) for k in reversed(kids.get(i, [])))
    return out


def trees():
    draw = random.Random(3)
    wide = [("f", "", "CollectionType")] + [(f"d{k}", "f", "DocumentType") for k in range(700)]
    deep = [(f"n{k:04d}", f"n{k - 1:04d}" if k else "", "CollectionType") for k in range(1500)]
    mixed = [(f"m{k}", draw.choice(["", "gone", *[f"m{j}" for j in range(k)]]), "CollectionType") for k in range(300)]
    return {"wide": wide, "deep": deep, "mixed": mixed, "one": [("a", "", "DocumentType")], "empty": []}


@pytest.mark.parametrize("name", ["wide", "deep", "mixed", "one", "empty"])
def test_intervals_equal_recursion(spark, name):
    rows = trees()[name]
    found = {r["id"]: r for r in subtrees.intervals(spark.createDataFrame(rows, ENTRIES)).collect()}
    kids = children_of(rows)
    assert sorted(found, key=lambda i: found[i]["last"]) == postorder(kids)
    draw = random.Random(1)
    for top in draw.sample(sorted(found), min(12, len(found))):
        inside = {i for i in found if found[top]["first"] <= found[i]["last"] <= found[top]["last"]}
        assert inside == {*postorder(kids, top), top} and found[top]["size"] == len(inside)


def test_cycle_fails(spark):
    with pytest.raises(ValueError, match="cycle"):
        subtrees.intervals(spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("c", "a", "x")], ENTRIES))


def plain_delete(rows, selected):
    kids, out = children_of([r for r in rows if r[0] != "trash"]), []
    for i in selected:
        out += [k for k in (*postorder(kids, i), i) if k not in out]
    return out


@pytest.mark.parametrize("selected", [["m3"], ["m250", "m3", "m0", "m3"], ["m0", "m9", "m4"], ["m299", "m298", "m1"]])
def test_delete_order_equals_recursion(spark, selected):
    rows = [*trees()["mixed"], ("trash", "", "CollectionType")]
    chosen = spark.createDataFrame([(i, k) for k, i in enumerate(selected)], "id string, rank int")
    plan = subtrees.delete_order(spark.createDataFrame(rows, ENTRIES), chosen).orderBy("place").collect()
    assert [r["id"] for r in plan] == plain_delete(rows, selected) and [r["place"] for r in plan] == list(range(len(plan)))


@pytest.mark.parametrize(("selected", "recursive", "message"), [
    ([], True, "nothing"), ([""], True, "trash"), (["a", "trash"], True, "trash"), (["a", "zz"], True, "not exist"), (["a"], False, "not empty"), ([None], True, "trash"),
])
def test_delete_checks_come_first(spark, selected, recursive, message):
    entries = spark.createDataFrame([("a", "", "CollectionType"), ("b", "a", "DocumentType"), ("trash", "", "CollectionType")], ENTRIES)
    with pytest.raises(ValueError, match=message):
        subtrees.delete_order(entries, spark.createDataFrame([(i, 0) for i in selected], "id string, rank int"), recursive)


def test_delete_without_recursion(spark):
    entries = spark.createDataFrame([("a", "", "CollectionType"), ("b", "a", "DocumentType"), ("c", "", "CollectionType")], ENTRIES)
    plan = subtrees.delete_order(entries, spark.createDataFrame([("c", 2), ("b", 1)], "id string, rank int"), recursive=False)
    assert [r["id"] for r in plan.orderBy("place").collect()] == ["b", "c"]


def test_prefix_sums_of_ties(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(1000)], "a int, b int").repartition(7)
    found = ranks.prefix_sums(rows, [F.col("a"), F.col("b")], F.lit(1)).collect()
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["before"])] == sorted((k % 3, k) for k in range(1000))


def test_changed_entries_equal_snapshot_delta(spark):
    draw = random.Random(8)
    old = [(f"e{k}", draw.choice(["", *[f"e{j}" for j in range(k)]]), f"h{k}") for k in range(250)]
    new = [r for r in old if r[0] not in {"e7", "e240", "e100"}]
    new = [(i, "" if up in {"e7", "e100"} and draw.random() < 0.5 else up, "other" if i in {"e3", "e200", "e249"} else h) for i, up, h in new]
    new = [(i, "e2" if i == "e150" else up, h) for i, up, h in new] + [("new1", "e5", "x"), ("new2", "new1", None)]
    frames = []
    for name, rows in (("old", old), ("new", new)):
        path = new_path(spark, f"snapshot-{name}")
        subtrees.write_snapshot(spark.createDataFrame(rows, "id string, parent_id string, hash string"), path)
        frames.append(spark.read.parquet(path))
    got = {tuple(r) for r in subtrees.changed_entries(*frames).collect()}
    pair = [spark.createDataFrame(rows, "id string, parent_id string, hash string") for rows in (old, new)]
    assert got == {tuple(r) for r in tree.snapshot_delta(*pair).collect()}
    assert subtrees.changed_entries(frames[0], frames[0]).count() == 0


def test_unchanged_folders_are_not_read(spark):
    """Files of folders that did not change can be gone."""
    rows = [(f"f{k}", "", "h") for k in range(40)] + [(f"d{k}-{j}", f"f{k}", "h") for k in range(40) for j in range(5)]
    later = [(i, up, "new" if i == "d3-2" else h) for i, up, h in rows]
    frames = []
    for part in (rows, later):
        path = new_path(spark, "snapshot")
        subtrees.write_snapshot(spark.createDataFrame(part, "id string, parent_id string, hash string"), path)
        needed = {spark.range(1).select(subtrees._part(F.lit(f))).first()[0] for f in ("", "f3", "d3-2")}
        assert spark.read.parquet(path).select("part").distinct().count() > len(needed)
        frames.append(spark.read.option("basePath", path).schema(spark.read.parquet(path).schema).parquet(*[f"{path}/part={p}" for p in needed if spark.read.parquet(path).filter(F.col("part") == p).count()]))
    assert [tuple(r) for r in subtrees.changed_entries(*frames).collect()] == [("d3-2", "changed")]
