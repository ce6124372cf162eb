"""Unit cases with hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import ink, text
from foliospark.operators import pages, sequences, sync, tree, usage

SCHEMA = "id string, parent_id string, name string, type string"
ROWS = [
    ("w", "", "Wörk", tree.FOLDER), ("l1", "w", "logs", tree.FOLDER), ("l2", "w", "logs", tree.FOLDER), ("d1", "l1", "", tree.FOLDER),
    ("e", "d1", "Überblick März", tree.DOCUMENT), ("f", "l2", "log-map", tree.DOCUMENT), ("k", "l2", "sketch", tree.TEMPLATE), ("kk", "k", "under a template", tree.DOCUMENT),
    ("lost", "nowhere", "stray", tree.DOCUMENT), ("q", "l2", "no kind", None), ("c1", "c3", "one", tree.FOLDER), ("c2", "c1", "two", tree.FOLDER), ("c3", "c2", "three", tree.FOLDER),
    ("on", "c2", "hangs on a cycle", tree.DOCUMENT), ("trash", "", "trash", tree.FOLDER), ("t1", "trash", "old", tree.FOLDER), ("t2", "t1", "older", tree.DOCUMENT),
]


def test_walk(spark):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    paths = {r["id"]: r["path"] for r in tree.walk(entries).collect()}
    assert paths == {
        "w": "/Wörk", "l1": "/Wörk/logs", "l2": "/Wörk/logs", "d1": "/Wörk/logs/", "e": "/Wörk/logs//Überblick März", "f": "/Wörk/logs/log-map",
        "lost": "/stray", "q": "/Wörk/logs/no kind",
    }
    assert tree.walk(entries, include_templates=True).count() == 10
    assert {r["id"] for r in tree.cycles(entries).collect()} == {"c1", "c2", "c3", "on"}


def test_ranked_search(spark):
    walked = tree.walk(spark.createDataFrame(ROWS, SCHEMA))
    assert [(r["id"], r["score"]) for r in tree.ranked_search(walked, "LOGS ").collect()][:2] == [("l1", 1005), ("l2", 1005)]
    assert tree.ranked_search(walked, "lgmp").first()["id"] == "f"
    blank = tree.ranked_search(walked, " ", 3).collect()
    assert [r["path"] for r in blank] == ["/Wörk", "/Wörk/logs", "/Wörk/logs"] and {r["score"] for r in blank} == {0}


def test_changes(spark):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    moved = {r["id"]: r["parent_id"] for r in tree.move(entries, "l1", "l2").collect()}
    assert len(moved) == len(ROWS) and moved["l1"] == "l2" and moved["t2"] == "t1"  # nothing is lost, hidden or not
    for bad in (("w", "d1"), ("e", "f"), ("nobody", "w"), ("lost", "nowhere"), ("c1", "c2")):
        with pytest.raises(ValueError):
            tree.move(entries, *bad)
    with pytest.raises(ValueError):
        tree.rename(entries, "q", " log-map ")
    assert {r["id"]: r["name"] for r in tree.rename(entries, "q", " fine ").collect()}["q"] == "fine"
    assert tree.at_path(tree.walk(entries), F.lit("/Wörk/x/../logs/./log-map")).first()["id"] == "f"


def test_very_deep_chain(spark):
    rows = [(str(i), str(i - 1) if i else "", f"d{i}", tree.FOLDER) for i in range(300)]
    entries = spark.createDataFrame(rows, SCHEMA)
    assert tree.walk(entries).agg(F.max("depth")).first()[0] == 300 and tree.cycles(entries).isEmpty()


def test_deep_chain(spark):
    rows = [(str(i), str(i - 1) if i else "", f"d{i}", tree.FOLDER) for i in range(40)]
    assert tree.walk(spark.createDataFrame(rows, SCHEMA)).agg(F.max("depth")).first()[0] == 40


@pytest.mark.parametrize(
    ("raw", "want"), [("A b  c", "A_b_c"), ("--x__y--", "x_y"), ("", "document"), (None, "document"), ("é/ü", "document")]
)
def test_safe_name(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.safe_name(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(
    ("raw", "want"), [("---\na: 1\n---\nbody", "body"), ("---\na: 1\nbody", "---\na: 1\nbody"), ("x\n---\n", "x\n---\n"), ("---\n---\n", "")]
)
def test_front_matter(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(text.without_front_matter(F.col("x"))).first()[0] == want


def test_gap_is_strict(spark):
    rows = [("s", i, f"2024-01-01 00:{m}", "k", "c", None) for i, m in enumerate(["00:00", "02:00", "04:01"])]
    calls = spark.createDataFrame(rows, "session_id string, id int, ts string, kind string, command string, success string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = usage.sequences(calls, 120_000).collect()
    assert [(r["calls"], r["failed"]) for r in found] == [(2, 2)]


def test_page_plan(spark):
    new = {"fileType": "pdf", "cPages": {"pages": [{"id": "a", "redir": {"value": 4}}, {"id": "b", "deleted": {"value": 1}}, {"id": "c"}]}}
    rows = [(1, json.dumps(new)), (2, '{"pageCount":2,"pages":["z"]}'), (3, '{"pageCount":0}'), (4, None)]
    found = pages.page_plan(spark.createDataFrame(rows, "doc int, content string")).orderBy("doc", "page_index").collect()
    assert [(r["doc"], r["page_index"], r["page_id"], r["source_page"]) for r in found] == [(1, 0, "a", 4), (1, 1, "c", -1), (2, 0, "z", 0), (2, 1, "1", 1)]


def test_selection():
    assert pages.parse_selection("1,3-4,1", 5) == [1, 3, 4, 1]
    assert pages.parse_selection(" ", 2) == [1, 2]
    for bad in ("0", "3-2", "9"):
        with pytest.raises(ValueError):
            pages.parse_selection(bad, 5)


def test_sequence_order(spark):
    schema = "seq_id int, p1 int, p2 int, left_p1 int, left_p2 int, right_p1 int, right_p2 int"
    rows = [
        (4, 2, 30, None, None, 2, 31), (4, 2, 31, 2, 30, 3, 1), (4, 3, 1, 2, 31, None, None), (4, 2, 40, 2, 30, 2, 31), (4, 1, 99, 2, 30, 2, 31),
        (5, 1, 1, 8, 8, 8, 9), (5, 1, 2, 1, 1, None, None),
    ]
    found = sequences.sequence_order(spark.createDataFrame(rows, schema)).orderBy("seq_id", "place").collect()
    assert [(r["p1"], r["p2"]) for r in found] == [(2, 30), (1, 99), (2, 40), (2, 31), (3, 1), (1, 1), (1, 2)]
    loop = spark.createDataFrame([(1, 1, 1, 1, 2, None, None), (1, 1, 2, 1, 1, None, None)], schema)
    with pytest.raises(Exception, match="cycle"):
        sequences.sequence_order(loop).collect()


def test_page_joins(spark):
    plan = spark.createDataFrame([("d", 0, "a", -1), ("d", 1, "b", 2), ("d", 2, "c", 2), ("e", 0, "z", -1)], "doc string, page_index int, page_id string, source_page int")
    source = spark.createDataFrame([("d", 1, 10.0, 20.0), ("d", 3, 30.0, 40.0), ("e", 1, 5.0, 6.0)], "doc string, number int, width double, height double")
    got = [(r["doc"], r["page_index"], r["blank"], r["width"]) for r in pages.joined_to_source(plan, source).orderBy("doc", "page_index").collect()]
    assert got == [("d", 0, True, 30.0), ("d", 1, False, 30.0), ("d", 2, False, 30.0), ("e", 0, True, 5.0)]
    files = spark.createDataFrame([("d", "a", "V6", b"1"), ("d", "b", "V5", b"2")], "doc string, page_id string, version string, bytes binary")
    assert {r["page_id"]: r["bytes"] and bytes(r["bytes"]) for r in pages.joined_to_page_files(plan, files).collect()} == {"a": b"1", "b": None, "c": None, "z": None}


def test_unequal_page_counts(spark):
    schema = "doc_id int, page int, cells array<string>, text string"
    a = spark.createDataFrame([(1, 0, ["x"], "x"), (2, 0, ["y"], "y"), (2, 1, ["y"], "y")], schema)
    b = spark.createDataFrame([(1, 0, ["x"], "x"), (2, 0, ["y"], "y"), (3, 0, ["y"], "y")], schema)
    got = {r["doc_id"]: (r["match"], r["max_ratio"], r["pages"]) for r in pages.compare_documents(a, b).collect()}
    assert got == {1: (True, 0.0, 1), 2: (False, 1.0, 0), 3: (False, 1.0, 0)}
    assert pages.parse_page_list(" ,") == [1] and pages.parse_page_list("3, 1") == [3, 1]


def test_executed_plan(spark):
    planned = spark.createDataFrame([("a", "upload"), ("b", "upload"), ("c", "stale"), ("d", "orphan"), ("e", "skip")], "key string, action string")
    attempts = spark.createDataFrame([("a", "convert", None), ("b", "upload", "x"), ("b", "convert", "y"), ("c", "delete", "z"), ("e", "upload", "q")], "key string, phase string, error string")
    forced = {r["key"]: (r["outcome"], r["phase"]) for r in sync.executed(planned, attempts, True).collect()}
    assert forced == {"a": ("uploaded", None), "b": ("failed", "convert"), "c": ("failed", "delete"), "d": ("deleted", None), "e": ("none", None)}
    assert tuple(sync.failures_by_phase(sync.executed(planned, attempts, True)).first()) == (2, 1, 0, 1)
    assert {r["key"]: r["outcome"] for r in sync.executed(planned, attempts).collect()}["c"] == "skipped"


def test_put(spark):
    schema = "parent_id string, name string, content string, meta string"
    old = spark.createDataFrame([("p", "a", "1", "m"), ("p", "b", "2", "n")], schema)
    new = spark.createDataFrame([("p", "a", "9", "x", "pdf"), ("p", "c", "8", "y", "pdf")], schema + ", ext string")
    rows = lambda **how: sorted(map(tuple, sync.put(old, new, **how).collect()))
    assert rows() == [("p", "a", "1", "m", "refused: exists"), ("p", "b", "2", "n", "kept"), ("p", "c", "8", "y", "added")]
    assert rows(force=True)[0] == ("p", "a", "9", "x", "replaced") and rows(content_only=True)[0] == ("p", "a", "9", "m", "content replaced")
    with pytest.raises(ValueError):
        sync.put(old, new, force=True, content_only=True)


def test_numbered_sequences(spark):
    runs = spark.createDataFrame([(f"s{i % 7}", f"t{i:03}", 0) for i in range(90)], "session_id string, first_ts string, run int")
    got = [(r["session_id"], r["first_ts"]) for r in usage.numbered_sequences(runs).orderBy("number").collect()]
    assert got == sorted(got) and len(got) == 90


def test_sync_plan(spark):
    local = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "key string, modified int")
    remote = spark.createDataFrame([("a", False, 1), ("c", True, 9), ("z", False, 1)], "key string, is_dir boolean, modified int")
    assert {r["key"]: r["action"] for r in sync.plan(local, remote).collect()} == {"a": "skip", "b": "upload", "c": "stale", "z": "orphan"}
    assert {r["key"]: r["action"] for r in sync.plan(local, remote, True).collect()}["a"] == "stale"


def test_upsert_twice(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, sync.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    forced = sync.upsert(old, new, ["k"], force=True)
    assert sorted(map(tuple, sync.upsert(forced, new, ["k"], force=True).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_empty_points(spark):
    df = spark.sql("select array() :: array<struct<x double, y double>> p".replace("array() ::", "cast(array() as").replace("> p", ">) p"))
    assert df.select(ink.points_box(F.col("p"))).first()[0] is None
