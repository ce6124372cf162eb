"""File sources and streams on small fixtures."""

import zipfile
from pathlib import Path

import pytest

from foliospark import session
from foliospark.sources import files
from foliospark.streaming import events

UUID = "0c2f5b4e-8d1a-4f7e-9a53-1b2c3d4e5f60"


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_text_inputs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("b.md", "two"), ("sub/A.MD", "é"), ("x.py", "print()"), ("y.Go", "package y"), ("none", "plain"), ("empty.py", "")):
        (tmp_path / name).write_text(text)
    assert [(r["rel_path"], r["text"]) for r in files.markdown_inputs(spark, str(tmp_path)).collect()] == [("b.md", "two"), ("sub/A.MD", "é")]
    assert [r["rel_path"] for r in files.source_inputs(spark, str(tmp_path)).collect()] == ["empty.py", "none", "x.py", "y.Go"]
    assert [r["rel_path"] for r in files.source_inputs(spark, str(tmp_path), [".go"]).collect()] == ["y.Go"]


def test_archives(spark, tmp_path):
    header = b"page lines file, version=6".ljust(43)
    archive(tmp_path / "a.rmdoc", {f"{UUID}.content": b"{}", f"{UUID}/p2.rm": header + b"xy", f"{UUID}/p1.rm": header})
    opened = files.archives(spark, str(tmp_path))
    row = opened.collect()[0]
    assert (row["uuid"], bytes(row["content"]), row["metadata"], row["pdf"]) == (UUID, b"{}", None, None)
    pages = sorted((r["page_id"], r["size"], "version=6" in r["header"]) for r in files.page_files(opened).collect())
    assert pages == [("p1", 43, True), ("p2", 45, True)]


def test_two_contents_fail(spark, tmp_path):
    archive(tmp_path / "a.zip", {"a.content": b"{}", "b.content": b"{}"})
    with pytest.raises(Exception, match="2 content files"):
        files.archives(spark, str(tmp_path)).collect()


def test_gestures_close_with_the_watermark(spark, tmp_path):
    rows = [
        (1, "2026-01-01 00:00:00.000", 1, "x", 5), (1, "2026-01-01 00:00:00.100", 2, "x", 2), (1, "2026-01-01 00:00:00.200", 3, "x", 4),
        (1, "2026-01-01 00:00:00.210", 4, "y", 9), (1, "2026-01-01 00:00:00.220", 5, "y", None), (2, "2026-01-01 00:00:00.000", 6, "y", 1),
        (1, "2026-01-01 00:00:05.000", 7, "y", 3), (1, "2026-01-01 00:00:05.050", 8, "y", 1), (3, "2026-01-01 00:01:00.000", 9, "x", 1),
    ]
    points = spark.createDataFrame(rows, "user_id int, ts string, id int, axis string, value bigint").selectExpr("user_id", "timestamp(ts) as ts", "id", "axis", "value")
    points.write.parquet(str(tmp_path / "in"))
    stream = events.gesture_stream(events.event_stream(spark, str(tmp_path / "in"), points.schema))
    got = sorted((r["user_id"], r["left"], r["right"], r["up"], r["down"]) for r in events.drained(stream).collect())
    assert got == [(1, 0, 0, 2, 0), (1, 2, 3, 0, 0)]


def test_rerun_adds_nothing(spark, tmp_path):
    reports = spark.createDataFrame([(1, 1, 1, "queued"), (1, 1, 2, "done"), (1, 2, 1, "queued")], "job_id int, item int, seq int, state string")
    reports.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a lost checkpoint makes the same batch run again
        stream = events.item_states(events.event_stream(spark, str(tmp_path / "in"), reports.schema))
        events.drain(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), "update")
    got = spark.read.parquet(str(tmp_path / "out")).select("job_id", "item", "state").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "done"), (1, 2, "queued")]


def test_empty_files_bundles_and_members(spark, tmp_path):
    import zipfile

    from foliospark.sources import files

    (tmp_path / "d/sub").mkdir(parents=True)
    for name, body in (("d/b.md", "B"), ("d/A.MD", ""), ("d/sub/c.md", "C"), ("d/x.go", ""), ("solo.md", "S")):
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert [(r["rel_path"], r["text"]) for r in files.markdown_inputs(spark, f"{root}/d").collect()] == [("A.MD", ""), ("b.md", "B"), ("sub/c.md", "C")]
    assert [r["rel_path"] for r in files.source_inputs(spark, f"{root}/d").collect()] == ["x.go"]
    rows = files.bundle_inputs(spark, [f"{root}/solo.md", " ", f"{root}/d", f"{root}/d/b.md"]).orderBy("place").collect()
    assert [(r["title"], r["text"]) for r in rows] == [("solo", "S"), ("A", ""), ("b", "B"), ("sub/c", "C")]
    with pytest.raises(ValueError):
        files.bundle_inputs(spark, [f"{root}/d/x.go"])
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("q/one.txt", "12345")
    assert [(r["member"], r["size"]) for r in files.archive_members(spark, root).collect()] == [("q/one.txt", 5)]
    (tmp_path / "m.json").write_text('[{"id": "a", "v": 1}, {"id": "b", "v": 2}]')
    assert [r["v"] for r in files.manifest_entry(spark, f"{root}/m.json", "b").collect()] == [2]


def test_shared_dir_without_a_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    first = session.shared_dir(Session())
    assert Path(first).is_dir() and session.shared_dir(Session()) == first
