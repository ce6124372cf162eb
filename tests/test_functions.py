"""Rules of small functions, each on values at their edges."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import ink, markdown, text
from foliospark.operators import pages, reports, sync, tree
from foliospark.sources import files
from foliospark.streaming import events


def values(spark, kind, given, *columns):
    """The columns' values for each given value of ``v``."""
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, v {kind}")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_text_rules(spark):
    v = F.col("v")
    assert [tuple(r) for r in values(spark, "string", ["", "a", "ab\ncd\n", "é"], text.text_counts(v))] == [(0, 0), (2, 1), (7, 3), (2, 1)]
    same = values(spark, "string", ["a b", " a\r\n\tb ", "ab", "A b"], text.comparable_sha(v))
    assert same[0] == same[1] and len(set(same)) == 3
    assert values(spark, "string", ["a.GO", "x/b.go", "c.go.txt", "go", ""], text.extension_allowed(v, [" .go ", ""])) == [True, True, False, False, False]
    assert values(spark, "string", ["a.txt"], text.extension_allowed(v, [" "])) == [True]
    assert values(spark, "string", ["a", "a.PDF", " b.pdf ", "pdf", ""], text.ensure_pdf(v)) == ["a.pdf", "a.PDF", "b.pdf", "pdf.pdf", ".pdf"]
    assert values(spark, "string", ["/x/Plan.v1.MD", "b", "/x/c.md/"], text.pdf_name(v, 3)) == ["Plan.v1.pdf", "b.pdf", "c.pdf"]
    assert values(spark, "string", ["/x/a.md"], text.pdf_name(v, 1, " own ")) == ["own.pdf"]
    for total, name in ((2, "own"), (1, "a/b"), (1, "a\\b")):
        with pytest.raises(ValueError):
            text.pdf_name(v, total, name)


def test_media_types(spark):
    rows = [
        (b"\x89PNG\r\n", "a.jpg"), (b"\xff\xd8\xff\xe0", "x"), (b"GIF89a", ""), (b"RIFF\x01\x02\x03\x04WEBP", "x"), (b"RIFF\x01\x02\x03\x04WAVE", "x.webp"), (b"", "b.JPEG"), (b"text", "b.txt"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content binary, path string")
    got = [r[1] for r in df.select("i", text.media_type(F.col("content"), F.col("path"))).orderBy("i").collect()]
    assert got == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/webp", "image/jpeg", "application/octet-stream"]


def test_mermaid(spark):
    given = ["a ```mermaid\n x \n``` b\n```mermaid  \n\ny\nz\n   ```c", "```mermaid\n\n```", "```go\nx\n```", "```mermaid\nopen", None, ""]
    assert values(spark, "string", given[:1], text.mermaid_blocks(F.col("v"))) == [[" x ", "y\nz"]]
    got = values(spark, "string", given, text.mermaid_pictures(F.col("v"), "p-"))
    assert got[0]["text"] == "a ![mermaid diagram 1](./images/p-mermaid-001.png) b\n![mermaid diagram 2](./images/p-mermaid-002.png)c"
    assert [tuple(p) for p in got[0]["pictures"]] == [(1, "p-mermaid-001.png", "x"), (2, "p-mermaid-002.png", "y\nz")]
    assert [(g["text"], g["pictures"]) for g in got[1:]] == [(g or "", []) for g in given[1:]]
    many = values(spark, "string", ["```mermaid\nx\n```\n" * 1001], text.mermaid_pictures(F.col("v"), width="3in"))[0]
    assert many["text"].splitlines()[-1] == "![mermaid diagram 1001](./images/mermaid-1001.png){width=3in}"


def test_ink_rules(spark):
    v = F.col("v")
    black, yellow = (0.0, 0.0, 0.0), (1.0, 0.93, 0.46)
    got = values(spark, "int", [-1, 0, 2, 27, 28, None], ink.rgb(v), ink.rgb(v, highlight=True))
    assert [tuple(map(tuple, g)) for g in got] == [(black, yellow), (black, black), ((1.0,) * 3,) * 2, ((0.454902, 0.823529, 0.909804),) * 2, (black, yellow), (black, yellow)]
    assert values(spark, "double", [-0.1, 0.0, 0.4506, 1.0, 7.0], ink.alpha_key(v)) == [0, 0, 451, 1000, 1000]
    assert values(spark, "string", ["x version=3 ", "version=5", "a version=6", "version=7", ""], ink.file_version(v)) == ["V3", "V5", "V6", None, None]
    assert values(spark, "int", [0, 5, 8, 9, 10, 11, None], ink.block_name(v)) == ["migration_info", "line", "tombstone", "other", "page_info", "other", "other"]


def test_page_rules(spark):
    plan = spark.createDataFrame([(0, "", "Grid\n Lines \n"), (1, "own", "Grid\nLines"), (1, None, "Grid\n Lines \n"), (2, None, "Grid"), (3, "", None)], "page_index int, template string, pagedata string")
    assert sorted((r["page_index"], r["template"]) for r in pages.with_templates(plan).collect()) == [(0, "Grid"), (1, "Lines"), (1, "own"), (2, ""), (3, "")]
    picked = pages.select_pages(spark.range(5).select(F.col("id").cast("int").alias("page_index")), "2, 4-5 ,2", 5)
    assert [(r["ordinal"], r["page_index"]) for r in picked.orderBy("ordinal").collect()] == [(0, 1), (1, 3), (2, 4), (3, 1)]
    assert pages.select_pages(spark.range(3).select(F.col("id").cast("int").alias("page_index")), " ", 3).count() == 3
    for wrong in ("0", "6", "3-2"):
        with pytest.raises(ValueError):
            pages.select_pages(plan, wrong, 5)
    part = values(spark, "string", ["---\na: 1\n---\nx", "x\n", ""], markdown.bundle_part(F.lit(" "), F.lit("p.md"), F.col("v")), markdown.bundle_part(F.lit(" T "), F.lit("p.md"), F.col("v"), F.lit("own\n")))
    assert part == [("# p.md\n\nx\n\n", "# T\n\nown\n\n"), ("# p.md\n\nx\n\n", "# T\n\nown\n\n"), ("# p.md\n\n\n\n", "# T\n\nown\n\n")]


def entries(spark):
    rows = [
        ("a", "", "Zoo", tree.FOLDER), ("b", "", "alpha", tree.FOLDER), ("c", "", "Beta", tree.DOCUMENT), ("d", "", "apple", tree.DOCUMENT), ("trash", "", "trash", tree.FOLDER),
        ("e", "b", "x1.Md", tree.DOCUMENT), ("f", "b", "x[1", tree.DOCUMENT), ("g", "b", "sub", tree.FOLDER), ("h", "g", "x2.md", tree.DOCUMENT), ("t", "b", "x3.md", tree.TEMPLATE),
    ]
    return spark.createDataFrame(rows, "id string, parent_id string, name string, type string")


def test_tree_rules(spark):
    e = entries(spark)
    walked = tree.walk(e).cache()
    assert [r["id"] for r in tree.children(walked, "").collect()] == ["b", "a", "d", "c"]
    assert sorted(r["id"] for r in tree.glob_last(walked, "/alpha/", "X?.MD").collect()) == ["e"]
    assert sorted(r["id"] for r in tree.glob_last(walked, "/alpha", "x*").collect()) == ["e", "f"]
    assert sorted(r["id"] for r in tree.glob_last(walked, "/alpha/sub", "*").collect()) == ["h"]
    assert tuple(sync.status_counts(e).first()) == (5, 4, 10)
    made = tree.create_folder(e, "b", "n", " New ")
    assert [(r["parent_id"], r["name"], r["type"]) for r in made.filter("id = 'n'").collect()] == [("b", "New", tree.FOLDER)] and made.count() == 11
    assert tree.create_folder(e, "", "n", "x1.Md").count() == 11
    for parent, name in (("b", " x1.Md"), ("b", "  "), ("b", "a/b"), ("b", "a\\b"), ("c", "new"), ("none", "new"), ("", "Zoo")):
        with pytest.raises(ValueError):
            tree.create_folder(e, parent, "n", name)
    wanted = spark.createDataFrame([("/alpha/sub/new/deep",), ("/alpha/sub/new",), ("/",), ("other//x",)], "path string")
    got = tree.missing_directories(wanted, walked).orderBy("depth", "path").collect()
    assert [(r["path"], r["depth"]) for r in got] == [("/other", 1), ("/other/x", 2), ("/alpha/sub/new", 3), ("/alpha/sub/new/deep", 4)]
    walked.unpersist()


def test_unique_keys(spark):
    rows = [("k1", "a"), ("k2", "b")]
    df = lambda *more: spark.createDataFrame([*rows, *more], "key string, input string")
    assert sorted(map(tuple, sync.unique_keys(df()).collect())) == rows
    with pytest.raises(Exception, match="two inputs have one key: b, c"):
        sync.unique_keys(df(("k2", "c"))).collect()


def test_pen_positions(spark):
    e = spark.createDataFrame([(1, 3, "pen"), (1, 1, "pen key"), (2, 3, "touch"), (None, 3, "none")], "source int, type int, name string")
    assert [r["name"] for r in events.pen_positions(e).collect()] == ["pen"]


def test_session_files(spark, tmp_path):
    call = lambda command, code: {"input": {"command": command}, "output": {"exit_code": code}}
    bodies = {
        "a.json": [{"id": 1, "tool_calls": [call("ls", 0), call({"a": [1]}, "0")]}, {"id": "x"}], "b.json": {"id": "3", "tool_calls": ["bare", call(None, None), {}]},
        "c.json": {"id": 4, "tool_calls": {"no": "array"}}, "d.json": [],
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2))
    sessions = files.session_variants(spark, str(tmp_path))
    got = files.session_calls(sessions, "$.tool_calls", {"session": "$.id"}, {"command": "$.input.command"}, {"code": "$.output.exit_code"}).collect()
    assert sessions.count() == 4
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("1", 0, "ls", "0"), ("1", 1, '{"a":[1]}', '"0"'), ("3", 0, None, None), ("3", 1, None, "null"), ("3", 2, None, None)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/one.json").write_text('{"id": 7, "name": "n"}')
    assert [tuple(r) for r in files.session_logs(spark, str(tmp_path / "e"), "id int, other string").collect()] == [(7, None)]


def test_reports(spark):
    rows = [("d1", 1700000000999, ["open", None], "pass", "", 9), (None, None, None, None, None, None), ("d3", 0, [], "fail", "a\nb", 10)]
    df = spark.createDataFrame(rows, "document_id string, timestamp long, actions array<string>, status string, notes string, saved_at long")
    got = {r["name"]: r for r in reports.review_reports(df).collect()}
    assert got["validation-9"]["markdown"].splitlines() == [
        "# Validation Session: validation-9", "", "**Document ID:** d1  ", "**Timestamp:** 2023-11-14T22:13:20Z  ", "**Status:** pass", "", "## Actions Performed", "", "- open", "- ", "",
        "## Review Notes", "", "(no notes)",
    ]
    assert json.loads(got["validation-10"]["json"]) == {"documentId": "d3", "actions": [], "review": {"status": "fail", "notes": "a\nb"}, "timestamp": 0}
    assert got["validation-10"]["markdown"].endswith("## Actions Performed\n\n- (none)\n\n## Review Notes\n\na\nb\n")
    assert json.loads(got["validation-0"]["json"])["documentId"] == "" and "- (none)" in got["validation-0"]["markdown"]
    at = lambda h: datetime.datetime(2026, 1, 2, h, 5)
    day = spark.createDataFrame([("2", "b", False, at(3)), ("1", "z", True, at(23)), ("1", "a", None, None), ("1", None, False, at(1))], "day string, name string, is_dir boolean, modified timestamp_ntz")
    assert [tuple(r) for r in reports.day_listing(day, -4).collect()] == [("1", "19:05  \U0001f4c1 z"), ("1", "21:05  \U0001f4c4 "), ("1", "??:??  \U0001f4c4 a"), ("2", "23:05  \U0001f4c4 b")]
    a, b = (spark.createDataFrame([(i, f"{s}{i}") for i in range(3)], "place int, image string") for s in "ab")
    assert [(r["side"], r["image"]) for r in reports.both_lists(a, b.unionByName(b)).collect()] == [(0, "a0"), (0, "a1"), (0, "a2"), *[(1, f"b{i}") for i in (0, 0, 1, 1, 2, 2)]]
