"""Markdown rewriting and text functions on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import markdown, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(("lines", "want"), [
    (["a", "~~~ js", "- x", "~~", "~~~~ ", "b"], [0, 1, 1, 1, 1, 0]),
    (["```a`b", "- x"], [0, 0]),
    (["$$", "- x", "y \\$$", "$$", "- z"], [1, 1, 1, 1, 0]),
    (["$$ x $$", "\\[ y", "- q", "\\]", "t"], [1, 1, 1, 1, 0]),
    (["   ```", "open to the end"], [1, 1]), ([""], [0]),
])
def test_literal_lines(lines, want):
    assert markdown.literal_lines(lines) == [bool(w) for w in want]


def test_lists(spark):
    body = "text\n- a\n- b\n\n12. c\n```\nx\n- no\n```\n- after fence\n          - deep\n\t- two"
    docs = markdown.with_lines(spark.createDataFrame([(1, body), (2, None)], "doc_id int, text string"))
    spaced = {r["doc_id"]: r["y"] for r in docs.select("doc_id", markdown.spaced_lists().alias("y")).collect()}
    assert spaced[1] == body.replace("text\n- a", "text\n\n- a").replace("```\n- after", "```\n\n- after") and spaced[2] == ""
    flat = {r["doc_id"]: r["y"] for r in docs.select("doc_id", markdown.flattened_lists(2).alias("y")).collect()}
    assert flat[1] == body.replace("          - deep", "  - deep")


@pytest.mark.parametrize(("target", "want"), [
    (" a.png ", ("a.png", "")), ('a.png "t i"', ("a.png", ' "t i"')), ("<a b.png> 't'", ("a b.png", " 't'")), ("<open", None), ("  ", None),
])
def test_split_target(spark, target, want):
    found = one(spark, target, markdown.split_target(F.col("x")))
    assert (found and tuple(found)) == want


def test_staged_images(spark):
    body = '![a](i/x.png) ![b](<j/x.png> "t") ![c](http://h/x.png) ![d](../x.png) ![e](none.png) ![f][Lab  el]\n[lab el]: ./i/x.png\n[other]: i/x.png'
    docs = spark.createDataFrame([(1, body, "/d", "p-"), (2, None, "/d", None)], "doc_id int, text string, folder string, prefix string")
    files = spark.createDataFrame([("/d/i/x.png",), ("/d/j/x.png",), ("/x.png",)], "path string")
    found = {r["doc_id"]: r for r in markdown.staged_images(docs, files).collect()}
    assert found[1]["text"] == (
        '![a](./images/p-x.png) ![b](./images/p-x-1.png "t") ![c](http://h/x.png) ![d](../x.png) ![e](none.png) ![f][Lab  el]\n[lab el]: ./images/p-x-2.png\n[other]: i/x.png'
    )
    assert [tuple(c) for c in found[1]["copies"]] == [("/d/i/x.png", "p-x.png"), ("/d/j/x.png", "p-x-1.png"), ("/d/i/x.png", "p-x-2.png")]
    assert found[2]["text"] == "" and found[2]["copies"] == []


def test_source_page(spark):
    got = one(spark, "a ``` b", markdown.source_page(F.lit("/q/run.go"), F.lit(" "), F.col("x")))
    assert got == "# run.go\n\n````go\na ``` b\n````\n"


@pytest.mark.parametrize(("raw", "want"), [
    ("---\r\na: 1\r\n--- \r\n\n\nbody", "body"), (" ---\na\n---\nb", " ---\na\n---\nb"), ("---\n---", ""), ("--- x\n---\nb", "--- x\n---\nb"), ("---\na\n ---\nb\n---\nc", "b\n---\nc"),
])
def test_front_matter_edges(spark, raw, want):
    assert one(spark, raw, text.without_front_matter(F.col("x"))) == want


@pytest.mark.parametrize(("raw", "want"), [("My__ File_.pdf", "My_File.pdf"), ("a/b.c.txt", "b.c.txt"), ("dir/_x_/", "x"), (".pdf", "document.pdf"), ("a b.P D", "a_b.P D")])
def test_safe_name_parts(spark, raw, want):
    assert one(spark, raw, text.safe_name(F.col("x"))) == want


def test_names_and_levels(spark):
    assert one(spark, " a\x07/b ", text.safe_attachment(F.col("x"))) == " a_b "
    assert one(spark, "\t a/b// \n", text.normal_path(F.col("x"))) == "/a/b"
    assert one(spark, "a/./b/../../../c", text.resolved_path(F.col("x"))) == "/c"
    assert [one(spark, x, text.list_level(F.col("x"))) for x in ("- a", "   - a", "\t 2. b", "    plain")] == [1, 2, 2, 0]


def test_date_directory(spark):
    c = F.col("x")
    assert one(spark, " 2024-13-99 ", text.date_directory(c)) == "/ai/2024/13/99" and one(spark, "/2024/01/02/", text.date_directory(c)) == "/ai/2024/01/02"
    assert one(spark, "", text.date_directory(c)) == one(spark, None, F.concat(F.lit("/ai/"), F.date_format(F.current_date(), "yyyy/MM/dd")))
    assert one(spark, "junk", text.date_directory(c, F.lit(" here "))) == "/here"
    with pytest.raises(Exception, match="invalid date"):
        one(spark, "2024-1-02", text.date_directory(c))


def test_flags(spark):
    c = F.col("x")
    assert [one(spark, x, text.cover_page(c)) for x in (None, "", "0", "1")] == [None, None, None, 0]
    assert [one(spark, x, text.layout(c)) for x in (None, " Editor ")] == ["default", "editor"]
    for f, bad in ((text.cover_page, "2"), (text.layout, "wide")):
        with pytest.raises(Exception, match="cover page|unknown layout"):
            one(spark, bad, f(c))
    assert one(spark, "HTTP 403", text.is_auth_error(c)) and not one(spark, None, text.is_auth_error(c)) and one(spark, "it Doesn't exist", text.is_not_found_error(c))
    assert one(spark, "x tool upload md --a --b c", text.command_excerpt(c, "tool")) == "upload" and one(spark, "tool ls --a --b c", text.command_excerpt(c, "tool")) == "ls --a --b"
