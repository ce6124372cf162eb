"""SVG blocks and HTML images against plain scans of the characters, and bundles of texts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.functions import markdown, markup
from foliospark.plans.catalogue import ORACLES
from foliospark.plans.markup import md_bundle_parts


def tag_end(line, i):
    quote = ""
    for k in range(i, len(line)):
        c = line[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return k
    return len(line)


def bounded(line, i, name):
    rest = line[i:].lower()
    return rest.startswith(name) and (len(rest) == len(name) or rest[len(name)] in " \t\r\n>/")


def plain_depth(line):
    depth = i = 0
    while i < len(line):
        if bounded(line, i, "</svg"):
            depth, i = depth - 1, line.find(">", i)
            if i < 0:
                break
        elif bounded(line, i, "<svg"):
            end = tag_end(line, i)
            depth += not (end < len(line) and line[end - 1] == "/")
            i = end
        elif line[i] == "<" and (line[i + 1 : i + 2].isalpha() or line[i + 1 : i + 2] == "/" and line[i + 2 : i + 3].isalpha()):
            i = tag_end(line, i)
        i += 1
    return depth


def plain_svg(text):
    lines = text.split("\n")
    literal = markdown.literal_lines(lines)
    out, images, i = [], [], 0
    while i < len(lines):
        end = None
        if not literal[i] and bounded(lines[i].lstrip(" \t"), 0, "<svg"):
            depth = 0
            for j in range(i, len(lines)):
                if j > i and literal[j]:
                    break
                depth += plain_depth(lines[j])
                if depth <= 0:
                    end = j
                    break
        if end is None:
            out.append(lines[i])
            i += 1
        else:
            k = len(images) + 1
            out.append(f"![svg image {k}](./images/svg-{k:03d}.pdf)")
            images.append((f"svg-{k:03d}", "\n".join(lines[i : end + 1])))
            i = end + 1
    return "\n".join(out), images


def test_svg_blocks_equal_plain_scan(spark):
    draw = random.Random(4)
    pieces = ["<svg>", "</svg>", "<svg/>", " <SVG a='>'>", "<g d=\"</svg>\">", "don't", "```", "<svgx>", "text", "<svg x=\"", "\n", "\n", "\n", "<", "$$", "</svg", "é"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 14))) for _ in range(600)] + ["<svg>\n" * 40, "<svg>\n" * 30 + "</svg>\n" * 30]
    docs = markdown.with_lines(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string"))
    found = {r["doc_id"]: r for r in markup.svg_images(docs).select("doc_id", F.array_join("lines", "\n").alias("body"), "images", "literal", F.size("lines").alias("n")).collect()}
    for k, text in enumerate(texts):
        assert (found[k]["body"], [tuple(i) for i in found[k]["images"]]) == plain_svg(text), repr(text)
        assert found[k]["literal"] == markdown.literal_lines(found[k]["body"].split("\n")), repr(text)
    assert found[-1]["body"] == "" and found[-1]["images"] == []


def test_svg_numbers_prefix_and_width(spark):
    text = "\n".join(["<svg/>"] * 1001)
    docs = markdown.with_lines(spark.createDataFrame([(text, "b-")], "text string, own string"))
    row = markup.svg_images(docs, F.col("own"), "5cm", "/t").select("lines", "images").first()
    assert row["lines"][0] == "![svg image 1](/t/b-svg-001.pdf){width=5cm}" and row["images"][1000]["name"] == "b-svg-1001"


def plain_attributes(tag):
    inner = tag[4:].removesuffix(">").removesuffix("/")
    found, i = [], 0
    skip = lambda i, chars: next((k for k in range(i, len(inner)) if inner[k] not in chars), len(inner))
    upto = lambda i, chars: next((k for k in range(i, len(inner)) if inner[k] in chars), len(inner))
    while (i := skip(i, " \t\r\n")) < len(inner):
        end = upto(i, " \t\r\n=")
        name, i = inner[i:end].lower(), skip(end, " \t\r\n=")
        if i < len(inner) and inner[i] in "\"'":
            end = upto(i + 1, inner[i])
            value, i = inner[i + 1 : end], end + 1
        else:
            end = upto(i, " \t\r\n")
            value, i = inner[i:end], end
        if name:
            found.append((name, value))
    return found


def test_attributes_equal_plain_scan(spark):
    draw = random.Random(9)
    pieces = ["src", "=", "=", " ", " ", '"', "'", "a.svg", "WIDTH", "/", "x", "\t", "5", "<"]
    tags = ["<img " + "".join(draw.choices(pieces, k=draw.randint(0, 12))) + draw.choice([">", "/>"]) for _ in range(800)]
    rows = spark.createDataFrame([*enumerate(tags)], "k int, tag string").select("k", markup.tag_attributes(F.col("tag")).alias("a")).collect()
    for r in rows:
        assert [tuple(a) for a in r["a"] if a["name"]] == plain_attributes(tags[r["k"]]), repr(tags[r["k"]])


@pytest.mark.parametrize(("line", "want"), [
    ('<img src="a.svg">', "![svg image](a.svg)"), ("x<IMG SRC='a b.svg' alt='[q]\\'/>y", "x![&#91;q&#93;&#92;](<a b.svg>)y"),
    ('<img src="a.svg" height="10" width=" 50% ">', "![svg image](a.svg){width=50%}"), ('<img src="a.svg" height=10>', "![svg image](a.svg){width=10px}"),
    ('<img src="a.svgz"><img\tsrc=b.SVG?x#y>', '<img src="a.svgz">![svg image](b.SVG?x#y)'), ('<img src="a.svg', '<img src="a.svg'),
    ('<img src="a.svg> <img src=b.svg>', '<img src="a.svg> <img src=b.svg>'), ('<img alt="a > b" src="c(1).svg">', "![a > b](<c(1).svg>)"), ("<imgs src=a.svg>", "<imgs src=a.svg>"),
    ('<img src="a.svg"><img src="b.svg">', "![svg image](a.svg)![svg image](b.svg)"), ("<img>", "<img>"), ("", ""),
])
def test_html_images(spark, line, want):
    docs = markdown.with_lines(spark.createDataFrame([(f"{line}\n```\n{line}",)], "text string"))
    assert docs.select(markup.html_images(F.col("lines"), F.col("literal")).alias("y")).first()["y"] == [want, "```", line]


def test_bundle_parts(spark):
    rows = [
        (1, "b", 2, "p/second.md", "", "---\nt: x\n---\n<svg/>\na\n- b\n"), (2, "b", 1, "first.md", " First ", None), (3, "b", None, "none.md", None, "<img src=x.svg>"),
        (4, "c", 1, "only.md", "Only", "```\n<svg/>\n```"), (5, "b", 2, "p/second.md", "", "tie"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, bundle string, place int, path string, title string, text string")
    found = {(r["bundle"], r["number"]): r for r in markup.bundle_parts(docs).collect()}
    end = "\n```{=latex}\n\\newpage\n```\n\n"
    assert {k: r["part"] for k, r in found.items()} == {
        ("b", 1): "# none.md\n\n![svg image](x.svg)\n" + end, ("b", 2): "# First\n\n\n" + end,
        ("b", 3): "# p/second.md\n\n![svg image 1](./images/bundle-003-svg-001.pdf)\na\n\n- b\n" + end, ("b", 4): "# p/second.md\n\ntie\n\n",
        ("c", 1): "# Only\n\n```\n<svg/>\n```\n\n",
    }
    assert [i["name"] for i in found["b", 3]["images"]] == ["bundle-003-svg-001"]
    with pytest.raises(Exception, match="path is empty"):
        markup.bundle_parts(docs.withColumn("path", F.lit(" "))).collect()


def test_bundle_parts_of_odd_documents(spark, tmp_path):
    """Texts without a word (of other letters, of line breaks, empty, null), equal rows, and rows without an id are numbered as the SQL does."""
    texts = ["words\n", "", None, "\n\n", "é!\n", "\n \nx", "  ", "\r\n"]
    rows = [(k, texts[k // 50 % len(texts)]) for k in range(0, 1200, 50)] + [(50, ""), (0, "words\n"), (0, "words\n"), (None, "a"), (None, "a"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["md_bundle_parts"]).fetchall()
    got = [tuple(r) for r in md_bundle_parts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(rows)
