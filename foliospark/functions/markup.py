"""Vector graphics and HTML images in Markdown, and bundles of Markdown texts.

``<svg>`` blocks are found by the running depth of their tags over a document's lines, ``<img>`` tags by an attribute tokenizer; both are
column functions on the arrays of ``markdown.with_lines``, so a document is rewritten where it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.markdown import PAGE_BREAK, bundle_part, safe_alt, spaced_lists, with_lines, written_target
from foliospark.functions.text import without_front_matter

_BOUND = r"(?:[ \t\r\n>/]|\z)"
#: the inside of a tag: quoted values may hold any character, and an open quote lasts to the end of the line
_CLOSED = r"""(?:[^"'>]|"[^"]*"|'[^']*')*+"""
_OPEN = r"""(?:[^"'>]|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+"""
_SVG_CLOSE, _SVG_OPEN = rf"(?i)^</svg{_BOUND}", rf"(?i)^<svg{_BOUND}"
_TAG = rf"(?i)</svg(?={_BOUND})[^>]*+>?|</?[a-z]{_OPEN}>?"
_IMG = rf"(?i)<img(?={_BOUND}){_OPEN}(?:>|\z)"
_WHOLE_SVG = rf"(?i)^<svg{_CLOSED}>\z"
_WHOLE_IMG = rf"(?i)^<img(?={_BOUND}){_CLOSED}>\z"
_HTML_SPACE = r" \t\r\n"
_ATTRIBUTE = rf"""([^{_HTML_SPACE}=]*+)[{_HTML_SPACE}=]*+("[^"]*+"?|'[^']*+'?|[^{_HTML_SPACE}]*+)"""
_BLANKS = " \t\r\n\f\x0b\x85\xa0"


def svg_depth(line: Column) -> Column:
    """Opened less closed ``svg`` tags of a line.

    Tags may be in any case; self-closing ones do not count, nor does what stands in another tag's quoted values. Quotes in text are plain characters.
    """
    depth = lambda tag: F.when(tag.rlike(_SVG_CLOSE), -1).when(tag.rlike(_SVG_OPEN) & ~(tag.endswith("/>") & tag.rlike(_WHOLE_SVG)), 1).otherwise(0)
    return F.aggregate(F.regexp_extract_all(line, F.lit(_TAG), F.lit(0)), F.lit(0), lambda n, tag: n + depth(tag))


def svg_spans(lines: Column, literal: Column) -> Column:
    """array<struct<first, last>>: the lines (from 0) of each outermost ``svg`` block that closes before a literal line.

    A block begins at a line that starts with the tag. One that never closes is none, and blocks inside it then count by themselves. Blocks that wait for their
    end lie on a stack, each with the depth before it; a line whose depth falls to it closes it, with all above it.
    """
    at = F.arrays_zip(lines.alias("line"), literal.alias("literal"), F.transform(lines, lambda _, i: i).alias("i"))
    waiting = F.array().cast("array<struct<first:int,depth:int>>")
    found = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, now: Column) -> Column:
        starts = F.regexp_replace(now["line"], "^[ \\t]+", "").rlike(_SVG_OPEN)
        opened = F.when(starts, F.concat(acc["waiting"], F.array(F.struct(now["i"].alias("first"), acc["depth"].alias("depth"))))).otherwise(acc["waiting"])
        depth = acc["depth"] + svg_depth(now["line"])
        closed = F.get(F.filter(opened, lambda w: w["depth"] >= depth), F.lit(0))["first"]
        block = F.array(F.struct(closed.alias("first"), now["i"].alias("last")))
        return F.when(
            now["literal"], F.struct(acc["depth"].alias("depth"), waiting.alias("waiting"), acc["found"].alias("found"))
        ).otherwise(
            F.struct(
                depth.alias("depth"),
                F.when(closed.isNull(), opened).otherwise(F.filter(opened, lambda w: w["depth"] < depth)).alias("waiting"),
                F.when(closed.isNull(), acc["found"]).otherwise(F.concat(F.filter(acc["found"], lambda b: b["first"] < closed), block)).alias("found"),
            )
        )

    start = F.struct(F.lit(0).alias("depth"), waiting.alias("waiting"), found.alias("found"))
    return F.aggregate(at, start, step, lambda acc: acc["found"])


def _dimensioned(image: Column, width: Column) -> Column:
    return F.concat(image, F.when(width == "", "").otherwise(F.concat(F.lit("{width="), width, F.lit("}"))))


def svg_images(docs: DataFrame, prefix: Column | None = None, width: str = "", folder: str = "./images") -> DataFrame:
    """``docs`` with an image reference in place of each block's lines (in lines and literal), and the column images.

    images (array<struct<name, svg>>) are the blocks with the names they are to be stored under, numbered from 1. A width is added to each
    reference. Other columns stay.
    """
    own = F.lit("") if prefix is None else F.coalesce(prefix, F.lit(""))
    spans = F.col("__spans")
    name = lambda i: F.concat(own, F.format_string("svg-%03d", i + 1))
    part = lambda of, first, end: F.slice(of, first + 1, end - first)
    since = lambda i: F.coalesce(F.get(spans, i - 1)["last"] + 1, F.lit(0))

    def reference(i: Column) -> Column:
        return _dimensioned(F.concat(F.format_string("![svg image %d](", i + 1), F.lit(folder + "/"), name(i), F.lit(".pdf)")), F.lit(width))

    def replaced(of: str, by: Callable[[Column], Column]) -> Column:
        """An array over the lines, with one entry for each block."""
        before = F.transform(spans, lambda b, i: F.concat(part(F.col(of), since(i), b["first"]), F.array(by(i))))
        return F.concat(F.flatten(before), part(F.col(of), since(F.size(spans)), F.size(of)))

    images = F.transform(spans, lambda b, i: F.struct(name(i).alias("name"), F.array_join(part(F.col("lines"), b["first"], b["last"] + 1), "\n").alias("svg")))
    found = docs.withColumn("__spans", svg_spans(F.col("lines"), F.col("literal")))
    # new names, as a name inside a lambda would be taken for the new column
    done = found.withColumns({"images": images, "__lines": replaced("lines", reference), "__literal": replaced("literal", lambda i: F.lit(False))})
    return done.drop("__spans", "lines", "literal").withColumnsRenamed({"__lines": "lines", "__literal": "literal"})


def tag_attributes(tag: Column) -> Column:
    """array<struct<name, value>> of an ``img`` tag, names in lower case.

    A name is followed by its value, behind any ``=`` and white space: in single or double quotes, or up to the next white space.
    """
    inner = F.regexp_replace(F.regexp_replace(F.substring(tag, F.lit(5), F.length(tag)), r">\z", ""), r"/\z", "")
    inner = F.regexp_replace(inner, f"^[{_HTML_SPACE}]+", "")
    # each attribute with the white space after it, so that the next begins with its name
    pattern = F.lit(_ATTRIBUTE + f"[{_HTML_SPACE}]*+")
    pairs = F.arrays_zip(F.regexp_extract_all(inner, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(inner, pattern, F.lit(2)).alias("value"))
    value = lambda v: F.regexp_replace(v, r"""^(?:"([^"]*)"?|'([^']*)'?)\z""", "$1$2")
    return F.transform(pairs, lambda p: F.struct(F.lower(p["name"]).alias("name"), value(p["value"]).alias("value")))


def _attribute(attributes: Column, name: str) -> Column:
    """The last one of that name, else empty."""
    return F.coalesce(F.try_element_at(F.filter(attributes, lambda a: a["name"] == name), F.lit(-1))["value"], F.lit(""))


def _dimension(value: Column) -> Column:
    bare = F.trim(value, F.lit(_BLANKS))
    return F.when(bare.rlike(r"^[0-9]+\z"), F.concat(bare, F.lit("px"))).otherwise(bare)


def markdown_image(tag: Column, width: str = "") -> Column:
    """An ``img`` tag of an SVG file as a Markdown image, any other tag as it is.

    The width is the tag's, else its height, else ``width``; bare numbers are pixels. Query and fragment of the source do not count.
    """
    attributes = tag_attributes(tag)
    source, alt = _attribute(attributes, "src"), _attribute(attributes, "alt")
    sizes = [_dimension(_attribute(attributes, name)) for name in ("width", "height")]
    size = F.when(sizes[0] != "", sizes[0]).when(sizes[1] != "", sizes[1]).otherwise(F.lit(width))
    image = F.concat(F.lit("!["), safe_alt(F.when(alt == "", "svg image").otherwise(alt)), F.lit("]("), written_target(source), F.lit(")"))
    vector = F.lower(F.regexp_replace(source, r"(?s)[?#].*\z", "")).endswith(".svg") & ~source.rlike("[<>]")
    return F.when(vector, _dimensioned(image, size)).otherwise(tag)


def html_images(lines: Column, literal: Column, width: str = "") -> Column:
    """The lines with Markdown images for ``img`` tags of SVG files. Literal lines, and a tag that does not end on its line with all behind it, stay."""

    def rewritten(line: Column) -> Column:
        tags, between = F.regexp_extract_all(line, F.lit(_IMG), F.lit(0)), F.split(line, _IMG, -1)
        done = F.transform(tags, lambda t: F.when(t.rlike(_WHOLE_IMG), markdown_image(t, width)).otherwise(t))
        return F.array_join(F.transform(between, lambda text, i: F.concat(text, F.coalesce(F.get(done, i), F.lit("")))), "")

    flagged = F.arrays_zip(lines.alias("line"), literal.alias("literal"))
    return F.transform(flagged, lambda x: F.when(x["literal"] | ~x["line"].rlike("(?i)<img"), x["line"]).otherwise(rewritten(x["line"])))


def _repeated_inputs(keyed: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that share a key with others, numbered from that of ``first`` on.

    They are told apart by digests; one row of each is kept and joined to the numbers of all that equal it.
    """
    again = keyed.join(first, F.col("key") == F.col("of"), "left_semi").withColumn("digest", F.sha2(F.to_json(F.struct("title", "text")), 256))
    ranked = again.select(F.col("key").alias("rk"), F.col("digest").alias("rd"), F.row_number().over(Window.partitionBy("key").orderBy("digest")).alias("k"))
    kept = again.dropDuplicates(["key", "digest"]).join(ranked, (F.col("key") == F.col("rk")) & (F.col("digest") == F.col("rd")))
    return kept.join(first, F.col("key") == F.col("of")).select("key", "title", "text", (F.col("before") + F.col("k")).alias("number"), "last")


def bundle_parts(docs: DataFrame) -> DataFrame:
    """One row per input of a bundle: bundle, number, part and images; the parts in order of number are the bundle's text.

    ``docs`` has doc_id, bundle, place, path, title and text. Front matter goes, SVG tags and blocks become images with the input's number in
    their names, lists get their spacing, each part has a heading (its title, else its path), and all but the last end with a page break.
    Inputs are ordered by place, ties by path, doc_id and a digest; null places come first. Equal rows are inputs each; null ids and bundles are
    keys like others. Blank paths are an error. Only keys are ordered together; texts are joined to their numbers, so a bundle of any size is made by many tasks.
    """
    # a struct equals another of the same nulls
    keyed = docs.select(F.struct("bundle", "place", "path", "doc_id").alias("key"), "title", F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("key.bundle")
    order = whole.orderBy("key.place", "key.path", "key.doc_id")
    beside = lambda step: F.coalesce(step("key").over(order) == F.col("key"), F.lit(False))
    numbers = keyed.select(
        F.col("key").alias("of"), F.row_number().over(order).alias("number"), F.count("*").over(whole).alias("last"), (beside(F.lag) | beside(F.lead)).alias("repeated")
    )
    single = keyed.join(numbers.filter("not repeated"), F.col("key") == F.col("of")).select("key", "title", "text", "number", "last")
    first = numbers.filter("repeated").groupBy("of").agg((F.min("number") - 1).alias("before"), F.first("last").alias("last"))
    numbered = single if first.isEmpty() else single.unionByName(_repeated_inputs(keyed, first))
    path = F.when(F.trim(F.coalesce("key.path", F.lit("")), F.lit(_BLANKS)) == "", F.raise_error(F.lit("bundle input path is empty")).cast("string")).otherwise(F.col("key.path"))
    named = numbered.select(
        "key.bundle", "number", (F.col("number") < F.col("last")).alias("followed"), path.alias("path"), "title", without_front_matter(F.col("text")).alias("text"),
        F.format_string("bundle-%03d-", "number").alias("prefix"),
    )
    tags = with_lines(named).withColumn("lines", html_images(F.col("lines"), F.col("literal")))
    drawn = svg_images(tags, F.col("prefix"))
    part = F.concat(bundle_part(F.col("title"), F.col("path"), F.col("text"), spaced_lists()), F.when(F.col("followed"), PAGE_BREAK).otherwise(""))
    return drawn.select("bundle", "number", part.alias("part"), "images")
