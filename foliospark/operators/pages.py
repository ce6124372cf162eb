"""Notebook pages: page plans from JSON, templates, selections, typed text, ordered sequences, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STAMPED = "struct<timestamp:string,value:{}>"
CONTENT_SCHEMA = (
    "struct<fileType:string,pageCount:int,pages:array<string>,redirectionPageMap:array<int>,cPages:struct<pages:array<struct<"
    f"id:string,redir:{_STAMPED.format('int')},deleted:{_STAMPED.format('int')},template:{_STAMPED.format('string')}>>>>"
)


def page_plan(content: DataFrame, column: str = "content") -> DataFrame:
    """One row per page of every content JSON: all other columns, doc_type, layout, page_index, page_id, source_page, template.

    With a ``cPages`` key deleted pages go before numbering and a page without a source has -1. Else the
    page count is the largest of three; a missing id is the index as text, a missing source the index. Only the value 1 means
    deleted. JSON that cannot be read fails; null has no pages.
    """
    parsed = content.filter(F.col(column).isNotNull()).withColumn("j", F.from_json(column, CONTENT_SCHEMA, {"mode": "FAILFAST"}))
    kind = F.coalesce(F.col("j.fileType"), F.lit(""))
    doc_type = F.when(kind.isin("pdf", "epub"), kind).when(kind.isin("", "notebook"), "notebook").otherwise("unknown")
    kept = F.filter("j.cPages.pages", lambda p: F.coalesce(p["deleted"]["value"], F.lit(0)) != 1)
    new = F.transform(
        kept,
        lambda p, i: F.struct(
            i.alias("page_index"), p["id"].alias("page_id"), F.coalesce(p["redir"]["value"], F.lit(-1)).alias("source_page"),
            F.coalesce(p["template"]["value"], F.lit("")).alias("template"),
        ),
    )
    sizes = [F.coalesce(F.size(F.col(c)), F.lit(0)) for c in ("j.pages", "j.redirectionPageMap")]
    n = F.greatest(F.coalesce("j.pageCount", F.lit(0)), *[F.greatest(s, F.lit(0)) for s in sizes])
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    old = F.transform(
        places,
        lambda i: F.struct(
            i.alias("page_index"), F.coalesce(F.get("j.pages", i), i.cast("string")).alias("page_id"),
            F.coalesce(F.get("j.redirectionPageMap", i), i).alias("source_page"), F.lit("").alias("template"),
        ),
    )
    has = F.col("j.cPages").isNotNull()
    pages = F.when(has, new).otherwise(old)
    return parsed.select(
        *[c for c in content.columns if c != column], doc_type.alias("doc_type"),
        F.when(has, "cPages").otherwise("legacy").alias("layout"), F.explode(pages).alias("p"),
    ).select("*", "p.*").drop("p")


def with_templates(plan: DataFrame, lines: str = "pagedata") -> DataFrame:
    """Fills empty templates from the lines of a text column, by position; set ones stay."""
    own = F.trim(F.get(F.split(F.coalesce(F.col(lines), F.lit("")), "\n"), F.col("page_index")))
    return plan.withColumn("template", F.coalesce(F.nullif(F.col("template"), F.lit("")), own, F.lit("")))


def parse_selection(spec: str, total: int) -> list[int]:
    """Page numbers of ``1,3-5``: order and repeats stay, blank is all; bad ranges raise."""
    if not spec.strip():
        return list(range(1, total + 1))
    chosen: list[int] = []
    for part in spec.split(","):
        low, dash, high = (x.strip() for x in part.partition("-"))
        first, last = int(low), int(high if dash else low)
        if not 1 <= first <= last <= total:
            raise ValueError(f"page range {part.strip()!r} is not within 1 to {total}")
        chosen.extend(range(first, last + 1))
    return chosen


def parse_page_list(spec: str) -> list[int]:
    """Page numbers of ``1,3``: blank, and nothing but commas, is page 1; numbers below 1 raise."""
    numbers = [int(part) for part in spec.split(",") if part.strip()] or [1]
    if min(numbers) < 1:
        raise ValueError(f"page numbers begin with 1: {spec}")
    return numbers


def select_pages(plan: DataFrame, spec: str, total: int) -> DataFrame:
    """The chosen pages with their ordinal; a page chosen twice comes twice."""
    places = parse_selection(spec, total)
    picks = plan.sparkSession.createDataFrame([(i, p - 1) for i, p in enumerate(places)], "ordinal int, pick int")
    return plan.join(picks, F.col("page_index") == F.col("pick")).drop("pick")


_LINE_HEIGHT = {1: 70, 2: 150, 3: 35, 4: 35}


def paragraph_positions(paragraphs: DataFrame, key: str, order: str, style: str, top: float = 0.0) -> DataFrame:
    """Adds y, the sum of the line heights before a paragraph from ``top - 88``, and y_text, its own height included.

    Styles: 1 plain 70, 2 heading 150, 3 bold 35, 4 bullet 35; a null or unknown style is plain.
    """
    # Line heights by paragraph style.
    heights = F.create_map(*[F.lit(x) for kv in _LINE_HEIGHT.items() for x in kv])
    h = F.coalesce(F.element_at(heights, F.coalesce(F.col(style), F.lit(1)).cast("int")), F.lit(70))
    through = F.sum(h).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return paragraphs.withColumn("y_text", through + F.lit(top - 88)).withColumn("y", F.col("y_text") - h)


def split_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a text, numbered from 0."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "line_text"))


def compare_pages(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pages of two sets of documents, side by side: doc_id, page, ratio of differing cells, same_text and match.

    Pages have doc_id, page, cells (array) and text. Cells are compared over the overlap where sizes differ by one at
    most; else the ratio is 1. A page that only one side has does not match.
    """
    x = a.select(F.col("doc_id").alias("da"), F.col("page").alias("pa"), F.col("cells").alias("ca"), F.col("text").alias("ta"))
    y = b.select(F.col("doc_id").alias("db"), F.col("page").alias("pb"), F.col("cells").alias("cb"), F.col("text").alias("tb"))
    both = x.join(y, (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb")), "full_outer")
    least = F.least(F.size("ca"), F.size("cb"))
    differ = F.size(F.filter(F.arrays_zip(F.slice("ca", F.lit(1), least).alias("p"), F.slice("cb", F.lit(1), least).alias("q")), lambda z: z["p"] != z["q"]))
    one_side = F.col("da").isNull() | F.col("db").isNull()
    ratio = F.when(one_side | (F.abs(F.size("ca") - F.size("cb")) > 1), 1.0).otherwise(F.when(least > 0, differ / least).otherwise(0.0))
    same = ~one_side & F.col("ta").eqNullSafe(F.col("tb"))
    return both.select(
        F.coalesce("da", "db").alias("doc_id"), F.coalesce("pa", "pb").alias("page"), ratio.alias("ratio"), same.alias("same_text")
    ).withColumn("match", F.col("ratio") <= tolerance)


def equal_page_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, pages_a, pages_b, same: documents whose page counts differ are a mismatch, without page rows to compare."""
    count = lambda df, name: df.groupBy(F.col("doc_id").alias(f"of_{name}")).agg(F.count("*").alias(f"pages_{name}"))
    both = count(a, "a").join(count(b, "b"), F.col("of_a") == F.col("of_b"), "full_outer")
    n = [F.coalesce(c, F.lit(0)) for c in ("pages_a", "pages_b")]
    return both.select(F.coalesce("of_a", "of_b").alias("doc_id"), n[0].alias("pages_a"), n[1].alias("pages_b"), (n[0] == n[1]).alias("same"))


def compare_documents(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """doc_id, match, max_ratio, pages: documents of unequal page counts do not match and have ratio 1 and no pages compared."""
    counts = equal_page_counts(a, b)
    equal = counts.filter("same").select(F.col("doc_id").alias("equal_id"))
    kept = lambda df: df.join(equal, F.col("doc_id") == F.col("equal_id"), "left_semi")
    unequal = counts.filter("not same").select("doc_id", F.lit(False).alias("match"), F.lit(1.0).alias("max_ratio"), F.lit(0).cast("bigint").alias("pages"))
    return document_verdict(compare_pages(kept(a), kept(b), tolerance)).unionByName(unequal)


def joined_to_page_files(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The page plan with the bytes of each page's file; a page without one, or with one of another version than V6, has null."""
    v6 = files.filter(F.col("version") == "V6").select(F.col("doc").alias("file_doc"), F.col("page_id").alias("file_page"), "bytes")
    return plan.join(v6, (F.col("doc") == F.col("file_doc")) & (F.col("page_id") == F.col("file_page")), "left").drop("file_doc", "file_page")


def joined_to_source(plan: DataFrame, source: DataFrame) -> DataFrame:
    """The page plan with width and height of the source page each shows; source pages count from 1 and may be shown many times.

    A page with source -1 is blank: it gets the document's usual size, that of the first page in order that shows a valid source
    page, else of source page 1.
    """
    sized = source.select(F.col("doc").alias("source_doc"), F.col("number"), F.col("width"), F.col("height"))
    both = plan.join(sized, (F.col("doc") == F.col("source_doc")) & (F.col("source_page") + 1 == F.col("number")), "left")
    size = F.struct("width", "height")
    usual = both.groupBy(F.col("doc").alias("of")).agg(F.min_by(F.when(F.col("number").isNotNull(), size), F.when(F.col("number").isNotNull(), F.col("page_index"))).alias("usual"))
    first = sized.filter("number = 1").select(F.col("source_doc").alias("first_doc"), size.alias("first"))
    filled = both.join(usual, F.col("doc") == F.col("of"), "left").join(first, F.col("doc") == F.col("first_doc"), "left")
    own = F.when(F.col("number").isNotNull(), size).otherwise(F.coalesce("usual", "first"))
    return filled.select(*plan.columns, F.col("number").isNull().alias("blank"), own["width"].alias("width"), own["height"].alias("height"))


def document_verdict(compared: DataFrame) -> DataFrame:
    return compared.groupBy("doc_id").agg(F.bool_and("match").alias("match"), F.max("ratio").alias("max_ratio"), F.count("*").alias("pages"))


def sorted_concat(df: DataFrame, key: str, order: list[str], body: Column, separator: str) -> DataFrame:
    """The bodies of each key in order, joined: a bundle is one document, so its parts meet in one row."""
    part = F.struct(*order, body.alias("body"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["body"]), separator).alias("bundle"))
