"""Markdown rewriting: literal regions, lists, images, source wraps and bundles.

Only the scan for literal regions and the renaming of images depend on what came before in a text; these are Arrow
functions over one document's lines. All else is an expression on the lines, so a document is rewritten in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import code_fence, is_list_line, is_remote_target, language_of, list_level, reference_label, without_front_matter

_FENCE = re.compile("`{3,}|~{3,}")
_WHITE = " \t\r\f\x0b"
PAGE_BREAK = "```{=latex}\n\\newpage\n```\n\n"
# The patterns of inline images, reference images and reference definitions.
INLINE_IMAGE = r"!\[((?:\\.|[^\]])*)\]\((<[^>\n]*>|[^)\n]+)\)"
REFERENCE_IMAGE = r"!\[([^\]]*)\]\[([^\]]*)\]"
REFERENCE_DEFINITION = r"(?m)^([ \t]{0,3})\[([^\]]+)\]:[ \t]*(<[^>]+>|\S+)([^\n]*)$"


def _ends(mark: str, line: str, bare: str) -> bool:
    """Whether a line has the mark behind an even number of backslashes."""
    return any((m.start() - len(line[: m.start()].rstrip("\\"))) % 2 == 0 for m in re.finditer(re.escape(mark), line))


def _closes(run: str, line: str, bare: str) -> bool:
    """Whether a line is nothing but a fence of the same kind, as long as ``run`` or longer."""
    return set(bare) == {run[0]} and len(bare) >= len(run)


def literal_lines(lines: list[str]) -> list[bool]:
    """Which lines belong to fenced code or display mathematics, delimiters included; open regions last to the end."""
    flags, over = [], None
    for line in lines:
        bare = line.strip()
        if over:
            flags.append(True)
            over = None if over(line, bare) else over
            continue
        fence = _FENCE.match(bare)
        opens = "$$" if bare.startswith("$$") else "\\]" if bare.startswith("\\[") else ""
        if fence and not (bare[0] == "`" and "`" in bare[fence.end() :]):
            over = partial(_closes, fence[0])
        elif opens and not _ends(opens, bare[2:], bare):
            over = partial(_ends, opens)
        flags.append(bool(over or opens))
    return flags


def _flag_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([literal_lines((t or "").split("\n")) for t in batch.to_pylist()], pa.list_(pa.bool_()))


def literal_flags(text: Column) -> Column:
    """array<boolean> over the lines of a text; null is one empty line."""
    return F.arrow_udf(_flag_batches, "array<boolean>")(text)


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with lines and literal, the inputs of the list rewrites."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("literal", literal_flags(own)).withColumn("lines", F.split(own, "\n"))


def spaced_lists() -> Column:
    """The text with an empty line before each list that follows a line of text; literal lines stay."""

    def spaced(line: Column, i: Column) -> Column:
        before, free_before = F.get("lines", i - 1), ~F.get("literal", i - 1)
        gap = ~F.get("literal", i) & is_list_line(line) & (i > 0) & (F.trim(before, F.lit(_WHITE)) != "") & ~(free_before & is_list_line(before))
        return F.concat(F.when(gap, "\n").otherwise(""), line)

    return F.array_join(F.transform("lines", spaced), "\n")


def flattened_lists(depth: int = 4) -> Column:
    """The text with list lines deeper than ``depth`` (1 at least) moved to that depth; literal lines stay."""
    depth = max(1, depth)

    def flat(line: Column, i: Column) -> Column:
        deep = ~F.get("literal", i) & (list_level(line) > depth)
        return F.when(deep, F.concat(F.lit("  " * (depth - 1)), F.ltrim(line, F.lit(" \t")))).otherwise(line)

    return F.array_join(F.transform("lines", flat), "\n")


def split_target(target: Column) -> Column:
    """struct<path, suffix> of an image target; a blank one, and one whose ``<`` is not closed, are null."""
    bare = F.trim(target, F.lit(_WHITE + "\n"))
    end = F.locate(">", bare)
    angled = F.struct(F.substring(bare, F.lit(2), end - 2).alias("path"), F.substring(bare, end + 1, F.length(bare)).alias("suffix"))
    path = F.regexp_extract(bare, r"^[^ \t\r\n]*", 0)
    plain = F.struct(path.alias("path"), F.substring(bare, F.length(path) + 1, F.length(bare)).alias("suffix"))
    return F.when(bare == "", None).when(bare.startswith("<"), F.when(end > 0, angled)).otherwise(plain)


def written_target(path: Column) -> Column:
    """In angle brackets if it holds blanks or parentheses."""
    return F.when(path.rlike(r"[ \t()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path)


def safe_alt(alt: Column) -> Column:
    """Backslashes and square brackets as character references."""
    marks = (("\\", "&#92;"), ("[", "&#91;"), ("]", "&#93;"))
    for mark, reference in marks:
        alt = F.replace(alt, F.lit(mark), F.lit(reference))
    return alt


def image_targets(text: Column) -> Column:
    """The targets of inline images, in order."""
    return F.regexp_extract_all(text, F.lit(INLINE_IMAGE), F.lit(2))


def image_labels(text: Column) -> Column:
    """The distinct labels that reference images use; a collapsed one is its alt text."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(REFERENCE_IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(text, F.lit(REFERENCE_IMAGE), F.lit(2)).alias("label"))
    return F.array_distinct(F.transform(pairs, lambda p: reference_label(F.when(p["label"] == "", p["alt"]).otherwise(p["label"]))))


def image_definitions(text: Column) -> Column:
    """array<struct<label, destination>> of the reference definitions that images use."""
    part = lambda k: F.regexp_extract_all(text, F.lit(REFERENCE_DEFINITION), F.lit(k))
    found = F.arrays_zip(part(2).alias("label"), part(3).alias("destination"))
    return F.filter(found, lambda d: F.array_contains(image_labels(text), reference_label(d["label"])))


def is_local_target(path: Column) -> Column:
    """Whether a path stays below its folder: no URL, not absolute, and its ``..`` parts never lead out."""
    steps = F.transform(F.split(path, "/"), lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))
    least = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.least(acc["least"], acc["at"] + s).alias("least")),
    )
    return (path != "") & ~is_remote_target(path) & ~path.startswith("/") & (least["least"] >= 0)


def _staged(text: str, present: dict[str, str], prefix: str) -> tuple[str, list[tuple[str, str]]]:
    """A text whose present images point to ./images, and the copies (source, name) to make, in order."""
    used: set[str] = set()
    copies: list[tuple[str, str]] = []

    def stage(path: str) -> str | None:
        if path not in present:
            return None
        base = prefix + present[path].rsplit("/", 1)[-1]
        dot = base.rfind(".") if "." in base else len(base)
        name, k = base, 1
        while name in used:
            name, k = f"{base[:dot]}-{k}{base[dot:]}", k + 1
        used.add(name)
        copies.append((present[path], name))
        return f"<./images/{name}>" if re.search(r"[ \t()]", name) else f"./images/{name}"

    def inline(m: re.Match) -> str:
        bare = m[2].strip()
        cut = re.match(r"<([^>]*)>(.*)|(\S*)(.*)", bare, re.S)
        path, suffix = (cut[1], cut[2]) if cut[1] is not None else (cut[3], cut[4])
        new = stage(path)
        return m[0] if new is None else f"![{m[1]}]({new}{suffix})"

    text = re.sub(INLINE_IMAGE, inline, text)
    labels = {" ".join((b or a).split()).lower() for a, b in re.findall(REFERENCE_IMAGE, text)}

    def definition(m: re.Match) -> str:
        new = stage(m[3].strip("<>")) if " ".join(m[2].split()).lower() in labels else None
        return m[0] if new is None else f"{m[1]}[{m[2]}]: {new}{m[4]}"

    return re.sub(REFERENCE_DEFINITION, definition, text), copies


_STAGED = "struct<text:string,copies:array<struct<source:string,name:string>>>"
_STAGED_ARROW = pa.struct([("text", pa.string()), ("copies", pa.list_(pa.struct([("source", pa.string()), ("name", pa.string())])))])


def _stage_batches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, present, prefixes in batches:
        rows = []
        for text, pairs, prefix in zip(texts.to_pylist(), present.to_pylist(), prefixes.to_pylist(), strict=True):
            new, copies = _staged(text or "", {p["path"]: p["source"] for p in pairs or []}, prefix or "")
            rows.append({"text": new, "copies": [{"source": a, "name": b} for a, b in copies]})
        yield pa.array(rows, _STAGED_ARROW)


def staged_images(docs: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, text, copies: local images that exist are renamed to ./images/<prefix><name>, equal names get -1, -2 and so on.

    ``docs`` has doc_id (unique), text, folder and prefix, ``files`` the distinct paths that exist. URLs, absolute and
    outward paths, and missing files stay as they are. The look-up is a join; only the renaming, which depends on the order, is Python.
    """
    own = F.coalesce(F.col("text"), F.lit(""))
    inline = F.transform(image_targets(own), lambda t: split_target(t)["path"])
    defined = F.transform(image_definitions(own), lambda d: F.regexp_replace(d["destination"], "^[<>]+|[<>]+$", ""))
    wanted = docs.select("doc_id", "folder", F.explode(F.array_distinct(F.concat(inline, defined))).alias("path")).filter(is_local_target(F.col("path")))
    clean = F.regexp_replace(F.regexp_replace("path", r"(^|/)(?:\./)+", "$1"), "/+", "/")
    aimed = wanted.select(F.col("doc_id").alias("of"), "path", F.concat("folder", F.lit("/"), clean).alias("source"))
    there = files.select(F.col("path").alias("there"))
    found = aimed.join(there, F.col("source") == F.col("there"), "left_semi").groupBy("of").agg(F.collect_set(F.struct("path", "source")).alias("present"))
    done = F.arrow_udf(_stage_batches, _STAGED)(F.col("text"), F.col("present"), F.col("prefix"))
    return docs.join(found, F.col("doc_id") == F.col("of"), "left").select("doc_id", done.alias("done")).select("doc_id", "done.*")


def source_page(path: Column, title: Column, code: Column) -> Column:
    """A source text as Markdown: its title (the file's name if blank) and the code in a fence with its language."""
    named = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.regexp_extract(path, "[^/]*$", 0)).otherwise(title)
    end = F.when(code.endswith("\n"), "").otherwise("\n")
    return F.concat(F.lit("# "), named, F.lit("\n\n"), code_fence(code), language_of(path), F.lit("\n"), code, end, code_fence(code), F.lit("\n"))


def bundle_part(title: Column, path: Column, text: Column, spaced: Column | None = None) -> Column:
    """One input of a bundle: its heading and its text without front matter. ``spaced`` is the text with list spacing, if wanted."""
    body = without_front_matter(text) if spaced is None else spaced
    named = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", path).otherwise(F.trim(title))
    return F.concat(F.lit("# "), named, F.lit("\n\n"), body, F.when(body.endswith("\n"), "").otherwise("\n"), F.lit("\n"))
