"""Sources over file trees: Markdown and source files, notebook archives (zip), session logs.

Spark's file scans leave out files of no bytes; the text sources add them from the listing.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Archive members by their ending; the pages' own files end in .rm.
_PARTS = {"content": ".content", "metadata": ".metadata", "pagedata": ".pagedata", "pdf": ".pdf"}
_ARCHIVE = "path string, uuid string, content binary, metadata binary, pagedata binary, pdf binary, pages array<struct<page_id:string,bytes:binary>>"


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files of no bytes below ``path``; like Spark's scans without names that begin with ``_`` or a dot."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        status = listed.next()
        if not status.getLen() and status.getPath().getName()[0] not in "_.":
            found.append((status.getPath().toString(), b""))
    return spark.createDataFrame(found, "path string, content binary")


def _all_files(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("path", "content").unionByName(_empty_files(spark, path))


def _is_markdown() -> Column:
    return F.lower("path").endswith(".md")


def bundle_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """place, abs_path, title, text of Markdown files and folders in the order of the arguments.

    A folder's files follow in the order of their lower-case titles, which are relative paths without the ending; a file's title
    is its name. A file that comes twice counts once, at its first place; a blank argument is left out and one that is no Markdown file fails.
    """
    found = None
    for ordinal, path in enumerate(p.strip() for p in paths):
        if not path:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
        if not folder and not path.lower().endswith(".md"):
            raise ValueError(f"not a Markdown file: {path}")
        rows = _text(_all_files(spark, path).filter(_is_markdown()), path if folder else path.rsplit("/", 1)[0])
        one = rows.select(F.lit(ordinal).alias("ordinal"), "abs_path", F.regexp_replace("rel_path", r"\.[^.]*$", "").alias("title"), "text")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "place long, abs_path string, title string, text string")
    listed = found.select("ordinal", "abs_path", "title")
    once = listed.withColumn("nth", F.row_number().over(Window.partitionBy("abs_path").orderBy("ordinal"))).filter("nth = 1")
    # the names alone are numbered in one place; a bundle is one document
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ordinal", F.lower("title"), "abs_path")).cast("long")
    numbered = once.select(place.alias("place"), F.col("ordinal").alias("own"), F.col("abs_path").alias("own_path"))
    return found.join(numbered, (F.col("ordinal") == F.col("own")) & (F.col("abs_path") == F.col("own_path"))).select("place", "abs_path", "title", "text")


def markdown_inputs(spark: SparkSession, path: str) -> DataFrame:
    """abs_path, rel_path, text of every Markdown file below ``path`` (ending in any case), by lower-case path."""
    return _text(_all_files(spark, path).filter(_is_markdown()), path).orderBy(F.lower("abs_path"), "abs_path")


def source_inputs(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """abs_path, rel_path, text of every file that is not Markdown; with ``extensions``, of those endings only."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = _all_files(spark, path).filter(ending != "md")
    if extensions:
        found = found.filter(ending.isin([e.lower().lstrip(".") for e in extensions]))
    return _text(found, path).orderBy("abs_path")


def _text(files: DataFrame, path: str) -> DataFrame:
    root = path.rstrip("/") + "/"
    after = F.locate(root, F.col("path")) + len(root)
    relative = F.when(F.locate(root, F.col("path")) > 0, F.expr("path").substr(after, F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(F.col("path").alias("abs_path"), relative.alias("rel_path"), F.decode("content", "UTF-8").alias("text"))


def _opened(path: str, data: bytes) -> dict:
    """An archive's parts; the one .content file names the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        contents = [n for n in names if n.endswith(".content")]
        if len(contents) != 1:
            raise ValueError(f"{path}: {len(contents)} content files instead of one")
        stem = contents[0].removesuffix(".content").rsplit("/", 1)[-1]
        row = {"path": path, "uuid": stem if _UUID.fullmatch(stem) else None}
        for part, ending in _PARTS.items():
            found = next((n for n in names if n.endswith(ending)), None)
            row[part] = z.read(found) if found else None
        row["pages"] = [{"page_id": n.rsplit("/", 1)[-1].removesuffix(".rm"), "bytes": z.read(n)} for n in sorted(names) if n.endswith(".rm")]
    return row


def archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per notebook archive (*.zip, *.rmdoc) below ``path``, each opened once, in a task.

    Parts that an archive lacks are null. None or several .content files, or a broken zip, fail the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = pa.list_(pa.struct([("page_id", pa.string()), ("bytes", pa.binary())]))
        kinds = [("path", pa.string()), ("uuid", pa.string()), *((p, pa.binary()) for p in _PARTS), ("pages", page)]
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([_opened(name, data)], schema=pa.schema(kinds))

    return _files(spark, path, "*.{zip,rmdoc}").select("path", "content").mapInArrow(run, _ARCHIVE)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """path, place, member, size of every file in the archives below ``path``, in the archive's own order; folders are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    inside = [i for i in z.infolist() if not i.is_dir()]
                columns = ([name] * len(inside), list(range(len(inside))), [i.filename for i in inside], [i.file_size for i in inside])
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "place", "member", "size"])

    return _files(spark, path, "*.{zip,rmdoc}").select("path", "content").mapInArrow(run, "path string, place int, member string, size bigint")


def manifest_entry(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """The rows of a JSON manifest (an array of objects, or one object a line) that have this id."""
    return spark.read.json(path, multiLine=True).filter(F.col("id") == doc_id)


def page_files(opened: DataFrame) -> DataFrame:
    """path, uuid, page_id, size, header (the first 43 bytes) and bytes of every page file of ``archives``."""
    one = opened.select("path", "uuid", F.explode("pages").alias("page"))
    return one.select(
        "path", "uuid", "page.page_id", F.octet_length("page.bytes").cast("bigint").alias("size"),
        F.decode(F.substring("page.bytes", 1, 43), "ISO-8859-1").alias("header"), "page.bytes",
    )


def session_logs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON session logs, a file an object or array, read with a stated schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def session_variants(spark: SparkSession, path: str) -> DataFrame:
    """session (VARIANT) of JSON logs of any shape: a file is an object, or an array of them, and no schema is asked for.

    Files are read once; a file that is no JSON gives a null session.
    """
    whole = spark.read.options(multiLine=True, singleVariantColumn="whole").json(path)
    many = F.try_variant_get("whole", "$", "array<variant>")
    return whole.select(F.explode(F.coalesce(many, F.array("whole"))).alias("session"))


def session_calls(sessions: DataFrame, calls: str, own: dict[str, str], texts: dict[str, str], typed: dict[str, str]) -> DataFrame:
    """A row per call: the session's ``own`` values, position from 0, and the call's ``texts`` and ``typed`` values, each a name and a path.

    A text is a scalar's text or an object's JSON; a typed value keeps its JSON form (``"7"`` and ``7`` differ). What is missing, or lies
    below something that is no object, is null. A session whose calls are missing or no array has no rows.
    """
    text_at = lambda v, p: F.try_variant_get(v, p, "string")
    found = F.try_variant_get("session", calls, "array<variant>")
    one = sessions.select(*[text_at("session", p).alias(n) for n, p in own.items()], F.posexplode(found).alias("position", "call"))
    kept = [F.to_json(F.try_variant_get("call", p, "variant")).alias(n) for n, p in typed.items()]
    return one.select(*own, "position", *[text_at("call", p).alias(n) for n, p in texts.items()], *kept)
