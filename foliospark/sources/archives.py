"""Notebook archives (zip) as tables of members: compiled from rows, written in two phases, looked up by page.

An archive's members are rows until the moment they are packed, so no row holds a whole document. Look-ups read an archive's
directory, filter and join its rows, and fetch the bytes of the members that are left; the rest of the file is never read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, closing
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from foliospark.functions.identity import identity, named_uuid
from foliospark.functions.ink import file_version, page_letters
from foliospark.sources.pagefile import HEADER_BYTES
from foliospark.sources.pagewriter import page_file

# The one version of the drawing language, its canvas and the canvas' size.
VERSION, SPACE, WIDTH, HEIGHT = "v0", "rm_screen_v6", 1404, 1872
FIRST = "1:1"


def _required(value: Column, holds: Column, message: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.col("doc").cast("string"), F.lit("null")))).cast("string"))


def compiled(documents: DataFrame, pages: DataFrame, namespace: str) -> DataFrame:
    """doc, uuid, name, page_index, page_id, template, width, height, strokes of every page that will be written.

    ``documents`` has doc (unique), name, version and own_id, ``pages`` doc, page_index (from 0, no gaps), page_id, template, space,
    width, height and strokes (``pagewriter.STROKES``). A null or empty version, space, template or page id and a null or zero size get
    their defaults. A blank name, another version or space and a document without pages fail; pages of no document are left out.
    A document's identity is its own_id if that is a UUID, else named by it (by the document's name if it has none) below
    ``namespace``; a page id that is no UUID names one below its document.
    """
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    sized = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, default).otherwise(F.col(c))
    name = _required(F.col("name"), F.coalesce(F.col("name"), F.lit("")) != "", "a document needs a name")
    named = documents.select("doc", _required(name, filled("version", VERSION) == VERSION, "the version is not known").alias("name"), "own_id")
    own = F.coalesce(F.nullif(F.col("own_id"), F.lit("")), named_uuid(F.lit(namespace), F.col("name")))
    known = named.select("doc", "name", identity(F.lit(namespace), own).alias("uuid"))
    drawn = pages.select(F.col("doc").alias("page_doc"), "page_index", "page_id", "template", "space", "width", "height", "strokes")
    both = known.join(drawn, F.col("doc") == F.col("page_doc"), "left")
    fits = F.col("page_index").isNotNull()
    title = _required(_required(F.col("name"), fits, "a document needs pages"), filled("space", SPACE) == SPACE, "the canvas is not known")
    called = F.coalesce(F.nullif(F.col("page_id"), F.lit("")), F.concat(F.lit("page-"), (F.col("page_index") + 1).cast("string")))
    return both.select(
        "doc", "uuid", title.alias("name"), "page_index", identity(F.col("uuid"), called).alias("page_id"), filled("template", "Blank").alias("template"),
        sized("width", WIDTH).alias("width"), sized("height", HEIGHT).alias("height"), "strokes",
    )


def _stamped(value: Column) -> Column:
    return F.struct(F.lit(FIRST).alias("timestamp"), value.alias("value"))


def content_json(pages: Column, width: Column, height: Column, author: Column, author_number: int, now_ms: int) -> Column:
    """The content file of a notebook with ``pages`` (page_index, page_id, template) in order."""
    page = F.transform(
        pages,
        lambda p: F.struct(
            p["page_id"].alias("id"), _stamped(page_letters(p["page_index"])).alias("idx"), F.lit(str(now_ms)).alias("modifed"), _stamped(p["template"]).alias("template")
        ),
    )
    none, nobody = F.from_json(F.lit("{}"), "map<string,string>"), F.array().cast("array<string>")
    last = F.element_at(pages, -1)["page_id"]
    writers = F.array(F.struct(author.alias("first"), F.lit(author_number).alias("second")))
    # The fields of the content file and what a plain notebook has in them.
    fields = {
        "cPages": F.struct(_stamped(last).alias("lastOpened"), _stamped(F.lit(-1)).alias("original"), page.alias("pages"), writers.alias("uuids")),
        "coverPageNumber": F.lit(-1), "customZoomCenterX": F.lit(0), "customZoomCenterY": F.floor(height / 2).cast("int"),
        "customZoomOrientation": F.lit("portrait"), "customZoomPageHeight": height, "customZoomPageWidth": width, "customZoomScale": F.lit(1),
        "documentMetadata": none, "extraMetadata": none, "fileType": F.lit("notebook"), "fontName": F.lit(""), "formatVersion": F.lit(2),
        "lineHeight": F.lit(-1), "orientation": F.lit("portrait"), "pageCount": F.size(pages), "pageTags": nobody, "tags": nobody,
        "textAlignment": F.lit("justify"), "textScale": F.lit(1), "zoomMode": F.lit("bestFit"),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def metadata_json(name: Column, pages: Column, now_ms: int) -> Column:
    """The metadata file of a new document of the root folder."""
    now = F.lit(str(now_ms))
    # The fields of the metadata file.
    fields = {
        "createdTime": now, "lastModified": now, "lastOpened": now, "lastOpenedPage": F.size(pages) - 1, "new": F.lit(False), "parent": F.lit(""),
        "pinned": F.lit(False), "source": F.lit(""), "type": F.lit("DocumentType"), "visibleName": name,
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def members(made: DataFrame, namespace: str, title: str, now_ms: int, author_number: int = 1) -> DataFrame:
    """uuid, place, member, bytes of the archives of ``compiled`` pages: content, metadata, then the page files.

    ``title`` begins the header of page files (``page_file``). Only the pages' ids meet in a document's row, never their strokes.
    """
    head = F.min_by(F.struct("width", "height"), "page_index")
    listed = F.array_sort(F.collect_list(F.struct("page_index", "page_id", "template")))
    one = made.groupBy("uuid", "doc", "name").agg(listed.alias("pages"), head.alias("canvas"))
    writer = named_uuid(F.lit(namespace), F.concat(F.lit("author:"), F.col("uuid")))
    sized = (F.col("canvas.width") > 0) & (F.col("canvas.height") > 0)
    size = [F.when(sized, F.col(f"canvas.{c}")).otherwise(d) for c, d in (("width", WIDTH), ("height", HEIGHT))]
    about = F.array(
        F.struct(F.lit(0).alias("place"), F.lit(".content").alias("ending"), content_json(F.col("pages"), *size, writer, author_number, now_ms).alias("json")),
        F.struct(F.lit(1).alias("place"), F.lit(".metadata").alias("ending"), metadata_json(F.col("name"), F.col("pages"), now_ms).alias("json")),
    )
    texts = one.select("uuid", F.inline(about)).select("uuid", "place", F.concat("uuid", "ending").alias("member"), F.encode("json", "UTF-8").alias("bytes"))
    drawn = made.select(
        "uuid", (F.col("page_index") + 2).cast("int").alias("place"), F.concat("uuid", F.lit("/"), "page_id", F.lit(".rm")).alias("member"), page_file(F.col("strokes"), title).alias("bytes")
    )
    return texts.unionByName(drawn)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a path as Spark writes it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


_LIMIT32, _FLUSH = 0xFFFFFFFF, 1 << 20


class Packer:
    """Writes an archive of deflated members to a stream that need not seek; holds the directory's rows and at most a flush of bytes.

    The members lie whole in memory, so sizes and checksums stand before their bytes.
    """

    def __init__(self, out: pa.NativeFile):
        self.out, self.at, self.entries, self.waiting, self.held = out, 0, [], [], 0

    def _put(self, *parts: bytes) -> None:
        self.waiting += parts
        n = sum(map(len, parts))
        self.at, self.held = self.at + n, self.held + n
        if self.held >= _FLUSH:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.out.write(b"".join(self.waiting))
        self.waiting, self.held = [], 0

    def add(self, member: str, data: bytes) -> None:
        try:
            name, flags = member.encode("ascii"), 0
        except UnicodeEncodeError:
            name, flags = member.encode(), 0x800
        pack = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        packed = pack.compress(data) + pack.flush()
        # Deflate, the first day that an archive can name, and an owner's file.
        about = struct.pack("<5H3L", 20, flags, zipfile.ZIP_DEFLATED, 0, 0x21, zlib.crc32(data), len(packed), len(data))
        far = self.at >= _LIMIT32
        extra = struct.pack("<HHQ", 1, 8, self.at) if far else b""
        place = struct.pack("<5H2L", len(name), len(extra), 0, 0, 0, 0o600 << 16, _LIMIT32 if far else self.at)
        self.entries.append(b"PK\1\2" + struct.pack("<H", 3 << 8 | (45 if far else 20)) + about + place + name + extra)
        self._put(b"PK\3\4", about, struct.pack("<2H", len(name), 0), name, packed)

    def close(self) -> None:
        start, count = self.at, len(self.entries)
        for entry in self.entries:
            self._put(entry)
        size = self.at - start
        if count > 0xFFFF or start > _LIMIT32 or size > _LIMIT32:
            end = self.at
            self._put(b"PK\6\6", struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, count, count, size, start), b"PK\6\7", struct.pack("<LQL", 0, end, 1))
        small = min(count, 0xFFFF)
        self._put(b"PK\5\6", struct.pack("<4H2LH", 0, 0, small, small, min(size, _LIMIT32), min(start, _LIMIT32), 0))
        self._flush()


@dataclass
class Written(WriterCommitMessage):
    """The staging folder of one task's archives; None for a task without rows."""

    folder: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """Packs rows (uuid, place, member, bytes), sorted by uuid and place, into one file a uuid.

    A task writes into a staging folder of its own; the commit moves each winning task's folder into place, so a lost, repeated or
    failed task leaves nothing behind. The driver handles one name a task. The store must be able to rename folders.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        folder, own, seen = f"{root}/_staging-{self.job}/{uuid.uuid4().hex}", None, set()
        with ExitStack() as last:
            for batch in iterator:
                for name, member, data in zip(*(batch.column(c).to_pylist() for c in ("uuid", "member", "bytes")), strict=True):
                    if name != own:
                        last.close()
                        if own is None:
                            store.create_dir(folder, recursive=True)
                        own, seen = name, set()
                        packer = Packer(last.enter_context(store.open_output_stream(f"{folder}/{own}.rmdoc")))
                        last.enter_context(closing(packer))
                    if member in seen:
                        raise ValueError(f"{own}: two members are called {member}")
                    seen.add(member)
                    packer.add(member, data)
        return Written(None if own is None else folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        staging = f"{root}/_staging-{self.job}"
        before = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name[0] != "_"]
        for number, message in enumerate(messages):
            if message is not None and message.folder:
                store.move(message.folder, f"{root}/{self.job}-{number:05d}")
        for old in before if self.overwrite else ():
            store.delete_dir(old)
        self._clear(store, staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        self._clear(store, f"{root}/_staging-{self.job}")

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class ArchiveSink(DataSource):
    """``df.write.format("notebook_archives").save(path)`` of sorted members."""

    @classmethod
    def name(cls) -> str:
        return "notebook_archives"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(rows: DataFrame, path: str, force: bool = False) -> None:
    """Write ``members`` as ``<uuid>.rmdoc`` files below ``path``; a path that exists fails before any page is made, unless forced.

    One task writes an archive, a member at a time. Two documents of one identity fail, as do two pages of one.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(path)
    spark.dataSource.register(ArchiveSink)
    placed = rows.select("uuid", "place", "member", "bytes").repartition("uuid").sortWithinPartitions("uuid", "place")
    placed.write.format("notebook_archives").mode("overwrite" if force else "append").save(path)


def delete_archives(spark: SparkSession, path: str) -> None:
    """Delete the folder of ``write_archives``: tasks delete the folders below it, as a store takes its time for many small files."""
    store, root = _store(path)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return
    below = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
    if below:
        spark.sparkContext.parallelize(below, len(below)).foreach(lambda folder: _store(path)[0].delete_dir(folder))
    store.delete_dir(root)


class Ranged(io.RawIOBase):
    """A store's file for readers that expect an OSError where they seek before its beginning."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if start + offset < 0:
            raise OSError("before the beginning of the file")
        return self.file.seek(start + offset)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _listed(file: io.IOBase) -> list[tuple]:
    """place, member, at, packed, size, method, crc of the files in an archive; reads the directory at its end alone."""
    with zipfile.ZipFile(file) as z:
        inside = [i for i in z.infolist() if not i.is_dir()]
    return [(n, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for n, i in enumerate(inside)]


def _fetched(file: io.IOBase, member: str, at: int, packed: int, method: int, crc: int) -> bytes:
    """One member's bytes, checked; reads its local header and its own range."""
    file.seek(at)
    name, extra = struct.unpack("<26xHH", file.read(30))
    file.seek(at + 30 + name + extra)
    raw = file.read(packed)
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{member}: compression {method} is not supported")
    data = zlib.decompress(raw, -15) if method else raw
    if zlib.crc32(data) != crc:
        raise ValueError(f"{member}: the checksum is wrong")
    return data


_ENTRY = "path string, place int, member string, at bigint, packed bigint, size bigint, method int, crc bigint"
_ENTRY_ARROW = [("place", pa.int32()), ("member", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())]


def _named(path: str) -> str:
    """A path as Spark names it."""
    return path if ":" in path.split("/")[0] else f"file:{path}"


def _archive_files(spark: SparkSession, path: str) -> DataFrame:
    """path of every archive below a folder, listed and dealt out by tasks: the driver holds no name.

    One task lists the folder itself, others what lies below. Hidden names are passed over, as Spark does.
    """
    top, (_, plain_top) = _named(path).rstrip("/"), _store(path)

    def seen(info: fs.FileInfo) -> bool:
        parts = info.path[len(plain_top.rstrip("/")) :].strip("/").split("/")
        return not any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in parts)

    def chunks(found: Iterator[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
        whole = iter([i for i in found if seen(i) and (i.type == fs.FileType.Directory or i.base_name.endswith((".zip", ".rmdoc")))])
        while some := list(islice(whole, 8192)):
            names = [top + i.path[len(plain_top.rstrip("/")) :] for i in some]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([i.type == fs.FileType.Directory for i in some])], ["path", "folder"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, plain = _store(path)
        for batch in batches:
            if batch.num_rows:
                yield from chunks(store.get_file_info(fs.FileSelector(plain)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders = [n for n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True) if f]
            yield batch.filter(pc.invert(batch.column(1)))
            for name in folders:
                store, plain = _store(name)
                for part in chunks(store.get_file_info(fs.FileSelector(plain, recursive=True))):
                    yield part.filter(pc.invert(part.column(1)))

    kind = "path string, folder boolean"
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = spark.range(1, numPartitions=1).mapInArrow(first, kind).repartition(tasks, "path").mapInArrow(below, kind)
    return found.repartition(tasks, "path").select("path")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """A row per file in the archives (*.zip, *.rmdoc) below ``path``, in the archive's order, with the place of its bytes.

    Tasks list the archives and read the directory at the end of each. A broken archive fails the scan. A path that is no folder is one for Spark to list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name in batch.column("path").to_pylist():
                store, plain = _store(name)
                with store.open_input_file(plain) as file:
                    rows = _listed(Ranged(file))
                names += [name] * len(rows)
                found += rows
                if len(found) >= BATCH_ENTRIES:
                    yield _entries(names, found)
                    names, found = [], []
            if found:
                yield _entries(names, found)

    store, plain = _store(path)
    if store.get_file_info(plain).type == fs.FileType.Directory:
        return _archive_files(spark, path).mapInArrow(run, _ENTRY)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,rmdoc}").load(path)
    return files.select("path").mapInArrow(run, _ENTRY)


#: Rows of directories, and bytes of members, that go back to Spark together; bytes that lie side by side are read together up to as many.
BATCH_ENTRIES, BATCH_BYTES = 4096, 4 << 20


def _entries(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names, pa.string()), *(pa.array(c, k) for c, (_, k) in zip(columns, _ENTRY_ARROW, strict=True))], ["path", *(n for n, _ in _ENTRY_ARROW)])


def _ending(row: dict) -> int:
    """The place behind a member whose local header has nothing but its name."""
    return row["at"] + 30 + len(row["member"].encode()) + row["packed"]


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows whose members lie side by side in one archive."""
    run: list[dict] = []
    for row in rows:
        if run and not (row["path"] == run[-1]["path"] and row["at"] == _ending(run[-1]) and _ending(row) - run[0]["at"] <= BATCH_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def with_bytes(entries: DataFrame) -> DataFrame:
    """path, place, member, bytes of rows of ``directory``: filter and join them first, only what is left is read.

    A member that fails its checksum or is packed by another method than deflate fails.
    """
    names = ["path", "place", "member", "bytes"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as last:
            own = file = None
            for batch in batches:
                rows, held = [], 0
                for part in _runs(batch.to_pylist()):
                    if part[0]["path"] != own:
                        last.close()
                        store, plain = _store(part[0]["path"])
                        own, file = part[0]["path"], last.enter_context(store.open_input_file(plain))
                    start, side = part[0]["at"], b""
                    if len(part) > 1:
                        file.seek(start)
                        side = file.read(_ending(part[-1]) - start)
                    for row in part:
                        at = row["at"] - start
                        # a local header may say more than the name, also behind the last of them
                        inside = at + 30 <= len(side) and at + 30 + sum(struct.unpack_from("<26xHH", side, at)) + row["packed"] <= len(side)
                        source = (io.BytesIO(side), at) if inside else (file, row["at"])
                        data = _fetched(source[0], row["member"], source[1], row["packed"], row["method"], row["crc"])
                        rows.append((own, row["place"], row["member"], data))
                        held += len(data)
                        if held >= BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    columns = [n.split()[0] for n in _ENTRY.split(", ")]
    return entries.select(*columns).mapInArrow(run, "path string, place int, member string, bytes binary")


def page_id_of(member: Column) -> Column:
    """The page that a member's name means; null for members that are no page files."""
    name = F.substring_index(member, "/", -1)
    return F.when(member.endswith(".rm"), name.substr(F.lit(1), F.length(name) - 3))


def find_pages(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, page_id, version, size, bytes of the pages of ``wanted`` (page_id; repeats count once) in each archive of a ``directory``.

    Of several members for one page the first in the archive's order counts. An id that no archive has gives no row, a null one neither;
    an empty one fails. The version is ``unknown`` where the header does not say.
    """
    asked = wanted.select(F.when(F.col("page_id") == "", F.raise_error(F.lit("a page id is empty")).cast("string")).otherwise(F.col("page_id")).alias("asked")).filter("asked is not null").distinct()
    pages = entries.withColumn("page_id", page_id_of(F.col("member"))).filter("page_id is not null")
    hit = pages.join(asked, F.col("page_id") == F.col("asked"), "left_semi")
    row = F.struct("place", "member", "at", "packed", "size", "method", "crc")
    first = hit.groupBy("path", "page_id").agg(F.min_by(row, "place").alias("first")).select("path", "first.*")
    read = with_bytes(first.sortWithinPartitions("path", "place"))
    header = F.decode(F.substring("bytes", 1, HEADER_BYTES), "ISO-8859-1")
    size = F.octet_length("bytes").cast("bigint")
    version = F.coalesce(F.when(size >= HEADER_BYTES, file_version(header)), F.lit("unknown"))
    return read.select("path", page_id_of(F.col("member")).alias("page_id"), version.alias("version"), size.alias("size"), "bytes")
