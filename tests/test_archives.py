"""Archives compiled, written in two phases, listed by their directories and looked up by page."""

import io
import json
import os
import uuid
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions.identity import identity, is_uuid, named_uuid
from foliospark.functions.ink import page_letters
from foliospark.operators import pages, scene
from foliospark.sources import archives, pagefile, pagewriter
from foliospark.sources.pagewriter import STROKES

SPACE = str(uuid.uuid5(uuid.NAMESPACE_OID, "tests"))
OWN = "0c2f5b4e-8d1a-4f7e-9a53-1b2c3d4e5f60"
DOCS = "doc int, name string, version string, own_id string"
PAGES = f"doc int, page_index int, page_id string, template string, space string, width int, height int, strokes {STROKES}"


def drawn(*lengths):
    return [{"tool": 17, "color": 0, "thickness": 2.0, "points": [{"x": float(i), "y": 1.0, "width": 3.0} for i in range(n)]} for n in lengths]


def made(spark, docs, rows):
    return archives.compiled(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, PAGES), SPACE)


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


def test_identities(spark):
    names = ["", "a", "é ü", "x" * 300, OWN]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", named_uuid(F.lit(SPACE), F.col("n")).alias("u"), identity(F.lit("{" + SPACE.upper() + "}"), F.col("n")).alias("i")).collect()
    for r in got:
        want = str(uuid.uuid5(uuid.UUID(SPACE), r["n"]))
        assert (r["u"], r["i"]) == (want, OWN if r["n"] == OWN else want)
    forms = [OWN, OWN.upper(), "{" + OWN + "}", "urn:uuid:" + OWN, OWN.replace("-", ""), OWN[:-1], "", None]
    assert [r[0] for r in spark.createDataFrame([(f,) for f in forms], "f string").select(is_uuid(F.col("f"))).collect()] == [True] * 5 + [False] * 3


def test_page_letters_to_their_end(spark):
    want = {-1: "ba", 0: "ba", 25: "bz", 26: "ca", 649: "zz", 650: "za", 675: "zz", 676: "ba"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in want], "k int").select("k", page_letters(F.col("k"))).collect()}
    assert got == want


def test_round_trip(spark, tmp_path):
    docs = [(1, "Plan", None, None), (2, "Plan B", "v0", OWN)]
    rows = [
        (1, 1, None, "", None, None, None, drawn(3)), (1, 0, "cover", "Lines", "rm_screen_v6", 100, 201, drawn(2, 1)), (2, 0, None, None, "", 0, 0, None),
        (3, 0, "of no document", None, None, None, None, None),
    ]
    archives.write_archives(archives.members(made(spark, docs, rows), SPACE, "made", 1700000000000), str(tmp_path / "out"))
    first = str(uuid.uuid5(uuid.UUID(SPACE), "Plan"))
    assert sorted(os.path.basename(f) for f in files_below(tmp_path)) == sorted([f"{first}.rmdoc", f"{OWN}.rmdoc"])
    entries = archives.directory(spark, str(tmp_path / "out"))
    read = archives.with_bytes(entries.filter(F.col("member").endswith(".content"))).select(F.col("member").alias("doc"), F.decode("bytes", "UTF-8").alias("content"))
    content = {r["doc"]: json.loads(r["content"]) for r in read.collect()}
    own = content[f"{first}.content"]
    cover, second = (str(uuid.uuid5(uuid.UUID(first), n)) for n in ("cover", "page-2"))
    assert (own["customZoomPageWidth"], own["customZoomPageHeight"], own["customZoomCenterY"], own["pageCount"], own["tags"], own["extraMetadata"]) == (100, 201, 100, 2, [], {})
    assert own["cPages"]["uuids"] == [{"first": str(uuid.uuid5(uuid.UUID(SPACE), f"author:{first}")), "second": 1}]
    assert own["cPages"]["lastOpened"] == {"timestamp": "1:1", "value": second}
    assert [(p["id"], p["idx"]["value"], p["template"]["value"], p["modifed"]) for p in own["cPages"]["pages"]] == [(cover, "ba", "Lines", "1700000000000"), (second, "bb", "Blank", "1700000000000")]
    plan = pages.page_plan(read).select("doc", "page_index", "page_id", "source_page").filter(F.col("doc") == f"{first}.content")
    assert sorted(tuple(r)[1:] for r in plan.collect()) == [(0, cover, -1), (1, second, -1)]
    about = [json.loads(r["bytes"]) for r in archives.with_bytes(entries.filter(F.col("member") == f"{first}.metadata")).collect()]
    assert [(m["visibleName"], m["lastOpenedPage"], m["createdTime"], m["type"]) for m in about] == [("Plan", 1, "1700000000000", "DocumentType")]
    with zipfile.ZipFile(next(f for f in files_below(tmp_path) if first in f)) as z:
        assert z.testzip() is None and z.namelist() == [f"{first}.content", f"{first}.metadata", f"{first}/{cover}.rm", f"{first}/{second}.rm"]
    found = archives.find_pages(entries, spark.createDataFrame([(cover,), (cover,), (second,), (None,), ("none",)], "page_id string"))
    blocks = pagefile.page_blocks(found.select(F.col("page_id").alias("page"), "bytes"), ["page"])
    strokes = scene.strokes(blocks)
    assert sorted((r["page"], r[1]) for r in strokes.select("page", F.size("points")).collect()) == sorted([(cover, 2), (cover, 1), (second, 3)])
    exported = {r["page"]: json.loads(r["drawing"]) for r in scene.exported(strokes).collect()}
    assert {p: [(i["kind"], i["stroke"], len(i["points"])) for i in d["layers"][0]["items"]] for p, d in exported.items()} == {
        cover: [("stroke", {"tool": "17", "color": "0", "width": 1}, 2)], second: [("stroke", {"tool": "17", "color": "0", "width": 1}, 3)]
    }
    assert exported[cover]["canvas"] == {"space": "rm_screen_v6", "width": 1404, "height": 1872}


@pytest.mark.parametrize(
    ("docs", "rows", "message"),
    [
        ([(1, "", None, None)], [(1, 0, *[None] * 6)], "needs a name"),
        ([(1, "a", "v1", None)], [(1, 0, *[None] * 6)], "version is not known"),
        ([(1, "a", None, None)], [], "needs pages"),
        ([(1, "a", None, None)], [(1, 0, None, None, "other", None, None, None)], "canvas is not known"),
        ([(1, "a", None, None), (2, "a", None, None)], [(1, 0, *[None] * 6), (2, 0, *[None] * 6)], "two members are called"),
        ([(1, "a", None, None)], [(1, 0, "x", *[None] * 5), (1, 1, "x", *[None] * 5)], "two members are called"),
    ],
)
def test_refused_documents_leave_nothing(spark, tmp_path, docs, rows, message):
    with pytest.raises(Exception, match=message):
        archives.write_archives(archives.members(made(spark, docs, rows), SPACE, "made", 1), str(tmp_path / "out"))
    assert files_below(tmp_path) == []


def test_a_failed_run_keeps_what_was_there(spark, tmp_path):
    out = str(tmp_path / "out")
    one = archives.members(made(spark, [(1, "a", None, None)], [(1, 0, *[None] * 6)]), SPACE, "made", 1)
    archives.write_archives(one, out)
    before = files_below(out)
    with pytest.raises(FileExistsError):
        archives.write_archives(one, out)
    some = made(spark, [(i, f"d{i}", None, None) for i in range(20)], [(i, 0, *[None] * 6) for i in range(20)])
    many = archives.members(some, SPACE, "made", 1)
    broken = many.withColumn("bytes", F.when(F.col("uuid") == some.filter("doc = 7").first()["uuid"], F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="lost"):
        archives.write_archives(broken, out, force=True)
    assert files_below(out) == before
    archives.write_archives(many, out, force=True)
    assert len(files_below(out)) == 20 and not set(before) & set(files_below(out))
    assert not [d for d in os.listdir(out) if d.startswith("_staging")]
    archives.write_archives(many.filter("false"), str(tmp_path / "none"))
    assert files_below(tmp_path / "none") == []


class Counting(io.BytesIO):
    taken = 0

    def read(self, *a):
        data = super().read(*a)
        self.taken += len(data)
        return data


def test_bytes_read_do_not_grow_with_the_archive():
    taken = []
    for filler in (1_000, 5_000_000):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("big.rm", os.urandom(filler))
            z.writestr("u/p.rm", b"p" * 100, zipfile.ZIP_DEFLATED)
        file = Counting(raw.getvalue())
        entry = archives._listed(file)[1]
        file2 = Counting(raw.getvalue())
        assert archives._fetched(file2, entry[1], entry[2], entry[3], entry[5], entry[6]) == b"p" * 100
        taken.append(file.taken + file2.taken)
    assert taken[0] == taken[1] < 1_000


def test_page_look_up(spark, tmp_path):
    head = b"page lines file, version=5".ljust(43)
    with zipfile.ZipFile(tmp_path / "a b%20c.zip", "w") as z:
        z.mkdir("u")
        z.writestr("u/p.rm", head + b"first", zipfile.ZIP_DEFLATED)
        z.writestr("v/p.rm", head + b"second")
        z.writestr("short.rm", b"")
        z.writestr("p.rm.txt", b"no page")
    zipfile.ZipFile(tmp_path / "empty.rmdoc", "w").close()
    entries = archives.directory(spark, str(tmp_path))
    assert [(r["place"], r["member"], r["size"]) for r in entries.orderBy("place").collect()] == [(0, "u/p.rm", 48), (1, "v/p.rm", 49), (2, "short.rm", 0), (3, "p.rm.txt", 7)]
    ask = lambda *ids: archives.find_pages(entries, spark.createDataFrame([(i,) for i in ids], "page_id string"))
    got = [(r["page_id"], r["version"], r["size"], bytes(r["bytes"])[43:]) for r in ask("p", "short", "gone", None, "p").orderBy("page_id").collect()]
    assert got == [("p", "V5", 48, b"first"), ("short", "unknown", 0, b"")]
    with pytest.raises(Exception, match="page id is empty"):
        ask("").collect()
    with pytest.raises(Exception, match="checksum"):
        archives.with_bytes(entries.withColumn("crc", F.lit(1).cast("bigint"))).collect()
    assert "version" in ask("p").columns


def test_packed_archives_are_zip_files():
    """Members of all names and sizes, more than 16 bits can count, and one behind 4 GB."""
    for count, start in ((0, 0), (3, 0), (70_000, 0), (3, 1 << 32)):
        out = io.BytesIO()
        packer = archives.Packer(out)
        packer.at = start  # as if so many bytes had been written
        want = {f"{'é' if i % 2 else 'e'}/{i}": os.urandom(i % 5) * i for i in range(min(count, 50))} | {str(i): b"x" for i in range(50, count)}
        for member, data in want.items():
            packer.add(member, data)
        packer.close()
        with zipfile.ZipFile(out) as z:  # bytes that are missing before the first member are found by the directory's own place
            assert z.namelist() == list(want)
            if start:
                assert {i.header_offset + start for i in z.infolist()} == {r[2] + start for r in archives._listed(io.BytesIO(out.getvalue()))}
            else:
                assert z.testzip() is None and all(z.read(m) == want[m] for m in list(want)[:60])


def test_members_side_by_side_are_read_at_once(spark, tmp_path):
    """Also where a local header has more than the name in it; only the bytes asked for are read, and many archives are listed by tasks."""
    for k in range(30):
        folder = tmp_path / f"f{k % 3}" / ("_hidden" if k == 5 else "own")
        folder.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(folder / f"{k}.zip", "w") as z:
            for i in range(6):
                about = zipfile.ZipInfo(f"{i}.rm")
                about.extra = b"\x99\x99\x03\x00abc" if i in (2, 5) else b""
                z.writestr(about, f"{k} {i}".encode() * (i + 1), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    entries = archives.directory(spark, str(tmp_path))
    listed = entries.collect()
    assert len(listed) == 29 * 6 and {r["path"] for r in listed} == {f"file:{f}" for f in files_below(tmp_path) if "_hidden" not in f}
    got = {(r["path"].rsplit("/", 1)[-1], r["member"]): bytes(r["bytes"]) for r in archives.with_bytes(entries.filter("member <> '3.rm'")).collect()}
    assert got == {(f"{k}.zip", f"{i}.rm"): f"{k} {i}".encode() * (i + 1) for k in range(30) if k != 5 for i in range(6) if i != 3}
    runs = [[r["place"] for r in run] for run in archives._runs(sorted((r.asDict() for r in listed if r["path"].endswith("/7.zip") and r["place"] != 3), key=lambda r: r["place"]))]
    assert runs == [[0, 1, 2], [4, 5]]


def test_page_files_by_columns_equal_those_by_strokes():
    """Numbers of one to three digits, empty and null drawings, slices; values that do not fit their place are left to the plain writer."""
    point = pa.struct([(n, pa.float64()) for n in ("x", "y", "width")])
    kind = pa.list_(pa.struct([("tool", pa.int32()), ("color", pa.int32()), ("thickness", pa.float64()), ("points", pa.list_(point))]))
    one = lambda n, **other: {"tool": n % 90, "color": 3, "thickness": n / 7, "points": [{"x": i / 3 - n, "y": n / 9, "width": i * 1.9} for i in range(n % 6)]} | other
    drawings = [None, [], [one(0)], [one(n) for n in range(300)], [one(n) for n in range(17_000)], [one(5)]]
    titles, rows = pa.array(["made", None, "", "x" * 60, "made", "b"]), pa.array(drawings, kind)
    for a, b in ((titles, rows), (titles.slice(1, 3), rows.slice(1, 3)), (titles.slice(0, 0), rows.slice(0, 0)), (titles.slice(0, 1), rows.slice(0, 1))):
        assert pagewriter._file_array(a, b).equals(pagewriter._file_list(a, b))
    for bad in ({"tool": -1}, {"points": [{"x": 1e300, "y": 0.0, "width": 1.0}]}, {"points": [{"x": 0.0, "y": 0.0, "width": 65536.0}]}, {"points": [{"x": 0.0, "y": 0.0, "width": float("nan")}]}, {"thickness": None}):
        assert pagewriter._file_array(titles.slice(0, 1), pa.array([[one(1, **bad)]], kind)) is None


def test_the_round_trip_opens_archives_twice_and_leaves_nothing(spark, tmp_path, monkeypatch):
    """Once for the directory and once for all members that are read; the folder is gone after."""
    from foliospark.plans import archives as plans

    asked, paths = [], []
    read, new = archives.with_bytes, plans.new_path
    monkeypatch.setattr(archives, "with_bytes", lambda entries: asked.append(entries) or read(entries))
    monkeypatch.setattr(plans, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    assert plans.archive_round_trip(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert len(asked) == 1 and len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:"))
