"""Queries of written archives: round trips, page look-ups."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import pages, scene
from foliospark.plans.catalogue import query
from foliospark.session import new_path, scratch, stored, table
from foliospark.sources import archives, pagefile

NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"

#: customers as notebooks, their orders as pages, line items as points of a stroke for each return flag
_NOTEBOOKS = f"""
  with h as (select c_custkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(c_name)) as h from customer),
  d as (select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', cast(('0x' || substr(h, 17, 1))::int % 4 + 1 as int), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid from h),
  o as (select o_orderkey, o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as page_index from orders),
  g as (select o_orderkey, o_custkey, o_orderstatus, page_index, uuid, sha1(unhex(replace(uuid, '-', '')) || encode('order ' || o_orderkey)) as h from o join d on o_custkey = c_custkey),
  p as (select *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab', cast(('0x' || substr(h, 17, 1))::int % 4 + 1 as int), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as page_id from g),
  l as (select l_orderkey, l_returnflag, count(*) as n, max(l_quantity)::double as most_x from lineitem group by 1, 2)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    point = F.struct("l_linenumber", "l_partkey", F.struct(F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.lit(2.0).alias("width")).alias("p"))
    lines = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["p"]).alias("points"))
    stroke = F.struct("l_returnflag", F.struct(F.lit(17).alias("tool"), F.lit(0).alias("color"), F.lit(2.0).alias("thickness"), "points").alias("s"))
    drawn = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(stroke)), lambda s: s["s"]).alias("strokes"))
    own = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    placed = own.select(F.col("o_custkey").alias("doc"), F.posexplode("o").alias("page_index", "o")).select("doc", "page_index", F.col("o.o_orderkey").alias("key"))
    null = lambda kind: F.lit(None).cast(kind)
    page = placed.join(drawn, F.col("key") == F.col("l_orderkey"), "left").select(
        "doc", "page_index", F.concat(F.lit("order "), F.col("key").cast("string")).alias("page_id"), null("string").alias("template"), null("string").alias("space"),
        null("int").alias("width"), null("int").alias("height"), "strokes",
    )
    named = t("customer").join(own.select(F.col("o_custkey").alias("drawn")), F.col("c_custkey") == F.col("drawn"), "left_semi")
    documents = named.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name"), null("string").alias("version"), null("string").alias("own_id"))
    return archives.members(archives.compiled(documents, page, NAMESPACE), NAMESPACE, "made", 1_700_000_000_000)


@contextmanager
def _written(spark: SparkSession, sf_dir: str):
    """The directory of the notebooks' archives, which are deleted when the block ends."""
    path = new_path(spark, "archives")
    archives.write_archives(_members(spark, sf_dir), path)
    try:
        yield archives.directory(spark, path)
    finally:
        archives.delete_archives(spark, path)


@query(_NOTEBOOKS + """select p.uuid, p.page_id, cast(p.page_index as int) as page_index, count(l_returnflag) as strokes, coalesce(sum(n), 0) as points, count(*) filter (n >= 2) as exported,
    max(most_x) as most_x from p left join l on l_orderkey = o_orderkey group by 1, 2, 3""")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks written as archives and read back: pages by their content files, strokes by their page files, and the strokes an export keeps."""
    with _written(spark, sf_dir) as entries, scratch(spark) as block:
        page = archives.page_id_of(F.col("member"))
        # an archive is opened once for all that is read of it
        read = stored(archives.with_bytes(entries.filter(F.col("member").endswith(".content") | page.isNotNull())), "archive-members")
        content = read.filter(F.col("member").endswith(".content")).select(F.regexp_replace("member", r"\.content$", "").alias("uuid"), F.decode("bytes", "UTF-8").alias("content"))
        plan = stored(pages.page_plan(content).select("uuid", "page_index", "page_id"), "archive-plan")
        drawn = stored(scene.strokes(pagefile.page_blocks(read.select(page.alias("page"), "bytes").filter("page is not null"), ["page"])), "archive-strokes")
        told = drawn.groupBy("page").agg(F.count("*").alias("strokes"), F.sum(F.size("points")).alias("points"), F.max(F.array_max(F.transform("points", lambda p: p["x"]))).alias("most_x"))
        items = F.get_json_object("drawing", "$.layers[0].items")
        kept = scene.exported(drawn).select(F.col("page").alias("exported_page"), F.json_array_length(items).cast("bigint").alias("exported"))
        both = plan.join(told, F.col("page_id") == F.col("page"), "left").join(kept, F.col("page_id") == F.col("exported_page"), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        return block.keep(both.select("uuid", "page_id", "page_index", zero("strokes"), zero("points"), zero("exported"), "most_x"))


@query(_NOTEBOOKS + "select uuid, page_id, 'V6' as version from p where o_orderstatus = 'F'")
def archive_page_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page files of all finished orders, fetched by their ids out of the archives; the other pages' bytes are not read."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    owner = table(spark, sf_dir, "customer").select("c_custkey", archives.named_uuid(F.lit(NAMESPACE), F.col("c_name")).alias("uuid"))
    page_id = archives.named_uuid(F.col("uuid"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    wanted = orders.join(owner, F.col("o_custkey") == F.col("c_custkey")).select(page_id.alias("page_id"))
    with _written(spark, sf_dir) as entries, scratch(spark) as block:
        found = archives.find_pages(entries, wanted)
        return block.keep(stored(found.select(F.replace(F.substring_index("path", "/", -1), F.lit(".rmdoc"), F.lit("")).alias("uuid"), "page_id", "version"), "archive-pages"))
