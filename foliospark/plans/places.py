"""Queries of sheets, style changes, markers, comparisons by structure and by pixels, and the stream of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import ink
from foliospark.operators import placement
from foliospark.plans.catalogue import query
from foliospark.session import table
from foliospark.streaming import events, jobs

#: orders as pages, their line items as points; the oracle has the four rotations and the placements written out
_SHEETS = """
  with p as (select l_orderkey as page, min((l_partkey * 13 % 1800 - 900)::double) as x1, max((l_partkey * 13 % 1800 - 900)::double) as x2,
      min((l_partkey * 7 % 2500 - 300)::double) as y1, max((l_partkey * 7 % 2500 - 300)::double) as y2 from lineitem group by 1),
  o as (select o_orderkey as page, (300 + o_custkey % 400)::double as w0, (400 + o_orderkey % 500)::double as h0, (o_orderkey % 8 - 4) * 90 as r from orders),
  c as (select o.page, w0, h0, (r % 360 + 360) % 360 as r, least(coalesce(x1, 0), -702.0) as x1, greatest(coalesce(x2, 0), 702.0) as x2,
      least(coalesce(y1, 0), 0.0) as y1, greatest(coalesce(y2, 0), 1872.0) as y2 from o left join p on o.page = p.page),
  d as (select *, case when r in (90, 270) then h0 else w0 end as bw, case when r in (90, 270) then w0 else h0 end as bh,
      (x2 - x1 + 1) * 72 / 226 as sw, (y2 - y1 + 1) * 72 / 226 as sh, x1 * 72 / 226 as dx, y1 * 72 / 226 as dy from c),
  m as (select *, greatest(sw, bw) as width, greatest(sh, bh) as height, case when sw > bw then -dx - bw / 2 else 0 end as source_x,
      case when sw < bw then bw / 2 + dx else 0 end as layer_x, case when sh > bh then -dy else 0 end as st, case when sh < bh then dy else 0 end as lt from d),
  s as (select *, height - st - bh as source_y, height - lt - sh as layer_y from m)
"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    points = _points(spark, sf_dir)
    boxes = points.select("page", F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y")).alias("box"))
    around = ink.union_boxes(boxes, ["page"]).select(F.col("page").alias("of"), F.struct("min_x", "min_y", "max_x", "max_y").alias("box"))
    pages = o.select(k.alias("page"), (F.col("o_custkey") % 400 + 300).alias("width"), (k % 500 + 400).alias("height"), ((k % 8 - 4) * 90).alias("degrees"))
    return placement.sheets(pages.join(around, F.col("page") == F.col("of"), "left").drop("of"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (key * 13 % 1800 - 900).cast("double").alias("x"), (key * 7 % 2500 - 300).cast("double").alias("y")
    )


def _rounded(*pairs):
    return [(F.round(F.col(c), 4) + 0.0).alias(n) for c, n in pairs]


@query(_SHEETS + """select page, round(width, 4) + 0.0 as width, round(height, 4) + 0.0 as height, round(layer_x, 4) + 0.0 as layer_x, round(layer_y, 4) + 0.0 as layer_y,
    round(source_x + bw / 2, 4) + 0.0 as highlight_x, case r when 0 then 1.0 when 180 then -1.0 else 0.0 end as a, case r when 270 then 1.0 when 90 then -1.0 else 0.0 end as b,
    case r when 90 then 1.0 when 270 then -1.0 else 0.0 end as c, case r when 0 then 1.0 when 180 then -1.0 else 0.0 end as d,
    round(source_x + case r when 270 then h0 when 180 then w0 else 0 end, 4) + 0.0 as e, round(source_y + case r when 180 then h0 when 90 then w0 else 0 end, 4) + 0.0 as f from s""")
def page_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's sheet: the canvas of its line items over a source page that is turned by one of four rotations."""
    names = [(f"place.{n}", n) for n in ("width", "height", "layer_x", "layer_y", "highlight_x")]
    return _sheets(spark, sf_dir).select("page", *_rounded(*names, *[(f"source.{n}", n) for n in "abcdef"]))


@query(_SHEETS + """select l.page, l.line, round(layer_x + (l.x + 5 - x1) * 72 / 226, 4) + 0.0 as x, round(layer_y + sh - (l.y - 9 - y1) * 72 / 226, 4) + 0.0 as y
  from (select l_orderkey as page, l_linenumber as line, l_partkey * 13 % 1800 - 900 as x, l_partkey * 7 % 2500 - 300 as y from lineitem) l join s on l.page = s.page""")
def sheet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's point on its order's sheet, its group 5 to the right and 9 up."""
    strokes = _points(spark, sf_dir).select("page", "line", F.array(F.struct("x", "y")).alias("points"), F.lit(5.0).alias("dx"), F.lit(-9.0).alias("dy"))
    found = placement.on_sheets(strokes, _sheets(spark, sf_dir)).select("page", "line", F.col("points")[0].alias("p"))
    return found.select("page", "line", *_rounded(("p.x", "x"), ("p.y", "y")))


@query("""with s as (select *, case when t in (5, 18) then 25.0 when t = 23 then 12.0 when t in (4, 17) then l_quantity * 1.8 when t in (7, 13) then l_quantity * l_quantity else l_quantity end as w,
    case when t in (5, 18) then 300 when t = 23 then 451 when t in (7, 13) then 700 else 1000 end as a, case when t in (5, 18) then 2 else 1 end as c, l_suppkey % 3 as k
    from (select *, l_partkey % 25 as t from lineitem)),
  p as (select *, lag(w) over o as pw, lag(a) over o as pa, lag(c) over o as pc, lag(k) over o as pk from s window o as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity))
  select l_orderkey, l_linenumber, case when pw is null or abs(w - pw) > 1e-9 then w end as set_width, case when a <> coalesce(pa, 1000) then a end as set_alpha,
    case when c <> coalesce(pc, 1) then c end as set_cap, case when pk is distinct from k then k end as set_color from p""")
def style_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    style = ink.stroke_style(F.col("l_partkey") % 25, F.col("l_quantity"), F.lit(21)).alias("s")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    drawn = li.select("l_orderkey", *order, style, (F.col("l_suppkey") % 3).alias("color")).select("l_orderkey", *order, "s.*", "color")
    return placement.style_changes(drawn, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "set_width", "set_alpha", "set_cap", "set_color")


@query("""with b as (select doc_id, coalesce(text, '') as x from documents where doc_id % 2 = 0), v as (select doc_id - 1 as doc_id, coalesce(text, '') as y from documents where doc_id % 2 = 1),
    t as (select b.doc_id, x, case when b.doc_id % 3 = 0 then replace(x, ' ', '  ') else y end as y from b join v on b.doc_id = v.doc_id)
  select doc_id, 1 as pages_a, 1 as pages_b, 1 as compared, len(regexp_extract_all(x, '@')) = len(regexp_extract_all(y, '@')) and len(string_split(x, chr(10))) % 4 = len(string_split(y, chr(10))) % 4
      and trim(regexp_replace(x, '[\\s\\x0b]+', ' ', 'g')) = trim(regexp_replace(y, '[\\s\\x0b]+', ' ', 'g')) as match from t""")
def structure_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of an even id as a page against the next one, every third against itself with wider spaces."""
    d, body = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text")
    even, odd = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    pairs = even.join(odd, "doc_id").withColumn("next", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("next")))

    def page(text) -> DataFrame:
        turn = F.size(F.split(body, "\n")) % 4 * 90
        return pairs.select("doc_id", text.alias("text")).select("doc_id", F.lit(0).alias("page"), F.regexp_count(body, F.lit("@")).alias("annotations"), turn.alias("degrees"), "text")

    return placement.structural_verdict(placement.structural_pages(page(F.col("text")), page(F.col("next"))))


@query("""with t as (select conv_id // 2 as doc_id, conv_id % 2 as v, turn, length(coalesce(text, '')) % 3 as n, (length(coalesce(role, '')) % 4) * 90 as r, coalesce(text, '') as x from conversations),
    a as (select * from t where v = 0), b as (select * from t where v = 1)
  select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.turn, b.turn) as page, case when a.doc_id is null or b.doc_id is null then null
    when a.n <> b.n then 'annotation count mismatch' when a.r <> b.r then 'rotation mismatch'
    when trim(regexp_replace(a.x, '[\\s\\x0b]+', ' ', 'g')) <> trim(regexp_replace(b.x, '[\\s\\x0b]+', ' ', 'g')) then 'extracted text mismatch' else 'match' end as reason
  from a full outer join b on a.doc_id = b.doc_id and a.turn = b.turn""")
def structure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations as two versions of a document whose pages are the turns."""
    c = table(spark, sf_dir, "conversations")
    size = lambda name: F.char_length(F.coalesce(name, F.lit("")))
    side = lambda v: c.filter(F.col("conv_id") % 2 == v).select(
        F.floor(F.col("conv_id") / 2).alias("doc_id"), F.col("turn").alias("page"), (size("text") % 3).alias("annotations"), (size("role") % 4 * 90).alias("degrees"), "text"
    )
    return placement.structural_pages(side(0), side(1)).select("doc_id", "page", "reason")


@query("""with h as (select page_id, hex(encode(coalesce(html, ''))) as a, hex(encode(replace(coalesce(html, ''), 'th', 'TH'))) as b from pages),
    r as (select page_id, rpad(a, ((length(a) + 511) // 512 * 512)::int, '2') as a, rpad(b, ((length(b) + 511) // 512 * 512)::int, '2') as b from h),
    n as (select *, length(a) // 8 as n from r),
    q as (select page_id, n, len(list_filter(range(0, n), lambda i: a[i * 8 + 1:i * 8 + 8] <> b[i * 8 + 1:i * 8 + 8])) as wrong from n)
  select page_id as doc_id, case when page_id % 5 = 0 then 1.0 when n = 0 then 0.0 else wrong / n::double end as ratio,
    case when page_id % 5 = 0 then 'rendered image size mismatch' when n = 0 then 'empty image bounds' when wrong / n::double <= 0.01 then 'within tolerance' else 'diff exceeds tolerance' end as reason,
    page_id % 5 <> 0 and (n = 0 or wrong / n::double <= 0.01) as match from q""")
def compare_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every web page as pixels, 64 in a row, against a version with one pair of letters changed; that of every fifth has two rows
    more, that of every third of the others one."""
    html = F.coalesce("html", F.lit(""))
    extra = F.when(F.col("page_id") % 5 == 0, 2).when(F.col("page_id") % 3 == 0, 1).otherwise(0)

    def side(text, more) -> DataFrame:
        data = F.encode(text, "UTF-8")
        rows = F.ceil(F.octet_length(data) / 256).cast("int")
        return table(spark, sf_dir, "pages").select(
            F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), F.lit(64).alias("width"), (rows + more).alias("height"),
            F.unhex(F.rpad(F.hex(data), (rows + more) * 512, "2")).alias("data"),
        )

    found = placement.compare_rasters(side(html, F.lit(0)), side(F.replace(html, F.lit("th"), F.lit("TH")), extra))
    return found.select("doc_id", "ratio", "reason", "match")


@query("""with c(m, k) as (values (0, 14), (1, 15), (2, 16), (3, 17), (4, 18), (5, 19), (6, 20), (7, 21), (8, 22), (9, 23), (10, 24), (11, 25), (12, 26), (13, 27))
  select l_orderkey, l_linenumber, coalesce(k, l_suppkey % 28)::int as color from lineitem left join c on l_partkey % 16 = m""")
def marker_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one of 14 known markers, with an unknown one, or with none."""
    known = F.array(*[F.lit(int.from_bytes(bytes(rgba), "big", signed=True)) for rgba in sorted(ink.MARKED, key=ink.MARKED.get)])
    kind = (F.col("l_partkey") % 16).cast("int")
    marker = F.when(kind < 14, F.get(known, kind)).when(kind == 14, F.lit(7))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ink.marked_color(F.col("l_suppkey") % 28, marker).alias("color"))


_LIMIT_DAYS, _LATE_DAYS = 400, 10


@query(f"""with e as (select max(o_orderdate) - interval {_LATE_DAYS} day as mark from orders),
    i as (select o_custkey as job_id, o_orderkey as item, case o_orderstatus when 'F' then 'done' when 'P' then 'failed' else
      case when o_orderdate + interval {_LIMIT_DAYS * 24 + 5} hour <= mark then 'failed' else 'uploading' end end as state, o_orderkey % 7 = 0 as back from orders, e)
  select job_id, count(*) as total, count(*) filter (state <> 'uploading') as finished, count(*) filter (state = 'failed') as failed,
    case when count(*) filter (state = 'uploading') > 0 then 'uploading' when count(*) filter (state = 'failed') > 0 then 'failed' else 'done' end as state,
    count(*) filter (back) as refused from i group by 1""")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of their customers' jobs, reported through their states as a stream; every seventh also reports a step back."""
    orders = events.event_stream(spark, f"{sf_dir}/orders.parquet*", table(spark, sf_dir, "orders").schema)
    end = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed")
    back = F.when(F.col("o_orderkey") % 7 == 0, "queued")
    steps = F.array(*[F.struct(F.lit(i).alias("seq"), s.alias("state")) for i, s in enumerate((F.lit("queued"), F.lit("converting"), F.lit("uploading"), end, back))])
    reports = orders.select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.explode(F.filter(steps, lambda s: s["state"].isNotNull())).alias("s")
    ).select("job_id", "item", "ts", "s.seq", "s.state")
    with jobs.rocks_state(spark):
        changes = events.drained(jobs.item_changes(reports, (_LIMIT_DAYS * 24 + 5) * 3_600_000, f"{_LATE_DAYS} days"))
    return jobs.job_states(changes)
