"""Queries of subtrees as intervals, deletion orders, snapshot differences and branching sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import sequences, subtrees
from foliospark.plans.catalogue import _entries, query
from foliospark.session import delete_path, new_path, table

#: parts as a tree in which each has two below it, besides the workspace's own entries
_HEAP = """
  with recursive e as (
    select 'r' || r_regionkey as id, '' as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
    union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
    union all select 'p' || p_partkey, case when p_partkey <= 1 then '' else 'p' || p_partkey // 2 end from part),
  t as (select id, [id] as chain from e where parent_id = '' union all select e.id, list_append(t.chain, e.id) from e join t on e.parent_id = t.id)
"""


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    up = F.when(F.col("p_partkey") <= 1, "").otherwise(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2).cast("string")))
    parts = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), up.alias("parent_id"), F.lit("CollectionType").alias("type"))
    return _entries(spark, sf_dir).select("id", "parent_id", "type").unionByName(parts)


@query(_HEAP + """
  select o.id, o.last - s.n + 1 as first, o.last, s.n as size
  from (select id, row_number() over (order by list_append(chain, '~')) - 1 as last from t) o
  join (select a as id, count(*) as n from (select unnest(chain) as a from t) group by a) s on o.id = s.id""")
def tree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtrees.intervals(_heap(spark, sf_dir))


_PICKED = "select 'p' || p_partkey as id, 9 as rank from part where p_partkey % 11 = 3 union all select * from (values ('n1', 5), ('r3', 2), ('n7', 1), ('n1', 7))"


@query(_HEAP + f""", k as (select id, min(rank) as rank from ({_PICKED}) group by id),
  u as (select t.id, t.chain, min((k.rank, k.id)) as top from (select id, chain, unnest(chain) as a from t) t join k on t.a = k.id group by t.id, t.chain)
  select id, row_number() over (order by top, list_append(chain, '~')) - 1 as place from u""")
def tree_delete_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping selections, one of them given twice, in the order of their ranks."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 11 = 3")
    picked = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit(9).alias("rank"))
    more = spark.createDataFrame([("n1", 5), ("r3", 2), ("n7", 1), ("n1", 7)], "id string, rank int")
    return subtrees.delete_order(_heap(spark, sf_dir), picked.unionByName(more))


@query("""with o as (select p_partkey as k, p_brand as h from part where p_partkey % 10 <> 1 or p_partkey < 100),
    n as (select p_partkey as k, case when p_partkey % 17 = 0 then 'x' else p_brand end as h from part where p_partkey % 13 <> 5 or p_partkey < 100)
  select 'p' || coalesce(o.k, n.k) as id, case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change
  from o full outer join n on o.k = n.k where o.h is distinct from n.h""")
def tree_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the tree of parts, by subtree hashes: entries added, removed and changed; those below a removed one move to the top."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda k: F.concat(F.lit("p"), k.cast("string"))
    whole = part.select(key, name(key).alias("id"), F.when(key <= 1, "").otherwise(name(F.floor(key / 2))).alias("parent_id"), F.col("p_brand").alias("hash"))
    changed = F.when(key % 17 == 0, "x").otherwise(F.col("hash"))
    sides = (whole.filter("p_partkey % 10 <> 1 or p_partkey < 100"), whole.filter("p_partkey % 13 <> 5 or p_partkey < 100").withColumn("hash", changed))
    paths = [new_path(spark, "snapshot") for _ in sides]
    for side, path in zip(sides, paths, strict=True):
        subtrees.write_snapshot(side.drop("p_partkey"), path)
    found = subtrees.changed_entries(*map(spark.read.parquet, paths))
    for path in paths:
        delete_path(spark, path)
    return found


@query("""with i as (select p_partkey % 10 as seq_id, p_partkey // 10 + 1 as i from part), k as (select seq_id, cast(i % 3 as int) as p1, i as p2, i from i)
  select seq_id, p1, p2, cast(row_number() over (partition by seq_id order by length(bin(i)) + bit_count(i), p1, p2) - 1 as int) as place from k""")
def crdt_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sequences in which two items follow each item, the odd one after the even one too."""
    at = (F.floor(F.col("p_partkey") / 10) + 1).alias("p2")
    own = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("seq_id"), at)
    half = F.floor(F.col("p2") / 2)
    right = F.when(F.col("p2") % 2 == 0, F.col("p2") + 1)
    return sequences.sequence_order(own.select(
        "seq_id", (F.col("p2") % 3).alias("p1"), "p2", (half % 3).alias("left_p1"), half.alias("left_p2"), (right % 3).alias("right_p1"), right.alias("right_p2")
    ))
