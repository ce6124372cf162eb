"""Replicated sequences: the order of items that name their neighbours, by joins alone.

The order is by layer, then by id: an item's layer is the longest way to it over neighbours that must come before. Straight runs of items, which are most
of a typed text, are ranked by pointer doubling; what is left is a small graph of runs, whose layers are found by peeling off the
runs that wait for nothing. All sequences take a round together, and no sequence is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranks import prefix_sums
from foliospark.session import scratch, stored


def _key(p1: str, p2: str) -> Column:
    return F.struct(F.col("seq_id").alias("seq_id"), F.col(p1).alias("p1"), F.col(p2).alias("p2"))


def _edges(items: DataFrame) -> DataFrame:
    """a, b: item a comes before item b. Neighbours that do not exist are the sequence's ends."""
    own, known = _key("p1", "p2"), items.select(_key("p1", "p2").alias("known"))
    left = items.select(_key("left_p1", "left_p2").alias("a"), own.alias("b")).join(known, F.col("a") == F.col("known"), "left_semi")
    right = items.select(own.alias("a"), _key("right_p1", "right_p2").alias("b")).join(known, F.col("b") == F.col("known"), "left_semi")
    return left.unionByName(right).distinct()


def _runs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, head and dist: each item's place (from 0) in its run. A run goes on where an item has one item after it and that one no other before it."""
    ways = edges.groupBy("a").agg(F.count("*").alias("out")).filter("out = 1").select(F.col("a").alias("from"))
    single = edges.groupBy("b").agg(F.count("*").alias("into"), F.min("a").alias("a")).filter("into = 1")
    links = single.join(ways, F.col("a") == F.col("from")).select(F.col("b").alias("to"), F.col("a").alias("ptr"))
    state = nodes.join(links, F.col("node") == F.col("to"), "left")
    state = stored(state.select("node", "ptr", F.coalesce("ptr", "node").alias("head"), F.col("ptr").isNotNull().cast("bigint").alias("dist")), "runs")
    left, before = state.filter("ptr is not null").count(), None
    while left and left != before:  # where a round ends no pointer, all that are left go round in a circle
        ahead = state.select(F.col("node").alias("at"), F.col("ptr").alias("next"), F.col("head").alias("next_head"), F.col("dist").alias("more"))
        joined = state.join(ahead, F.col("ptr") == F.col("at"), "left")
        state = stored(joined.select("node", F.col("next").alias("ptr"), F.coalesce("next_head", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")), "runs")
        left, before = state.filter("ptr is not null").count(), left
    if left:
        raise ValueError("the sequence has a cycle")
    return state.select("node", "head", "dist")


def _layers(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """head and layer of each run: the longest way to it, in items."""
    heads = runs.groupBy("head").agg(F.count("*").alias("items"))
    of = runs.select(F.col("node").alias("tail"), F.col("head").alias("before"))
    first = runs.filter("dist = 0").select(F.col("node").alias("first"))
    # links inside a run lead to items that head none
    between = stored(edges.join(first, F.col("b") == F.col("first")).join(of, F.col("a") == F.col("tail")).select("before", F.col("b").alias("after")), "run-edges")
    waits = between.groupBy("after").agg(F.count("*").alias("waits"))
    state = heads.join(waits, F.col("head") == F.col("after"), "left").select("head", "items", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("bigint").alias("layer"))
    state, done = stored(state, "run-layers"), None
    while not state.isEmpty():
        ready = state.filter("waits = 0")
        if ready.isEmpty():
            raise ValueError("the sequence has a cycle")
        ended = ready.select("head", "layer")
        done = ended if done is None else done.unionByName(ended)
        reached = between.join(ready, F.col("before") == F.col("head")).groupBy(F.col("after").alias("to")).agg(
            F.count("*").alias("met"), F.max(F.col("layer") + F.col("items")).alias("least")
        )
        later = state.filter("waits > 0").join(reached, F.col("head") == F.col("to"), "left")
        state = stored(later.select(
            "head", "items", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), F.greatest("layer", F.coalesce("least", F.lit(0))).alias("layer")
        ), "run-layers")
    return runs.sparkSession.createDataFrame([], heads.select("head", F.lit(0).cast("bigint").alias("layer")).schema) if done is None else done


def sequence_order(items: DataFrame) -> DataFrame:
    """seq_id, p1, p2, place: items (with left and right neighbour ids) in replicated-sequence order.

    Unknown and null neighbours are the sequence's ends, an item given twice is one (with the smaller neighbours), a cycle fails. Rounds grow with the
    logarithm of the longest run and with the number of runs on the longest way; the rows of one sequence are dealt to all tasks, its places too.
    """
    given = items.selectExpr(
        "cast(seq_id as bigint) seq_id", "cast(p1 as int) p1", "cast(p2 as bigint) p2",
        *[f"coalesce(cast({c} as {t}), -1) {c}" for c, t in (("left_p1", "int"), ("left_p2", "bigint"), ("right_p1", "int"), ("right_p2", "bigint"))],
    )
    sides = F.struct("left_p1", "left_p2", "right_p1", "right_p2")
    with scratch(items.sparkSession) as block:
        chosen = stored(given.groupBy("seq_id", "p1", "p2").agg(F.min(sides).alias("sides")).select("seq_id", "p1", "p2", "sides.*"), "items")
        edges = stored(_edges(chosen), "edges")
        runs = stored(_runs(chosen.select(_key("p1", "p2").alias("node")), edges), "ranked-runs")
        layers = stored(_layers(runs, edges), "layers").withColumnRenamed("head", "of")
        placed = runs.join(layers, F.col("head") == F.col("of")).select("node.*", (F.col("layer") + F.col("dist")).alias("layer"))
        ranked = stored(prefix_sums(placed, [F.col(c) for c in ("seq_id", "layer", "p1", "p2")], F.lit(1), "rank"), "ranks")
        bases = ranked.groupBy(F.col("seq_id").alias("of")).agg(F.min("rank").alias("base"))
        ordered = ranked.join(bases, F.col("seq_id").eqNullSafe(F.col("of"))).select("seq_id", "p1", "p2", (F.col("rank") - F.col("base")).cast("int").alias("place"))
        return block.keep(stored(ordered, "sequence"))
