"""Subtrees as intervals, deletion plans, and snapshot differences by subtree hashes.

Totals of subtrees, and places in the whole tree, come from pointer doubling: after k rounds an entry knows the 2^k levels below or above it, so
a tree of depth d takes log2(d) rounds of joins and aggregations. No folder is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.ranks import prefix_sums
from foliospark.operators.tree import FOLDER, ROOT, TRASH
from foliospark.session import scratch, stored

#: pointers of a tree reach the root within so many rounds, those of a cycle never do
MAX_ROUNDS = 40
LANES = ("h0", "h1")


def _pointed(entries: DataFrame, *columns: Column) -> DataFrame:
    """id, up (the parent if it exists) and the columns."""
    known = entries.select(F.col("id").alias("__known"))
    return entries.join(known, F.col("parent_id") == F.col("__known"), "left").select("id", F.col("__known").alias("up"), *columns)


def _next_up(state: DataFrame, **more: str) -> DataFrame:
    """``state`` with up one pointer further, and the columns of the entry there that ``more`` names."""
    above = state.select(F.col("id").alias("__at"), F.col("up").alias("__up"), *[F.col(c).alias(n) for n, c in more.items()])
    return state.join(above, F.col("up") == F.col("__at"), "left").drop("up", "__at").withColumnRenamed("__up", "up")


def subtree_totals(entries: DataFrame, **totals: tuple[Column, str]) -> DataFrame:
    """id and, for each name, the aggregate (``sum`` or ``bit_xor``) of a bigint over an entry and all below it.

    Ids are unique; a parent that does not exist is the root. Entries on or below a parent cycle make it fail.
    """
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    with scratch(entries.sparkSession) as block:
        state = stored(_pointed(entries, *[c.cast("bigint").alias(n) for n, (c, _) in totals.items()]), "subtrees")
        for _ in range(MAX_ROUNDS):
            if state.filter("up is not null").isEmpty():
                return block.keep(state.drop("up"))
            gained = state.filter("up is not null").groupBy(F.col("up").alias("__to")).agg(*[getattr(F, how)(n).alias(f"__{n}") for n, (_, how) in totals.items()])
            raised = _next_up(state).join(gained, F.col("id") == F.col("__to"), "left")
            state = stored(raised.select("id", "up", *[join[how](F.col(n), F.coalesce(f"__{n}", F.lit(0))).alias(n) for n, (_, how) in totals.items()]), "subtrees")
    raise ValueError("the tree has a parent cycle")


def intervals(entries: DataFrame) -> DataFrame:
    """id, first, last and size: every subtree as a range of postorder places, with its top at last.

    Children are visited by id, so the numbering is fixed: an entry comes after all below it, and lies below another exactly if its
    last is in the other's range. Siblings get their offsets by range-partitioned sums, however many a folder has.
    """
    with scratch(entries.sparkSession) as block:
        sized = stored(subtree_totals(entries, size=(F.lit(1), "sum")), "sizes")
        own = _pointed(entries).join(sized.withColumnRenamed("id", "__sized"), F.col("id") == F.col("__sized")).drop("__sized")
        before = stored(prefix_sums(own, [F.coalesce("up", F.lit(ROOT)), F.col("id")], F.col("size")), "siblings")
        folders = before.groupBy(F.coalesce("up", F.lit(ROOT)).alias("__folder")).agg(F.min("before").alias("__base"))
        state = before.join(folders, F.coalesce("up", F.lit(ROOT)) == F.col("__folder"))
        state = stored(state.select("id", "up", "size", (F.col("before") - F.col("__base")).alias("first")), "places")
        while not state.filter("up is not null").isEmpty():
            moved = _next_up(state, above="first")
            state = stored(moved.select("id", "up", "size", (F.col("first") + F.coalesce("above", F.lit(0))).alias("first")), "places")
        return block.keep(state.select("id", "first", (F.col("first") + F.col("size") - 1).alias("last"), "size"))


def _blocks(first: Column, end: Column) -> Column:
    """array<struct<level, block>>: the aligned power-of-two blocks that make up the range [first, end), at most two a level."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    start = F.struct(first.alias("a"), end.alias("b"), none.alias("found"))

    def halve(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        block = lambda at: F.array(F.struct(level.alias("level"), at.alias("block")))
        found = F.concat(acc["found"], F.when(left, block(a)).otherwise(none), F.when(right & (b - 1 >= a + left.cast("bigint")), block(b - 1)).otherwise(none))
        shift = lambda x: F.shiftright(x, 1)
        return F.struct(shift(a + left.cast("bigint")).alias("a"), shift(b - right.cast("bigint")).alias("b"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, halve, lambda acc: acc["found"])


def below(labelled: DataFrame, tops: DataFrame) -> DataFrame:
    """id and top: each entry with every one of ``tops`` (id, first, last) whose subtree it lies in.

    A range join by equal keys: ranges are cut into aligned blocks, and an entry has one block a level, of the levels that occur.
    """
    cut = tops.select(F.col("id").alias("top"), F.explode(_blocks(F.col("first"), F.col("last") + 1)).alias("b")).select("top", "b.*")
    cut = stored(cut, "blocks")
    levels = [r["level"] for r in cut.select("level").distinct().collect()]  # 63 at most
    if not levels:
        return labelled.select("id", F.lit(None).cast("string").alias("top")).limit(0)
    level = F.explode(F.array(*map(F.lit, sorted(levels)))).alias("level")
    points = labelled.select("id", "last", level).select("id", "level", F.expr("shiftright(last, level)").alias("block"))
    return points.join(cut, ["level", "block"]).select("id", "top")


def delete_order(entries: DataFrame, selected: DataFrame, recursive: bool = True) -> DataFrame:
    """id and place: what a deletion removes, each entry once, in the order of removal: all below an entry before it.

    ``selected`` has id and rank. Selected subtrees go one after another by rank (then id), each in postorder by id; what an earlier one
    removed is not there for a later one. Before anything is returned the selection is checked, and these make it fail: no ids at all, the root
    and the trash, ids that are not in ``entries``, and, unless ``recursive``, a folder that is not empty. An id given twice counts once, at its smaller rank.
    """
    with scratch(entries.sparkSession) as block:
        chosen = stored(selected.groupBy("id").agg(F.min("rank").alias("rank")), "chosen")
        found = entries.select(F.col("id").alias("__id"), "type").join(chosen, F.col("__id") == F.col("id")).select("id", "rank", "type")
        wrong = chosen.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull() | F.col("id").isin(ROOT, TRASH)).alias("protected")).first()
        if not wrong["n"]:
            raise ValueError("nothing is selected")
        if wrong["protected"]:
            raise ValueError("the root and the trash cannot be deleted")
        if found.count() < wrong["n"]:
            raise ValueError("a selected entry does not exist")
        labelled = stored(intervals(entries.filter(F.col("id") != TRASH)), "intervals")
        tops = stored(found.join(labelled.withColumnRenamed("id", "__of"), F.col("id") == F.col("__of")).drop("__of"), "tops")
        if not recursive and not tops.filter((F.col("type") == FOLDER) & (F.col("size") > 1)).isEmpty():
            raise ValueError("a folder is not empty")
        ranks = tops.select(F.col("id").alias("top"), F.struct("rank", "id").alias("first_top"))
        hit = below(labelled, tops).join(ranks, "top").groupBy("id").agg(F.min("first_top").alias("first_top"))
        placed = hit.join(labelled.select("id", "last"), "id")
        keys = [F.col("first_top.rank"), F.col("first_top.id"), F.col("last")]
        return block.keep(stored(prefix_sums(placed, keys, F.lit(1), "place").select("id", "place"), "plan"))


def hashed(snapshot: DataFrame) -> DataFrame:
    """``snapshot`` (id, parent_id, hash) with two 64-bit subtree hashes: equal subtrees have the same ids and hashes throughout.

    A subtree's hash is the exclusive or of its entries' hashes, so a folder of any size is hashed by many tasks.
    """
    own = F.sha2(F.to_json(F.struct("id", "hash")), 256)
    half = lambda k: F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("bigint")
    totals = subtree_totals(snapshot, **{n: (half(k), "bit_xor") for k, n in enumerate(LANES)})
    return _pointed(snapshot, "hash").join(totals.withColumnRenamed("id", "__of"), F.col("id") == F.col("__of")).drop("__of")


#: folders are dealt to so many parts of a stored snapshot; a descent reads the parts that its folders are in
PARTS = 64


def _part(folder: Column) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(PARTS)).cast("int")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Store a snapshot (id, parent_id, hash) with its subtree hashes, laid out by folder, so that ``changed_entries`` reads changed folders only."""
    hashed(snapshot).withColumn("part", _part(F.coalesce("up", F.lit(ROOT)))).write.partitionBy("part").parquet(path)


def changed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change (added, changed, removed) between two snapshots read from ``write_snapshot``'s folders.

    The descent starts at the top level and goes on into the folders whose hashes differ: a round reads the children of such folders (of the
    stored parts that hold them), so unchanged subtrees are never read. An entry that moved shows on both sides and is compared by its hash, as in ``snapshot_delta``.
    """
    spark = before.sparkSession
    with scratch(spark) as block:
        frontier = spark.createDataFrame([(ROOT,)], "folder string")
        differences = None
        while True:
            parts = [r["p"] for r in frontier.select(_part(F.col("folder")).alias("p")).distinct().collect()]  # PARTS at most

            def children(snapshot: DataFrame, side: str, of: DataFrame = frontier, parts: list[int] = parts) -> DataFrame:
                read = snapshot.filter(F.col("part").isin(parts)).withColumn("folder", F.coalesce("up", F.lit(ROOT))).join(of, "folder", "left_semi")
                return read.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "folder", "hash", *LANES)])

            both = children(before, "old").join(
                children(after, "new"), (F.col("old_id") == F.col("new_id")) & (F.col("old_folder") == F.col("new_folder")), "full_outer"
            )
            same = [F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}")) for n in LANES]
            level = stored(both.filter(~(same[0] & same[1])), "differences")
            differences = level if differences is None else differences.unionByName(level)
            frontier = level.select(F.coalesce("old_id", "new_id").alias("folder")).distinct()
            if frontier.isEmpty():
                break
        # an entry that moved is a removed and an added one: put together by id
        one = differences.select(F.coalesce("old_id", "new_id").alias("id"), "old_id", "old_hash", "new_id", "new_hash").groupBy("id")
        one = one.agg(
            F.count("old_id").alias("old"), F.count("new_id").alias("new"), F.max("old_hash").alias("old_hash"), F.max("new_hash").alias("new_hash")
        )
        change = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
        return block.keep(stored(one.select("id", change.alias("change")).filter("change is not null"), "delta"))
