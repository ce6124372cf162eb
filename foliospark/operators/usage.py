"""Usage logs: gap sessions, success and failure summaries, churn.

Calls have session_id, ts, command, kind, success (text or boolean; null is a failure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import scratch, stored


def failed(success: Column) -> Column:
    return ~success.cast("string").eqNullSafe("true")


def _millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def with_runs(calls: DataFrame, gap_ms: int, key: str = "session_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Adds gap_ms (since the call before, null for the first) and run: a gap of more than ``gap_ms`` begins a new run."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = _millis(ts) - F.lag(_millis(ts)).over(w)
    begins = F.when(F.col("gap_ms") > gap_ms, 1).otherwise(0)
    return calls.withColumn("gap_ms", gap).withColumn("run", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sequences(calls: DataFrame, gap_ms: int, least: int = 2, shown: int = 5, key: str = "session_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """One row per run of at least ``least`` calls: counts, distinct kinds, duration, first time, first commands."""
    runs = with_runs(calls, gap_ms, key, ts, tie)
    # the first few commands only: a run's calls are numbered, so no long list is gathered
    nth = F.row_number().over(Window.partitionBy(key, "run").orderBy(ts, tie))
    grouped = (
        runs.withColumn("nth", nth)
        .groupBy(key, "run")
        .agg(
            F.count("*").alias("calls"),
            F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"),
            F.count_if(~failed(F.col("success"))).alias("succeeded"),
            F.count_if(failed(F.col("success"))).alias("failed"),
            (F.max(_millis(ts)) - F.min(_millis(ts))).alias("duration_ms"),
            F.min(ts).alias("first_ts"),
            F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "command")))).alias("first"),
        )
        .filter(F.col("calls") >= least)
    )
    more = F.when(F.col("calls") > shown, F.concat(F.lit(" (+"), (F.col("calls") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    commands = F.concat(F.array_join(F.transform("first", lambda x: x["command"]), "; "), more)
    return grouped.select(key, "run", "calls", "kinds", "succeeded", "failed", "duration_ms", "first_ts", commands.alias("commands"))


def numbered_sequences(found: DataFrame, key: str = "session_id", ts: str = "first_ts") -> DataFrame:
    """Kept runs with number, counted from 1 over all sessions in order of session, first time and run.

    Range partitions are numbered on their own and moved on by the sizes of those before, so that no task holds all runs.
    """
    order = [key, ts, "run"]
    with scratch(found.sparkSession) as block:
        placed = stored(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged-runs")
        sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
        # one short row a partition
        before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        offsets = stored(sizes.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("before")), "run-offsets")
        own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
        return block.keep(placed.withColumn("own", own).join(offsets, F.col("part") == F.col("of"))).withColumn("number", F.col("own") + F.col("before")).drop(
            "own", "before", "part", "of"
        )


def timeline(calls: DataFrame, gap_s: int, key: str = "session_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Every call with the gap before it in rounded seconds and its run by that gap."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.floor((_millis(ts) - F.lag(_millis(ts)).over(w)) / 1000.0 + 0.5)
    begins = F.when(F.col("gap_s") > gap_s, 1).otherwise(0)
    return calls.withColumn("gap_s", gap).withColumn("run", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def kind_summary(calls: DataFrame, key: str = "session_id") -> DataFrame:
    """Per kind: calls, successes, failures, sessions, success rate in percent and calls a session."""
    n, bad, sessions = F.col("calls"), F.col("failed"), F.col("sessions")
    return calls.groupBy("kind").agg(
        F.count("*").alias("calls"), F.count_if(failed(F.col("success"))).alias("failed"), F.count_distinct(key).alias("sessions")
    ).select("kind", "calls", (n - bad).alias("succeeded"), "failed", "sessions", ((n - bad) * 100.0 / n).alias("success_rate"), (n / sessions).alias("per_session"))


def churn(calls: DataFrame, gap_ms: int, least_calls: int, key: str = "session_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Sessions of at least ``least_calls`` calls by how much these fail and restart; every session's runs are counted, none cut off."""
    runs = with_runs(calls, gap_ms, key, ts, tie)
    summed = runs.groupBy(key).agg(
        F.count("*").alias("calls"), F.count_if(failed(F.col("success"))).alias("failed"), (F.max("run") + 1).alias("runs")
    ).filter(F.col("calls") >= least_calls)
    ratio = F.col("failed") / F.col("calls")
    return summed.select(key, "calls", "failed", "runs", ratio.alias("fail_ratio"), (F.floor(F.col("runs") * (1 + ratio) * 10 + 0.5) / 10).alias("score"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values and their share of the total. Few rows reach the window: one a value."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def gestures(points: DataFrame, gap_ms: int = 150) -> DataFrame:
    """Totals of movement left, right, up and down per user and gap-closed session; those without movement are left out.

    Points have user_id, ts, id, axis (x or y) and value. Falling x is right, rising is left; falling y
    is up, rising is down. A session's first value of an axis moves nothing.
    """
    runs = with_runs(points, gap_ms, "user_id")
    before = F.lag("value").over(Window.partitionBy("user_id", "run", "axis").orderBy("ts", "id"))
    moved = runs.withColumn("d", F.col("value") - before)

    def total(axis: str, sign: int) -> Column:
        return F.sum(F.when((F.col("axis") == axis) & (F.col("d") * sign > 0), F.col("d") * sign).otherwise(0))

    sums = moved.groupBy("user_id", "run").agg(
        total("x", 1).alias("left"), total("x", -1).alias("right"), total("y", -1).alias("up"), total("y", 1).alias("down")
    )
    return sums.filter(F.col("left") + F.col("right") + F.col("up") + F.col("down") > 0)
