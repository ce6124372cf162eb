"""Global order without a single sorted task: prefix sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stored


def prefix_sums(rows: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """``rows`` with the sum of the values of all rows before them in the order; of ties any one may come first.

    Rows are dealt by range and each range is summed by a task of its own; the ranges' totals, a few rows, are then added up. A key that
    many rows share only needs a further key behind it for its rows to be dealt to several ranges.
    """
    keys = [f"__key{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True))).withColumn("__value", value.cast("bigint"))
    ranged = stored(keyed.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    bases = bases.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(F.broadcast(bases), F.col("__range") == F.col("__of"))
    return summed.withColumn(name, F.col("__inside") + F.col("__base")).drop("__range", "__of", "__base", "__inside", "__value", *keys)
