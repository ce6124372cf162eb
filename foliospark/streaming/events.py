"""Event streams: file sources, gap-closed gestures with a watermark, latest states, and a rerun-safe sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.session import shared_dir

PEN, TOUCH = 1, 2
ABSOLUTE = 3


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that ``path`` (a glob) matches now and later.

    Two queries on one such stream each see every event; none is dropped for a slow reader.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def pen_positions(events: DataFrame) -> DataFrame:
    """The absolute-position events of the pen."""
    return events.filter((F.col("source") == PEN) & (F.col("type") == ABSOLUTE))


def _travel(axis: str, sign: int) -> Column:
    """Total movement along an axis in the direction of ``sign``, from a session's ordered points."""
    values = F.transform(F.filter("seen", lambda p: p["axis"] == axis), lambda p: p["value"])
    n = F.greatest(F.size(values) - 1, F.lit(0))
    steps = F.zip_with(
        F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), lambda a, b: F.greatest((b - a) * sign, F.lit(0).cast("bigint"))
    )
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)


def gesture_stream(points: DataFrame, gap_ms: int = 150, late: str = "10 seconds") -> DataFrame:
    """Gestures (user_id, start_ts, left, right, up, down) of a stream of points; those without movement are left out.

    A gesture ends when its user is still for ``gap_ms``, and comes out once the watermark, ``late`` behind the
    newest event, has passed that end; later points of it are dropped. State holds the points of open gestures only.
    Directions are those of ``operators.usage.gestures``; a null value moves nothing, null times are dropped.
    """
    sessions = (
        points.filter(F.col("value").isNotNull())
        .withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", f"{gap_ms} milliseconds").alias("session"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", "id", "axis", "value"))).alias("seen"))
    )
    moved = sessions.select(
        "user_id", F.col("session.start").alias("start_ts"),
        _travel("x", 1).alias("left"), _travel("x", -1).alias("right"), _travel("y", -1).alias("up"), _travel("y", 1).alias("down"),
    )
    return moved.filter(F.col("left") + F.col("right") + F.col("up") + F.col("down") > 0)


def item_states(reports: DataFrame) -> DataFrame:
    """The latest state of each job's item; for output mode ``update``, one state row an item is kept."""
    return reports.groupBy("job_id", "item").agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop, one folder a batch below ``path``.

    A batch that runs again after a failure overwrites its own folder, so reruns add nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What ``drain`` writes to a new folder of the shared one, read back; without the batch number."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    drain(stream, f"{root}/rows", f"{root}/state", mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows/batch=*")
