"""Session settings and table readers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "foliospark", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEM", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="foliospark-"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: by application, the folder of a local session without a shared one; the setting itself is fixed once a session runs
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (a test) gets a folder of its own; on a cluster the
    setting must be there, since executors cannot read each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="foliospark-")
            spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
        root = _LOCAL_DIRS[app]
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table or file set in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: the open ``scratch`` blocks of this thread, innermost last: each the paths of its tables
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files when they end."""
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The table survives lost executors, has no lineage, and its joins are fed by plain exchanges,
    which adaptive execution can split when a key is hot. The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file set in any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _roots(df: DataFrame) -> set[str]:
    """The folders that a DataFrame's scans start from, by the plan alone: no file is listed."""
    found, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                found.add(paths.next().getName())
    return found


class Scratch:
    """The tables of one ``scratch`` block."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths

    def _read_by(self, df: DataFrame) -> list[str]:
        read = _roots(df)
        return [p for p in self.paths if p.rsplit("/", 1)[-1] in read]

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``; the tables it reads outlive the block and then belong to the block around it."""
        for path in self._read_by(df):
            self.paths.remove(path)
            if len(_OPEN.get()) > 1:
                _OPEN.get()[-2].append(path)
        return df

    def drop(self, *done: DataFrame) -> None:
        """Delete the tables that these DataFrames read, before the block ends."""
        for path in {p for df in done for p in self._read_by(df)}:
            self.paths.remove(path)
            delete_path(self.spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A block whose ``stored`` tables are deleted at its end, but for those given to ``keep``."""
    block = Scratch(spark, [])
    token = _OPEN.set((*_OPEN.get(), block.paths))
    try:
        yield block
    finally:
        _OPEN.reset(token)
        for path in block.paths:
            delete_path(spark, path)
