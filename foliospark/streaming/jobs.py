"""Upload jobs as a stream: the state of every item, refused reports, time limits, and the jobs' states from what was written.

State is kept by buckets of items, not by job, so a job of any size is spread over all tasks; jobs are rolled up from the items' changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.sync import job_rollup

# The states of an item in their order, and the two that end it.
STEPS = ["queued", "converting", "uploading", "done", "failed"]
FINAL = ("done", "failed")
CHANGES = "job_id bigint, item bigint, seq bigint, state string, verdict string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def verdict(before: tuple | None, seq: int, state: str) -> str:
    """``applied``; ``late`` for a report that is no newer than the last one applied; ``refused`` for a step back, a step from an end, or an unknown state."""
    if before is not None and seq <= before[0]:
        return "late"
    if state not in STEPS or (before is not None and (before[1] in FINAL or STEPS.index(state) < STEPS.index(before[1]))):
        return "refused"
    return "applied"


#: The items that are kept together, by their hash: fixed, as a checkpoint's states lie by bucket.
BUCKETS = 1 << 11
_KNOWN = np.dtype([("job", "<i8"), ("item", "<i8"), ("seq", "<i8"), ("state", "<i8"), ("deadline", "<i8")])
_NEVER = -(1 << 63)
_ROW = ["job_id", "item", "seq", "state", "verdict"]


class ItemStates(StatefulProcessor):
    """The items of a bucket: of each its last applied report, and its deadline, at which it fails if it has not ended ``limit_ms`` after its first report.

    A bucket's items lie in one value, so that a batch asks for the state and for a timer once a bucket and not some times an item; one timer
    stands at the first deadline. A batch rewrites the buckets that it touches.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "items binary, timer bigint")

    def _load(self) -> tuple[dict[tuple[int, int], tuple[int, str, int]], int]:
        found = self.kept.get()
        if found is None:
            return {}, _NEVER
        items, timer = found
        return {(j, i): (seq, STEPS[state], deadline) for j, i, seq, state, deadline in np.frombuffer(bytes(items), _KNOWN).tolist()}, timer

    def _store(self, known: dict[tuple[int, int], tuple[int, str, int]], timer: int, fired: int = _NEVER) -> None:
        first = min((deadline for _, state, deadline in known.values() if state not in FINAL), default=_NEVER)
        if first != timer:
            if timer not in (_NEVER, fired):  # one that fires goes by itself
                self.handle.deleteTimer(timer)
            if first != _NEVER:
                self.handle.registerTimer(first)
        packed = np.array([(j, i, seq, STEPS.index(state), deadline) for (j, i), (seq, state, deadline) in known.items()], _KNOWN)
        self.kept.update((packed.tobytes(), first))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        reports: dict[tuple[int, int, int, str], int] = {}  # repeated reports take one entry
        for part in rows:
            for report in zip(*(part[c].tolist() for c in ("job_id", "item", "seq", "state", "ms")), strict=True):
                at = reports.get(report[:4])
                reports[report[:4]] = report[4] if at is None else min(at, report[4])
        known, timer = self._load()
        out = []
        for (job, item), own in groupby(sorted(reports), key=itemgetter(0, 1)):
            before, fresh = known.get((job, item)), (job, item) not in known
            begun = None
            for report in own:
                _, _, seq, state = report
                begun = reports[report] if begun is None else min(begun, reports[report])
                found = verdict(before, seq, state)
                if found == "applied":
                    before = (seq, state, before[2] if before else 0)
                if found != "late":
                    out.append((job, item, seq, state, found))
            if before is not None:
                known[job, item] = (*before[:2], begun + self.limit_ms) if fresh else before
        if known:
            self._store(known, timer)
        if out:
            yield pd.DataFrame(out, columns=_ROW)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        late = [(k, seq) for k, (seq, state, deadline) in known.items() if state not in FINAL and (deadline < now or deadline <= fired)]
        for k, seq in late:
            known[k] = (seq, "failed", known[k][2])
        if late:
            self._store(known, timer, fired)
            yield pd.DataFrame([(*k, seq, "failed", "expired") for k, seq in late], columns=_ROW)

    def close(self) -> None:
        pass


def item_changes(reports: DataFrame, limit_ms: int = 30 * 60_000, late: str = "10 seconds") -> DataFrame:
    """``CHANGES`` of a stream of reports (job_id, item, seq, state, ts): each report that was applied or refused, and items out of time.

    Reports of an item may come in any order within a batch and any number of times; those no newer than the last applied one say nothing.
    An item that has not ended ``limit_ms`` after its first report fails (``expired``) once the watermark, ``late`` behind the newest report, has
    passed that. Rows with a null are left out. Start the query inside ``rocks_state``. For output mode ``append``.
    """
    whole = reports.dropna(subset=["job_id", "item", "seq", "state", "ts"]).withWatermark("ts", late)
    keyed = whole.select(F.col("job_id").cast("bigint").alias("job_id"), F.col("item").cast("bigint").alias("item"), F.col("seq").cast("bigint").alias("seq"), "state", "ts", F.unix_millis("ts").alias("ms"))
    bucket = F.pmod(F.hash("job_id", "item"), F.lit(BUCKETS)).alias("bucket")
    return keyed.select("*", bucket).groupBy("bucket").transformWithStateInPandas(ItemStates(limit_ms), CHANGES, "Append", "EventTime")


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def job_states(changes: DataFrame) -> DataFrame:
    """job_id, total, finished, failed, state and refused of every job, from the written rows of ``item_changes``.

    Each item counts by its last change that took effect; rows written twice count once, also among the refused.
    """
    rank = F.struct("seq", F.col("verdict") == "expired")
    took = changes.filter("verdict <> 'refused'").groupBy("job_id", "item").agg(F.max(rank).alias("seq"), F.max_by("state", rank).alias("state"))
    refused = changes.filter("verdict = 'refused'").distinct().groupBy(F.col("job_id").alias("of_job")).agg(F.count("*").alias("refused"))
    rolled = job_rollup(took).join(refused, F.col("job_id") == F.col("of_job"), "left")
    return rolled.select("job_id", "total", "finished", "failed", "state", F.coalesce("refused", F.lit(0)).alias("refused"))
