"""Local documents against a remote index: what to upload, skip, replace or report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("upload", "skip", "stale", "orphan", "error")


def plan(local: DataFrame, remote: DataFrame, check_times: bool = False, orphans: bool = True) -> DataFrame:
    """key, action, reason for every local key and, if asked for, remote files without a local one.

    ``local`` has key and modified, ``remote`` has key, is_dir and modified. A local key that is missing
    remotely is an upload; where the remote entry is a directory, or is older and times are checked, it
    is stale; else it is skipped. Null keys match nothing.
    """
    ours = local.select(F.col("key").alias("local_key"), F.col("modified").alias("local_time"))
    theirs = remote.select(F.col("key").alias("remote_key"), F.col("is_dir").alias("remote_dir"), F.col("modified").alias("remote_time"))
    both = ours.join(theirs, F.col("local_key") == F.col("remote_key"), "full_outer")
    newer = F.lit(check_times) & (F.col("local_time") > F.col("remote_time"))
    reason = (
        F.when(F.col("local_key").isNull(), "remote only")
        .when(F.col("remote_key").isNull(), "missing")
        .when(F.col("remote_dir"), "remote is a directory")
        .when(newer, "local is newer")
        .otherwise("present")
    )
    action = (
        F.when(reason == "remote only", "orphan").when(reason == "missing", "upload").when(reason == "present", "skip").otherwise("stale")
    )
    found = both.select(F.coalesce("local_key", "remote_key").alias("key"), action.alias("action"), reason.alias("reason"), "remote_dir")
    dropped = (F.col("action") == "orphan") & (F.col("remote_dir") | F.lit(not orphans))
    return found.filter(~F.coalesce(dropped, F.lit(False))).drop("remote_dir")


def action_counts(planned: DataFrame) -> DataFrame:
    """One row with a count of every action, zeros included."""
    return planned.agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS])


def duplicate_keys(local: DataFrame) -> DataFrame:
    """Keys that more than one input maps to, with the first and the last input."""
    return (
        local.groupBy("key")
        .agg(F.count("*").alias("inputs"), F.min("input").alias("first_input"), F.max("input").alias("last_input"))
        .filter("inputs > 1")
    )


def unique_keys(local: DataFrame) -> DataFrame:
    """The inputs, or a failure that names two of them if their keys are the same."""
    clash = duplicate_keys(local).select(F.col("key").alias("clash_key"), "first_input", "last_input")
    message = F.concat(F.lit("two inputs have one key: "), F.col("first_input"), F.lit(", "), F.col("last_input"))
    key = F.when(F.col("clash_key").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("key"))
    return local.join(clash, F.col("key") == F.col("clash_key"), "left").withColumn("key", key).select(*local.columns)


def job_rollup(items: DataFrame, job: str = "job_id") -> DataFrame:
    """State of each job from its items' latest states: uploading while any is open, else failed or done.

    Items have the job, item, seq and state; a repeated report of an item counts once, the latest of it.
    """
    last = items.groupBy(job, "item").agg(F.max_by("state", "seq").alias("state"))
    failed, finished = F.count_if(F.col("state") == "failed"), F.count_if(F.col("state").isin("done", "failed"))
    counted = last.groupBy(job).agg(F.count("*").alias("total"), finished.alias("finished"), failed.alias("failed"))
    state = F.when(F.col("finished") < F.col("total"), "uploading").when(F.col("failed") > 0, "failed").otherwise("done")
    return counted.select(job, "total", "finished", "failed", state.alias("state"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """``existing`` with the rows of ``new``: present keys are kept, or replaced if forced. Running it twice changes nothing."""
    base, more = (existing, new) if force else (new, existing)
    others = base.join(more.select(*key).distinct(), key, "left_anti")
    return more.unionByName(others)


def executed(planned: DataFrame, attempts: DataFrame, force: bool = False) -> DataFrame:
    """key, action, outcome, phase of every planned item, whatever became of the others.

    ``attempts`` has key, phase (delete, convert or upload, in this order of trial) and error (null for success). Skips and
    errors are left alone; stale and orphan items need ``force``, else they are skipped. An item fails in the first phase
    with an error; an orphan is done once deleted.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for p in (("delete", 1), ("convert", 2), ("upload", 3)) for x in p]), F.col("phase"))
    failed = attempts.filter("error is not null").groupBy(F.col("key").alias("failed_key")).agg(F.min(F.struct(rank.alias("rank"), "phase")).alias("first"))
    both = planned.join(failed, F.col("key") == F.col("failed_key"), "left")
    held = F.col("action").isin("stale", "orphan") & F.lit(not force)
    outcome = (
        F.when(F.col("action").isin("skip", "error"), "none").when(held, "skipped").when(F.col("first").isNotNull(), "failed")
        .when(F.col("action") == "orphan", "deleted").otherwise("uploaded")
    )
    return both.select("key", "action", outcome.alias("outcome"), F.when(outcome == "failed", F.col("first.phase")).alias("phase"))


def failures_by_phase(done: DataFrame) -> DataFrame:
    """One row: failed items in all and by phase, zeros included."""
    failed = F.col("outcome") == "failed"
    return done.agg(
        F.count_if(failed).alias("failed"), *[F.count_if(failed & (F.col("phase") == p)).alias(f"{p}_failed") for p in ("convert", "upload", "delete")]
    )


def missing_by_leaf(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows whose last path part no remote path has: a weaker test than that of ``plan``."""
    leaf = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    there = remote.select(leaf("path").alias("there")).distinct()
    return local.withColumn("leaf", leaf("path")).join(there, F.col("leaf") == F.col("there"), "left_anti").drop("leaf")


def put(existing: DataFrame, new: DataFrame, force: bool = False, content_only: bool = False) -> DataFrame:
    """``existing`` (parent_id, name, content, meta) with the documents of ``new`` put in, and outcome for each row.

    A new name is added. A name that is there is refused unless forced (all of it is replaced) or ``content_only``, which
    replaces the content and keeps the rest; the two exclude each other, and content alone is for PDF only (column ext of ``new``).
    """
    if force and content_only:
        raise ValueError("force and content-only exclude each other")
    old = existing.select(F.col("parent_id").alias("op"), F.col("name").alias("on"), F.col("content").alias("old_content"), F.col("meta").alias("old_meta"))
    put_in = new.select(F.col("parent_id").alias("np"), F.col("name").alias("nn"), F.col("content").alias("new_content"), F.col("meta").alias("new_meta"), "ext")
    both = old.join(put_in, (F.col("op") == F.col("np")) & (F.col("on") == F.col("nn")), "full_outer")
    here, there = F.col("nn").isNotNull(), F.col("on").isNotNull()
    outcome = (
        F.when(~here, "kept").when(F.lit(content_only) & (F.lower("ext") != "pdf"), "refused: not a PDF").when(~there, "added")
        .when(F.lit(force), "replaced").when(F.lit(content_only), "content replaced").otherwise("refused: exists")
    )
    fresh = outcome.isin("added", "replaced", "content replaced")
    rows = both.select(
        F.coalesce("op", "np").alias("parent_id"), F.coalesce("on", "nn").alias("name"),
        F.when(fresh, F.col("new_content")).otherwise(F.col("old_content")).alias("content"),
        F.when(outcome.isin("added", "replaced"), F.col("new_meta")).otherwise(F.col("old_meta")).alias("meta"), outcome.alias("outcome"), there.alias("there"),
    )
    return rows.filter(F.col("there") | ~F.col("outcome").startswith("refused")).drop("there")


def status_counts(entries: DataFrame) -> DataFrame:
    """One row: documents, folders and all entries."""
    return entries.agg(
        F.count_if(F.col("type") == "DocumentType").alias("documents"), F.count_if(F.col("type") == "CollectionType").alias("folders"), F.count("*").alias("entries")
    )
