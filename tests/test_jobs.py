"""The stream of jobs against a plain state machine: replays, refused steps, time limits, restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from foliospark.session import new_path
from foliospark.streaming import events, jobs

REPORTS = "job_id bigint, item bigint, seq bigint, state string, ts timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


def plain(rows):
    """(job, item) -> (seq, state), and the refused reports, of reports read in the order of their seq."""
    last, refused = {}, set()
    for j, i, seq, state, _ in sorted(rows, key=lambda r: r[2:4]):
        before = last.get((j, i))
        if before and seq <= before[0]:
            continue
        if state not in jobs.STEPS or (before and (before[1] in jobs.FINAL or jobs.STEPS.index(state) < jobs.STEPS.index(before[1]))):
            refused.add((j, i, seq, state))
        else:
            last[(j, i)] = (seq, state)
    return last, refused


def write(spark, root, rows, name):
    spark.createDataFrame(rows, REPORTS).coalesce(1).write.parquet(f"{root}/{name}")


def run(spark, root, out, checkpoint, **settings):
    stream = events.event_stream(spark, f"{root}/*", spark.createDataFrame([], REPORTS).schema)
    with jobs.rocks_state(spark):
        events.drain(jobs.item_changes(stream, **settings), out, checkpoint)
    return spark.read.schema(jobs.CHANGES).parquet(f"{out}/batch=*")


def test_states_equal_a_plain_machine_over_restarts(spark):
    """Reports in three runs on one checkpoint, each repeated; a run without news adds nothing."""
    draw, rows = random.Random(2), []
    for j in range(6):
        for i in range(1 if j else 40):  # job 0 has most of the items
            seqs = sorted(draw.sample(range(20), draw.randint(1, 5)))
            rows += [(j, i, s, draw.choice([*jobs.STEPS, "paused"]), at(s)) for s in seqs]
    root, out, state = (new_path(spark, n) for n in ("reports", "changes", "state"))
    parts = [[r for r in rows if lo <= r[2] < lo + 7] for lo in (0, 7, 14)]
    for k, part in enumerate(parts):
        write(spark, root, part + part[:5] + (parts[0][:9] if k else []), f"part{k}")
        found = run(spark, root, out, state, late="1 hour")
    again = run(spark, root, out, state, late="1 hour")
    last, refused = plain(rows)
    got = found.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
    assert {(r["job_id"], r["item"], r["seq"], r["state"]) for r in got if r["verdict"] == "refused"} == refused
    rolled = {r["job_id"]: r for r in jobs.job_states(again).collect()}
    for j in {k[0] for k in last}:
        states = [s for (a, _), (_, s) in last.items() if a == j]
        open_ones, failed = sum(s not in jobs.FINAL for s in states), states.count("failed")
        want = "uploading" if open_ones else "failed" if failed else "done"
        r = rolled[j]
        assert (r["total"], r["finished"], r["failed"], r["state"]) == (len(states), len(states) - open_ones, failed, want)
        assert r["refused"] == sum(x[0] == j for x in refused)
    assert set(rolled) == {k[0] for k in last}


def test_items_out_of_time_fail_once(spark):
    """Item 1 never ends, item 2 ends in time, item 3 moves the watermark; nulls are left out; a late end is refused."""
    root, out, state = (new_path(spark, n) for n in ("reports", "changes", "state"))
    write(spark, root, [(1, 1, 1, "queued", at(0)), (1, 2, 1, "queued", at(0)), (1, 2, 2, "done", at(5)), (None, 1, 1, "queued", at(0)), (1, 4, 1, None, at(0))], "part0")
    run(spark, root, out, state)
    write(spark, root, [(2, 3, 1, "queued", at(40))], "part1")
    run(spark, root, out, state)
    write(spark, root, [(1, 1, 2, "done", at(41)), (1, 1, 2, "done", at(41))], "part2")
    changes = run(spark, root, out, state)
    assert sorted((r["job_id"], r["item"], r["state"], r["verdict"]) for r in changes.collect()) == [
        (1, 1, "done", "refused"), (1, 1, "failed", "expired"), (1, 1, "queued", "applied"), (1, 2, "done", "applied"), (1, 2, "queued", "applied"), (2, 3, "queued", "applied"),
    ]
    states = {r["job_id"]: tuple(r)[1:] for r in jobs.job_states(changes).collect()}
    assert states == {1: (2, 2, 1, "failed", 1), 2: (1, 0, 0, "uploading", 0)}


def test_no_reports(spark):
    assert jobs.job_states(spark.createDataFrame([], jobs.CHANGES)).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, jobs.BUCKETS])
def test_items_of_a_bucket_keep_their_own_limits(spark, monkeypatch, buckets):
    """However items share buckets, each fails at its own time; equal deadlines fail together, ended items never, and a timer that moved fires once."""
    monkeypatch.setattr(jobs, "BUCKETS", buckets)
    root, out, state = (new_path(spark, n) for n in ("reports", "changes", "state"))
    begun = {i: i // 2 * 5 for i in range(12)}  # minutes; two items each
    write(spark, root, [(1, i, 1, "queued", at(m)) for i, m in begun.items()] + [(1, 0, 2, "done", at(1))], "part0")
    run(spark, root, out, state)
    for k, minute in enumerate((33, 41, 58), 1):
        ended = 2 * k + 5  # one more item ends with each part
        write(spark, root, [(2, k, 1, "done", at(minute)), (1, ended, 2, "done", at(minute))], f"part{k}")
        changes = run(spark, root, out, state)
        found = {r["item"] for r in changes.filter("verdict = 'expired'").collect()}
        done = {0, *(2 * j + 5 for j in range(1, k + 1))}  # a part's reports come before its limits
        assert found == {i for i, m in begun.items() if m + 30 < minute - 10 / 60} - done
    assert changes.filter("verdict = 'expired'").count() == len(found)
