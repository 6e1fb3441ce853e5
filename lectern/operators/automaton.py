"""#86: job states as a finite automaton over ordered histories.

A job is in one of the STATES: a status, and whether a cancel or a defer request is noted.
NEXT is the table of legal transitions; a request that it does not list for a state is rejected and
changes nothing. Histories are range-partitioned by job and event, so one of any length spreads over
partitions. Only the first job of a partition can go on from the one before: for it the
partition sends what its events make of every state, and these few rows tell each
partition where to begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.durable import durable

STATUSES = ("none", "queued", "running", "waiting", "deferred", "completed", "failed", "cancelled")
FINAL = ("completed", "failed", "cancelled")
#: (status, cancel requested, defer requested); a state is its place in this list.
STATES = [(s, c, d) for s in STATUSES for c in (False, True) for d in (False, True)]
NONE = STATES.index(("none", False, False))
STATUS = [s for s, _, _ in STATES]
REQUESTS = ("queued", "running", "waiting", "completed", "failed", "cancelled", "deferred", "cancel", "defer", "resume")


def _next(status: str, cancel: bool, defer: bool, request: str) -> tuple[str, bool, bool] | None:
    if request == "queued":
        return ("queued", False, False) if status == "none" else None
    if status in ("none", *FINAL):
        return None
    if request == "resume":
        return ("queued", False, False) if status == "deferred" else None
    if request == "cancel":
        # What does not run ends at once; what runs notes the request and ends with its step.
        return ("cancelled", True, False) if status in ("queued", "deferred") else (status, True, defer)
    if request == "defer":
        return ("deferred", cancel, False) if status == "queued" else None if status == "deferred" else (status, cancel, True)
    if status == "queued":
        return ("running", cancel, defer) if request == "running" else None
    if status == "deferred":
        return None
    if request in FINAL:
        return (request, cancel, False)
    if request == "deferred":
        return ("deferred", False, False)
    return (request, cancel, defer)


#: (state, request) to the next state, for all legal pairs.
NEXT = {(i, r): STATES.index(n) for i, s in enumerate(STATES) for r in REQUESTS if (n := _next(*s, r)) is not None}


def after(state: int, request: str | None) -> int | None:
    """The state after a request, or None where it is rejected."""
    return NEXT.get((state, request))


def described(state: int) -> tuple[str | None, bool, bool]:
    status, cancel, defer = STATES[state]
    return (None if status == "none" else status), cancel, defer


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the first and last job of the partition, what the events of the first make of each state, and the state of the last."""
    part, first, last, n_jobs = None, None, None, 0
    every, state = list(range(len(STATES))), NONE
    for b in batches:
        for job, request, p in zip(b.column("job_id").to_pylist(), b.column("request").to_pylist(), b.column("_part").to_pylist(), strict=True):
            part = p
            if not n_jobs or job != last:
                n_jobs, last, state = n_jobs + 1, job, NONE
                first = job if n_jobs == 1 else first
            if n_jobs == 1:
                every = [NEXT.get((s, request), s) for s in every]
            state = NEXT.get((state, request), state)
    if n_jobs:
        yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "alone": [n_jobs == 1], "every": [every], "state": [state]}, pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("alone", pa.bool_()), ("every", pa.list_(pa.int32())), ("state", pa.int32())]))


def _folded(begin: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, started = NONE, None, False
        for b in batches:
            before, then = [], []
            for job, request, p in zip(b.column("job_id").to_pylist(), b.column("request").to_pylist(), b.column("_part").to_pylist(), strict=True):
                if not started or job != last:
                    state, last, started = (NONE if started else begin.get(p, NONE)), job, True
                new = NEXT.get((state, request))
                before.append(state)
                then.append(new)
                state = state if new is None else new
            keep = [c for c in b.schema.names if c != "_part"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(before, pa.int32()), pa.array(then, pa.int32())], [*keep, "before", "after"])

    return run


def folded(events: DataFrame) -> DataFrame:
    """Every event (job_id, event_id, request, ...) with the state before it and after it, null where it is rejected."""
    placed = events.withColumn("job_id", F.col("job_id").cast("long")).repartitionByRange("job_id", "event_id").sortWithinPartitions("job_id", "event_id")
    # A checkpoint keeps partitions and their order.
    placed = durable(placed.withColumn("_part", F.spark_partition_id()))
    shape = "part int, first long, last long, alone boolean, every array<int>, state int"
    edges = sorted(placed.select("job_id", "request", "_part").mapInArrow(_edges, shape).collect(), key=lambda r: r["part"])
    begin, before = {}, None
    for r in edges:
        start = before[1] if before is not None and before[0] == r["first"] else NONE
        begin[r["part"]] = start
        before = (r["last"], r["every"][start] if r["alone"] else r["state"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "_part")
    return placed.mapInArrow(_folded(begin), f"{kept}, before int, after int")


def _of(state: F.Column, field: int) -> F.Column:
    values = [s[field] if s[field] != "none" else None for s in STATES]
    return F.get(F.array(*(F.lit(v) for v in values)), state)


def current_state(events: DataFrame) -> DataFrame:
    """#86: the state of each job: its status, noted requests, since when, the greatest progress of accepted events, and how many were rejected."""
    rows = folded(events)
    ok = F.col("after").isNotNull()
    changed = ok & ~_of(F.col("before"), 0).eqNullSafe(_of(F.col("after"), 0))
    state = rows.groupBy("job_id").agg(
        F.max_by("after", F.when(ok, F.col("event_id"))).alias("state"), F.max(F.when(changed, F.col("event_id"))).alias("since"), F.max(F.when(ok, F.col("progress"))).alias("progress"),
        F.count("*").alias("n_events"), F.count_if(~ok).alias("n_rejected"),
    )
    state = state.withColumn("state", F.coalesce("state", F.lit(NONE)))
    return state.select("job_id", _of(F.col("state"), 0).alias("status"), _of(F.col("state"), 1).alias("cancel_requested"), _of(F.col("state"), 2).alias("defer_requested"), "since", "progress", "n_events", "n_rejected")


def rejected_events(events: DataFrame) -> DataFrame:
    """#86: events that break the table of transitions, with the state that they met."""
    rows = folded(events).filter("after IS NULL")
    return rows.select("job_id", "event_id", "request", _of(F.col("before"), 0).alias("status"), _of(F.col("before"), 1).alias("cancel_requested"), _of(F.col("before"), 2).alias("defer_requested"))


def recovered(jobs: DataFrame) -> DataFrame:
    """#92: after a restart running and waiting jobs are deferred, and an asked-for stop counts as done; the message tells which."""
    lost, asked = F.col("status").isin("running", "waiting"), F.coalesce("defer_requested", F.lit(False))
    message = F.when(lost & asked, STOPPED).when(lost, MOVED)
    return jobs.select("job_id", F.when(lost, "deferred").otherwise(F.col("status")).alias("status"), (asked & ~lost).alias("defer_requested"), message.alias("message"))


# Messages of a restart, in the job and in its history.
STOPPED, MOVED = "Stopped safely for later after application restart", "Application restarted; task moved to Later with saved checkpoints"
STOPPED_EVENT, MOVED_EVENT = "Task stopped safely for later during application restart", "Application restarted; task moved to Later for checkpoint recovery"


def recovery_events(jobs: DataFrame) -> DataFrame:
    """#92: the event that a restart adds to the history of each job that it defers."""
    lost = jobs.filter(F.col("status").isin("running", "waiting"))
    message = F.when(F.coalesce("defer_requested", F.lit(False)), STOPPED_EVENT).otherwise(MOVED_EVENT)
    return lost.select("job_id", F.lit("warning").alias("level"), F.lit("deferred").alias("status"), "progress", message.alias("message"))
