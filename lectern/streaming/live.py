"""Structured Streaming operators, each with a batch twin among the other operators.

What has to be remembered for ever (digests, chunks of recordings) is in versioned tables that every
micro-batch adds to; a batch that comes again finds its number there and changes nothing.
What ends with event time (ticks, open paragraphs) is in the state store, with timers. Event times are cast to
`timestamp` in UTC; rows behind the watermark are dropped where timers are used, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.durable import written
from lectern.operators import automaton
from lectern.sources.snapshot import Snapshots

#: Parts of the tables that streams keep; a batch reads and writes those that its keys fall into.
PARTS = 64
#: Folders that a part may consist of before it is written as one.
FOLDERS = 16


def append_events(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """#85: an append-only event log; progress is kept within 0 to 100."""
    clean = events.withColumn("progress", F.least(F.lit(100), F.greatest(F.lit(0), "progress")))
    return clean.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


#: Neighbouring jobs whose states are one value, since each key costs a call and a round trip to the state store.
JOBS_BITS = 6
_HELD = {"job_id": "long", "state": "int", "since": "long", "progress": "int", "n": "long", "rejected": "long"}


def _state(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {job: x for job, *x in zip(*state.get, strict=True)} if state.exists else {}
    touched = {}
    rows = pd.concat(list(parts)).sort_values("event_id", kind="stable")
    jobs = map(int, rows["job_id"]) if key[1] else [None] * len(rows)
    for job, event, request, progress in zip(jobs, rows["event_id"], rows["request"], rows["progress"], strict=True):
        if job not in touched:
            touched[job] = held.setdefault(job, [automaton.NONE, None, None, 0, 0])
        x = touched[job]
        x[3] += 1
        after = automaton.after(x[0], request)
        if after is None:
            x[4] += 1
            continue
        if automaton.STATUS[after] != automaton.STATUS[x[0]]:
            x[1] = int(event)
        x[0], x[2] = after, int(progress) if x[2] is None else max(x[2], int(progress))
    state.update(tuple(map(list, zip(*((job, *x) for job, x in held.items()), strict=True))))
    now, since, progress, n, rejected = zip(*touched.values(), strict=True)
    status, cancel, defer = zip(*map(automaton.described, now), strict=True)
    whole = lambda values, kind="Int64": pd.array(values, dtype=kind)
    yield pd.DataFrame({"job_id": whole(list(touched)), "status": status, "cancel_requested": cancel, "defer_requested": defer, "since": whole(since), "progress": whole(progress, "Int32"), "n_events": n, "n_rejected": rejected})


def job_states(events: DataFrame) -> DataFrame:
    """#86: the state of each job after every batch (update mode); a job's events come in order.

    The states of up to 2 ** JOBS_BITS neighbouring jobs are one value; a batch answers for the jobs that it has events of.
    """
    shape = "job_id long, status string, cancel_requested boolean, defer_requested boolean, since long, progress int, n_events long, n_rejected long"
    held = ", ".join(f"{name} array<{kind}>" for name, kind in _HELD.items())
    # Events without a job are those of one more; a null among ids would turn them into doubles.
    job = F.coalesce(F.col("job_id").cast("long"), F.lit(0))
    rows = events.select(job.alias("job_id"), F.shiftright(job, JOBS_BITS).alias("near"), F.col("job_id").isNotNull().alias("known"), "event_id", "request", "progress")
    return rows.groupBy("near", "known").applyInPandasWithState(_state, shape, held, "update", GroupStateTimeout.NoTimeout)


def _part(*keys: str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("string")


def _touched(rows: DataFrame) -> list[str]:
    return [r["part"] for r in rows.select("part").distinct().collect()]


def _known(store: Snapshots, table: str, parts: list[str], like: DataFrame) -> DataFrame:
    if table in store.state()["tables"]:
        return store.read(table, parts=parts)
    return like.sparkSession.createDataFrame([], like.schema)


def _done(store: Snapshots, name: str, number: int) -> bool:
    return store.state()["note"].get(name, -1) >= number


def compact(store: Snapshots, table: str, folders: int = FOLDERS, newest: tuple[list[str], str] | None = None) -> int:
    """Writes every part of more than `folders` folders as one; with `newest` (keys, column), of equal keys only the greatest stays. The number of parts written."""
    state = store.state()
    many = [p for p, own in state["tables"].get(table, {"parts": {}})["parts"].items() if len(own) > folders]
    if many:
        rows = None
        for part in many:
            own = store.read(table, parts=[part])
            if newest:
                keys, column = newest
                own = own.join(own.groupBy(*keys).agg(F.max(column).alias("_top")), keys).filter(F.col(column) == F.col("_top")).select(*own.columns)
            own = own.withColumn("part", F.lit(part))
            rows = own if rows is None else rows.unionByName(own)
        store.commit(replaced={table: (rows, "part")}, based_on=state["version"], note=state["note"])
    return len(many)


def ingest(docs: DataFrame, folder: str, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """#90: documents (document_id, subject, digest, ...) become `documents` unless their content is in the subject already, whenever that came; others are `rejected`.

    `digests` holds a row for every content of a subject, in parts by its hash. A batch looks up the parts
    that it falls into, and all three tables change in one version that carries the batch's number.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = Snapshots(batch.sparkSession, folder)
        if _done(store, name, number) or batch.isEmpty():
            return
        rows = written(batch.withColumns({"part": _part("subject", "digest"), "batch": F.lit(number).cast("long"), "_row": F.monotonically_increasing_id()}))
        # Of a content that comes several times in a batch, the smallest document_id is the first.
        first = rows.groupBy("subject", "digest", "part").agg(F.min_by(F.struct("document_id", "_row"), F.struct("document_id", "_row")).alias("first"))
        known = _known(store, "digests", _touched(rows), first.select("subject", "digest", F.col("first.document_id").alias("document_id")))
        held = known.select(F.col("subject").alias("_s"), F.col("digest").alias("_d"), F.col("document_id").alias("_held"), F.lit(True).alias("_old"))
        same = F.col("subject").eqNullSafe(F.col("_s")) & F.col("digest").eqNullSafe(F.col("_d"))
        met = written(first.join(held, same, "left").select("subject", "digest", "part", "first", F.col("_held").alias("held"), F.coalesce("_old", F.lit(False)).alias("old")))
        choice = met.select(F.col("subject").alias("_s"), F.col("digest").alias("_d"), "old", F.col("first._row").alias("_first"), F.coalesce("held", "first.document_id").alias("same_as"))
        judged = rows.join(choice, same)
        accepted = ~F.col("old") & (F.col("_row") == F.col("_first"))
        taken = judged.filter(accepted).select(*batch.columns, "batch", "part")
        reason = F.when(F.col("document_id") == F.col("same_as"), "the same document again").otherwise("the same content as another document of the subject")
        refused = judged.filter(~accepted).select("document_id", "subject", "digest", "same_as", reason.alias("reason"), "batch", "part")
        new = met.filter("NOT old").select("subject", "digest", F.col("first.document_id").alias("document_id"), "part")
        store.commit(added={"digests": (new, "part"), "documents": (taken, "part"), "rejected": (refused, "part")}, note=store.state()["note"] | {name: number})
        compact(store, "digests")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_transcripts(chunks: DataFrame, plan: DataFrame, folder: str, checkpoint: str, rebuild: Callable[[DataFrame, DataFrame], DataFrame], name: str = "transcripts") -> StreamingQuery:
    """#88: transcribed chunks that match the plan, once each, and the rebuilt transcripts of the lectures that a batch touches.

    `chunks` and `transcripts` are in parts by lecture, so a batch opens the parts of its own lectures only.
    `transcripts` gains a row of the batch's number for each of them; the greatest number of a lecture is its state.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = Snapshots(batch.sparkSession, folder)
        if _done(store, name, number) or batch.isEmpty():
            return
        planned = plan.select("lecture", "chunk").distinct()
        rows = written(batch.join(planned, ["lecture", "chunk"], "left_semi").dropDuplicates(["lecture", "chunk", "segment"]).withColumn("part", _part("lecture")))
        known = _known(store, "chunks", _touched(rows), rows.drop("part"))
        new = written(rows.join(known.select("lecture", "chunk", "segment"), ["lecture", "chunk", "segment"], "left_anti"))
        touched = new.select("lecture").distinct()
        have = known.unionByName(new.drop("part")).join(touched, "lecture", "left_semi")
        made = rebuild(have, plan.join(touched, "lecture", "left_semi")).withColumn("batch", F.lit(number).cast("long")).withColumn("part", _part("lecture"))
        store.commit(added={"chunks": (new.select(*rows.columns), "part"), "transcripts": (made, "part")}, note=store.state()["note"] | {name: number})
        compact(store, "chunks")
        compact(store, "transcripts", newest=(["lecture"], "batch"))

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_transcripts(store: Snapshots, version: int | None = None) -> DataFrame:
    """#88: the newest transcript of each lecture."""
    rows = store.read("transcripts", version)
    top = rows.groupBy("lecture").agg(F.max("batch").alias("batch"))
    return rows.join(top, ["lecture", "batch"], "left_semi").drop("batch")


#: Paragraphs as in #44.
GAP_MS, MOST_CHARS = 2750, 900
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_timers(df: DataFrame) -> DataFrame:
    """State with maps and timers needs this store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


class _Paragraphs(StatefulProcessor):
    """Segments wait until the watermark has reached them, so those that come out of order are taken in order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "no int, first long, end long, text string, end_at long")
        self.waiting = handle.getMapState("waiting", "segment long", "start_ms long, end_ms long, text string, last boolean, at long")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for r, at in zip(part.itertuples(), _millis(part["ts"]), strict=True):
                self.waiting.updateValue((int(r.segment),), (int(r.start_ms), int(r.end_ms), r.text, bool(r.last), int(at)))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        no, first, end, text, end_at = self.open.get() if self.open.exists() else (0, None, 0, None, 0)
        waiting = sorted((k[0], *v) for k, v in self.waiting.iterator())
        out = []
        for segment, start_ms, end_ms, said, last, at in waiting:
            if at > watermark:
                break
            self.waiting.removeKey((segment,))
            if first is None or start_ms - end > GAP_MS or len(text) + len(said) > MOST_CHARS:
                if first is not None:
                    out.append((key[0], no, first, end, text))
                no, first, text = no + 1, start_ms, said
            else:
                text = f"{text} {said}"
            end, end_at = end_ms, at + end_ms - start_ms
            if last:
                out.append((key[0], no, first, end, text))
                first = None
        # Whatever comes now starts behind the watermark; beyond the gap it opens a paragraph of its own.
        if first is not None and end_at + GAP_MS < watermark:
            out.append((key[0], no, first, end, text))
            first = None
        self.open.update((no, first, end, text if first is not None else None, end_at))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        later = [at for *_, at in waiting if at > watermark]
        if first is not None:
            later.append(end_at + GAP_MS + 1)
        if later:
            self.handle.registerTimer(max(min(later), watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=["lecture", "paragraph", "start_ms", "end_ms", "text"])


def streaming_paragraphs(segments: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """#89: paragraphs of segments with an event time `ts` of their start; each is emitted once the gap behind it has passed in event time, at the limit of size, or at a row marked `last`.

    Segments may come out of order by `delay`; later ones are dropped.
    """
    shape = "lecture long, paragraph int, start_ms long, end_ms long, text string"
    rows = _with_timers(segments).select("lecture", "segment", "start_ms", "end_ms", "text", F.col("last").cast("boolean").alias("last"), "ts").withWatermark("ts", delay)
    return rows.groupBy("lecture").transformWithStateInPandas(_Paragraphs(), shape, "Append", "EventTime")


class _Cues(StatefulProcessor):
    """Ticks wait until the watermark has reached them; the cue of each is then compared with that of the one before.

    A lecture's cues are one value, and so are its ticks, since each call to the state store is a round trip.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.cues = handle.getValueState("cues", "segment array<long>, start_ms array<long>, end_ms array<long>")
        self.waiting = handle.getValueState("waiting", "t_ms array<long>, at array<long>")
        self.before = handle.getValueState("before", "segment long")

    def _held(self) -> dict[int, tuple[int, int]]:
        return {s: (start, end) for s, start, end in zip(*self.cues.get(), strict=True)} if self.cues.exists() else {}

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self._held() | {int(r.segment): (int(r.start_ms), int(r.end_ms)) for r in initialState.itertuples()}
        self.cues.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))

    def handleInputRows(self, key, rows, timerValues):
        waiting = self._ticks()
        for part in rows:
            waiting |= {int(t): int(at) for t, at in zip(part["t_ms"], _millis(part["ts"]), strict=True)}
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), self._ticks())

    def _ticks(self) -> dict[int, int]:
        return dict(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else {}

    def _advance(self, key, watermark: int, waiting: dict[int, int]) -> Iterator[pd.DataFrame]:
        due = sorted(t for t, at in waiting.items() if at <= watermark)
        out = []
        if due:
            cues = sorted((s, *x) for s, x in self._held().items())
            before = self.before.get()[0] if self.before.exists() else None
            for t in due:
                active = next((s for s, start, end in cues if start <= t <= max(end, start + 500)), None)
                if active is None:
                    active = max(((start, s) for s, start, _ in cues if start <= t), default=(0, None))[1]
                if active != before:
                    out.append((key[0], t, active))
                before = active
            self.before.update((before,))
        later = {t: at for t, at in waiting.items() if at > watermark}
        self.waiting.update((list(later), list(later.values())))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if later:
            self.handle.registerTimer(min(later.values()))
        if out:
            yield pd.DataFrame({"lecture": [x[0] for x in out], "t_ms": [x[1] for x in out], "segment": pd.array([x[2] for x in out], dtype="Int64")})


def cue_changes(ticks: DataFrame, cues: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """#91: play times (lecture, t_ms, event time `ts`) against cues: a row only when the active cue changes; in gaps the latest started cue stays active.

    Ticks may come out of order by `delay`; later ones are dropped.
    """
    held = cues.select("lecture", "segment", "start_ms", "end_ms").groupBy("lecture")
    rows = _with_timers(ticks).select("lecture", "t_ms", "ts").withWatermark("ts", delay)
    return rows.groupBy("lecture").transformWithStateInPandas(_Cues(), "lecture long, t_ms long, segment long", "Append", "EventTime", initialState=held)
