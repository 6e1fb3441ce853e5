"""Streams over files that come in three parts equal their batch twins."""

from pyspark.sql import functions as F

from lectern.operators import automaton, jobs, transcript
from lectern.sources.model import frame
from lectern.sources.snapshot import Snapshots
from lectern.streaming import live
from tests.conftest import SF


def in_parts(df, folder, order, n=3):
    cut = df.select(F.expr(f"percentile({order}, array(0.33, 0.66))")).first()[0]
    for i in range(n):
        low, high = (None, *cut)[i], (*cut, None)[i]
        part = df
        if low is not None:
            part = part.filter(F.col(order) > low)
        if high is not None:
            part = part.filter(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, mode, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_job_states(spark, tmp_path):
    events = jobs._requests(frame(spark, SF, "m_events"))
    out = run(live.job_states(in_parts(events, str(tmp_path / "in"), "event_id")), "update", "states", tmp_path)
    twin = automaton.current_state(events)
    last = out.groupBy("job_id").agg(F.max_by(F.struct(*twin.columns[1:]), "n_events").alias("x")).select("job_id", "x.*")
    assert sorted(map(str, last.collect())) == sorted(map(str, twin.collect()))
    assert twin.agg(F.sum("n_rejected")).first()[0] > 0


def test_states_of_neighbouring_jobs_are_one_value(spark, tmp_path):
    requests = ["queued", "running", "waiting", "cancel", "completed", "resume"]
    events = [(None if j == 7 else j - 200, e * 400 + j, requests[(e + j // 3) % 6], e % 5) for e in range(6) for j in range(400)]
    events = spark.createDataFrame([(j, e + 2**60, r, p) for j, e, r, p in events], "job_id long, event_id long, request string, progress int")
    states = live.job_states(in_parts(events, str(tmp_path / "in"), "event_id"))
    q = states.writeStream.format("memory").queryName("near").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 400 // 64 + 3
    twin = automaton.current_state(events)
    last = spark.table("near").groupBy("job_id").agg(F.max_by(F.struct(*twin.columns[1:]), "n_events").alias("x")).select("job_id", "x.*")
    keep = last.filter("job_id IS NOT NULL")
    assert sorted(map(str, keep.collect())) == sorted(map(str, twin.filter("job_id IS NOT NULL").collect()))
    assert last.filter("job_id IS NULL").first()["n_events"] == 6


def test_event_log(spark, tmp_path):
    events = frame(spark, SF, "m_events").withColumn("progress", F.col("progress") * 3 - 50)
    live.append_events(in_parts(events, str(tmp_path / "in"), "event_id"), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == events.count()
    assert tuple(log.agg(F.min("progress"), F.max("progress")).first()) == (0, 100)


SEGMENTS = "lecture long, segment long, start_ms long, end_ms long, text string, last boolean"
#: A row of another lecture whose event time is beyond all others.
FAR = 4_000_000_000


def timed(df, at="start_ms"):
    """Event times begin in 2020: what lies at the epoch counts as late before anything has come."""
    return df.withColumn("ts", F.timestamp_millis(F.col(at) + 1_577_836_800_000))


def test_paragraphs(spark, tmp_path):
    s = frame(spark, SF, "m_segments").select("lecture", "segment", "start_ms", "end_ms", "text", F.lit(False).alias("last"))
    end = spark.createDataFrame([(-1, 1, FAR, FAR + 1, "end", False)], SEGMENTS)
    out = run(live.streaming_paragraphs(in_parts(timed(s.unionByName(end)), str(tmp_path / "in"), "start_ms")), "append", "paragraphs_live", tmp_path).filter("lecture >= 0")
    twin = transcript.paragraphs(s).select("lecture", "paragraph", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, twin.collect()))


def test_rows_after_the_last_one_open_a_new_paragraph(spark, tmp_path):
    rows = [(1, 1, 0, 100, "a", False), (1, 2, 200, 300, "b", True), (1, 3, 400, 500, "c", False), (1, 4, 600, 700, "d", True), (-1, 1, FAR, FAR, "end", False)]
    out = run(live.streaming_paragraphs(in_parts(timed(spark.createDataFrame(rows, SEGMENTS)), str(tmp_path / "in"), "start_ms")), "append", "paragraphs_last", tmp_path)
    assert sorted((r.paragraph, r.start_ms, r.end_ms, r.text) for r in out.collect()) == [(1, 0, 300, "a b"), (2, 400, 700, "c d")]


def files(spark, folder, batches, shape):
    """A stream with one file for each list of rows."""
    for rows in batches:
        timed(spark.createDataFrame(rows, shape), "start_ms" if "start_ms" in shape else "t_ms").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_an_open_paragraph_needs_no_further_segment_of_its_lecture(spark, tmp_path):
    batches = [[(1, 2, 2000, 3000, "b", False), (2, 1, 0, 100, "x", False)], [(1, 1, 0, 1000, "a", False)], [(2, 2, 60_000, 60_100, "y", False)]]
    out = run(live.streaming_paragraphs(files(spark, str(tmp_path / "in"), batches, SEGMENTS), "5 seconds"), "append", "paragraphs_gap", tmp_path)
    # Segments of lecture 1 came in the wrong order; its paragraph is complete once the watermark is past the gap.
    assert sorted((r.lecture, r.paragraph, r.text) for r in out.collect()) == [(1, 1, "a b"), (2, 1, "x")]


DOCS = "document_id long, subject string, digest string, t long"


def test_ingest_remembers_for_ever(spark, tmp_path):
    year = 31_536_000
    rows = [(1, "a", "x", 0), (2, "a", "x", 60), (3, "b", "x", 120), (4, "a", "y", 180), (5, "a", "x", 30 * year), (6, None, "x", 30 * year), (7, None, "x", 30 * year + 1), (4, "a", "y", 30 * year + 2), (8, "c", None, 31 * year), (9, "c", None, 31 * year)]
    store = Snapshots(spark, str(tmp_path / "store"))
    stream = in_parts(spark.createDataFrame(rows, DOCS), str(tmp_path / "in"), "t")
    live.ingest(stream, store.folder, str(tmp_path / "c")).awaitTermination(240)
    docs = store.read("documents")
    assert sorted(r.document_id for r in docs.collect()) == [1, 3, 4, 6, 8]
    refused = {(r.document_id, r.same_as, r.reason.startswith("the same document")) for r in store.read("rejected").collect()}
    assert refused == {(2, 1, False), (5, 1, False), (7, 6, False), (4, 4, True), (9, 8, False)}
    # The same batches under the same numbers, as after a lost checkpoint, change nothing.
    before = store.latest()
    live.ingest(stream, store.folder, str(tmp_path / "again")).awaitTermination(240)
    assert store.latest() == before
    assert store.read("documents").count() == 5
    # Another source goes on; its repeats are known.
    more = in_parts(spark.createDataFrame([(20, "a", "y", 1), (21, "d", "z", 2), (22, "d", "z", 3)], DOCS), str(tmp_path / "more"), "t")
    live.ingest(more, store.folder, str(tmp_path / "c2"), "other").awaitTermination(240)
    assert sorted(r.document_id for r in store.read("documents").collect()) == [1, 3, 4, 6, 8, 21]


def test_parts_of_many_folders_are_written_as_one(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    for n in range(4):
        rows = spark.createDataFrame([(1, n, "p"), (2 + n, n, "p"), (9, n, "q")][: 3 if n == 0 else 2], "lecture long, batch long, part string")
        store.commit(added={"t": (rows, "part")})
    assert live.compact(store, "t", 3, (["lecture"], "batch")) == 1
    assert {k: len(v) for k, v in store.state()["tables"]["t"]["parts"].items()} == {"p": 1, "q": 1}
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 3), (2, 0), (3, 1), (4, 2), (5, 3), (9, 0)]


def test_live_transcripts(spark, tmp_path):
    s = frame(spark, SF, "m_segments").withColumn("chunk", F.floor(F.col("start_ms") / 60_000))
    plan = transcript._plan(s)
    chunks = s.select("lecture", "chunk", "segment", "start_ms", "end_ms", "text")
    wrong = chunks.filter("segment = 1").withColumn("chunk", F.lit(999).cast("long"))
    stream = in_parts(chunks.unionByName(wrong).unionByName(chunks.filter("segment = 2")), str(tmp_path / "in"), "segment")
    store = Snapshots(spark, str(tmp_path / "store"))
    live.live_transcripts(stream, plan, store.folder, str(tmp_path / "c"), transcript.transcript_metadata).awaitTermination(240)
    twin = sorted(map(str, transcript.transcript_metadata(chunks, plan).collect()))
    assert sorted(map(str, live.latest_transcripts(store).select(*transcript.transcript_metadata(chunks, plan).columns).collect())) == twin
    before = store.latest()
    live.live_transcripts(stream, plan, store.folder, str(tmp_path / "again"), transcript.transcript_metadata).awaitTermination(240)
    assert store.latest() == before
    # A batch that touches one lecture opens the files of its part only.
    one = chunks.filter("lecture = 0").withColumn("part", live._part("lecture"))
    opened, every = store.read("chunks", parts=live._touched(one)).inputFiles(), store.read("chunks").inputFiles()
    assert 0 < len(opened) < len(every) / 8


CUES = "lecture long, segment long, start_ms long, end_ms long"


def test_cue_changes_with_overlaps_gaps_and_late_ticks(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 1000, 5000), (1, 2, 3000, 9000), (1, 3, 20_000, 20_100), (1, 4, 20_000, 26_000), (2, 7, 0, 90_000), (3, 1, 50_000, 60_000)], CUES)
    batches = [
        [(1, 500), (1, 1500), (1, 4000), (2, 0), (3, 10)], [(1, 8000), (1, 6000), (1, 3500), (2, 7000)], [(1, 15_000), (1, 12_000), (1, 20_300)],
        [(1, 21_000), (1, 18_000), (1, 30_000), (3, 55_000), (2, 40_000)], [(3, 51_000), (1, 58_000)], [(-1, FAR)],
    ]
    out = run(live.cue_changes(files(spark, str(tmp_path / "in"), batches, "lecture long, t_ms long"), cues, "10 seconds"), "append", "cues_late", tmp_path).filter("lecture >= 0")
    ticks = spark.createDataFrame([t for b in batches[:-1] for t in b], "lecture long, t_ms long")
    twin = transcript.active_cue_changes(ticks, cues)
    assert sorted(map(str, out.collect())) == sorted(map(str, twin.collect()))
    assert twin.filter("lecture = 1").count() >= 4


def test_cue_changes(spark, tmp_path):
    s = frame(spark, SF, "m_segments")
    ticks = transcript._times(s)
    end = spark.createDataFrame([(-1, FAR)], "lecture long, t_ms long")
    out = run(live.cue_changes(in_parts(timed(ticks.unionByName(end), "t_ms"), str(tmp_path / "in"), "t_ms"), s), "append", "cues", tmp_path).filter("lecture >= 0")
    assert sorted(map(str, out.collect())) == sorted(map(str, transcript.active_cue_changes(ticks, s).collect()))
