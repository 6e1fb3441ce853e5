"""The streaming operators as queries: a table arrives in parts, and what the stream has made of it in the end equals the batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lectern.functions.durable import shared_folder
from lectern.operators import jobs, transcript
from lectern.sources import artifacts
from lectern.sources.model import cte, query
from lectern.sources.snapshot import Snapshots
from lectern.streaming import live

PARTS = 3
#: Event times of lectures begin here; a row beyond all others ends them.
BEGIN_MS, END_MS = 1_577_836_800_000, 4_000_000_000


def _arriving(df: DataFrame, order: str, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Writes `df` in parts by `order` and runs the stream over each of them; the folder that it works in."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    cuts = df.select(F.percentile_approx(order, [k / PARTS for k in range(1, PARTS)])).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.filter(F.col(order) > low)
        (part if high is None else part.filter(F.col(order) <= high)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        start(stream, folder).awaitTermination()
    return folder


def _appended(stream: DataFrame, folder: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")


def event_log(events: DataFrame) -> DataFrame:
    """#85"""
    rows = events.select("event_id", "job_id", (F.col("progress") * 3 - 50).alias("progress"))
    folder = _arriving(rows, "event_id", lambda s, at: live.append_events(s, f"{at}/out", f"{at}/checkpoint"))
    return events.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def job_state(events: DataFrame) -> DataFrame:
    """#86"""
    rows = jobs._requests(events)

    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        add = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        return live.job_states(stream).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    folder = _arriving(rows, "event_id", start)
    out = events.sparkSession.read.parquet(f"{folder}/out").drop("batch")
    last = out.groupBy("job_id").agg(F.max_by(F.struct(*out.columns[1:]), "n_events").alias("x"))
    return last.select("job_id", "x.*")


def transcripts(segments: DataFrame) -> DataFrame:
    """#88"""
    chunks, plan = transcript._chunked(segments).select("lecture", "chunk", "segment", "start_ms", "end_ms", "text"), transcript._plan(segments)
    folder = _arriving(chunks, "segment", lambda s, at: live.live_transcripts(s, plan, f"{at}/store", f"{at}/checkpoint", transcript.transcript_metadata))
    have = live.latest_transcripts(Snapshots(segments.sparkSession, f"{folder}/store"))
    none = transcript.transcript_metadata(chunks.join(have.select("lecture"), "lecture", "left_anti"), plan.join(have.select("lecture"), "lecture", "left_anti"))
    return have.select(*none.columns).unionByName(none)


def _timed(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(at) + BEGIN_MS))


def paragraphs(segments: DataFrame) -> DataFrame:
    """#89"""
    rows = segments.select("lecture", "segment", "start_ms", "end_ms", "text", F.lit(False).alias("last"))
    end = segments.sparkSession.createDataFrame([(-1, 1, END_MS, END_MS, "", False)], rows.schema)
    folder = _arriving(_timed(rows.unionByName(end), "start_ms"), "start_ms", lambda s, at: _appended(live.streaming_paragraphs(s), at))
    return segments.sparkSession.read.parquet(f"{folder}/out").filter("lecture >= 0")


def ingest(docs: DataFrame) -> DataFrame:
    """#90"""
    folder = _arriving(docs.select("document_id", "subject", "digest"), "document_id", lambda s, at: live.ingest(s, f"{at}/store", f"{at}/checkpoint"))
    store = Snapshots(docs.sparkSession, f"{folder}/store")
    accepted = store.read("documents").select("document_id", "subject", F.lit(None).cast("long").alias("same_as"))
    return accepted.unionByName(store.read("rejected").select("document_id", "subject", "same_as"))


def cue_changes(segments: DataFrame) -> DataFrame:
    """#91"""
    ticks = transcript._times(segments)
    end = segments.sparkSession.createDataFrame([(-1, END_MS)], ticks.schema)
    folder = _arriving(_timed(ticks.unionByName(end), "t_ms"), "t_ms", lambda s, at: _appended(live.cue_changes(s, segments), at))
    return segments.sparkSession.read.parquet(f"{folder}/out").filter("lecture >= 0")


def corpus_files(docs: DataFrame) -> DataFrame:
    """#1: texts of subjects as files, read back as a corpus; the subject without text gives none."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    line = F.when(F.col("subject") == "src3", F.lit(" \t")).otherwise(F.concat(F.col("document_id").cast("string"), F.lit(" "), "digest"))
    rows = docs.select("subject", "document_id", line.alias("value")).repartition("subject").sortWithinPartitions("subject", "document_id").select("subject", "value")
    rows.write.partitionBy("subject").text(folder)
    found = artifacts.text_corpus(spark, folder).select(F.regexp_extract("path", "subject=([^/]*)/", 1).alias("subject"), "digest", "size_bytes")
    return found


QUERIES = {
    "stream_event_log": query(event_log, "m_events"),
    "stream_job_state": query(job_state, "m_events"),
    "stream_transcripts": query(transcripts, "m_segments"),
    "stream_paragraphs": query(paragraphs, "m_segments"),
    "stream_ingest": query(ingest, "m_docs"),
    "stream_cues": query(cue_changes, "m_segments"),
    "corpus_files": query(corpus_files, "m_docs"),
}

_D = cte("m_docs")
ORACLES = {
    "stream_event_log": f"{cte('m_events')} SELECT event_id, job_id, least(100, greatest(0, progress * 3 - 50)) AS progress FROM m_events",
    "stream_job_state": jobs.ORACLES["job_state"],
    "stream_transcripts": transcript.ORACLES["transcript_metadata"],
    "stream_paragraphs": f"SELECT lecture, paragraph, start_ms, end_ms, text FROM ({transcript.ORACLES['paragraphs']})",
    "stream_ingest": f"{_D} SELECT document_id, subject, CASE WHEN row_number() OVER w > 1 THEN first_value(document_id) OVER w END AS same_as FROM m_docs WINDOW w AS (PARTITION BY subject, digest ORDER BY document_id)",
    "stream_cues": transcript.ORACLES["active_cue_changes"],
    "corpus_files": f"{_D}, t AS (SELECT subject, string_agg(document_id || ' ' || digest || chr(10), '' ORDER BY document_id) AS text FROM m_docs WHERE subject <> 'src3' GROUP BY subject) SELECT subject, sha256(text) AS digest, strlen(text) AS size_bytes FROM t",
}
