"""Analytics over job tables and their event history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.durable import durable, written
from lectern.functions.order import numbered_within
from lectern.operators import automaton
from lectern.sources.model import cte, query

# Progress at the start of each stage, and where counted steps end.
STAGE_BASE = {"preflight": 2, "cleanup": 62, "slides": 70, "alignment": 74, "quality": 78, "rag": 82, "notes": 84, "summary": 96, "translation": 5, "export": 98, "complete": 100}
STAGE_STEPS = {"recording": (5, 55, 60), "cleanup": (60, 8, 68), "notes": (84, 12, 96), "translation": (5, 90, 95)}


def queue_order(jobs: DataFrame) -> DataFrame:
    """#69: queued jobs by priority, then age."""
    queued = jobs.filter("status = 'queued'").select("kind", "priority", "created", "job_id")
    return numbered_within(queued, ["kind"], ["priority", "created", "job_id"], "place", written).select("job_id", "kind", F.col("place").cast("int").alias("place"))


def display_order(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """#70: running first, then waiting, queued and deferred, the rest by age; between 1 and 500 rows."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "waiting", 1).when(F.col("status") == "queued", 2).when(F.col("status") == "deferred", 3).otherwise(4)
    return jobs.withColumn("rank", rank).orderBy("rank", F.desc("created"), "job_id").limit(max(1, min(limit, 500))).select("job_id", "status", "rank")


def latest_events(events: DataFrame, n: int = 5) -> DataFrame:
    """#71: the last n events of each job, numbered in order of time."""
    w = Window.partitionBy("job_id")
    last = events.withColumn("k", F.row_number().over(w.orderBy(F.desc("event_id")))).filter(F.col("k") <= min(n, 10_000))
    return last.select("job_id", "event_id", "status", F.row_number().over(w.orderBy("event_id")).alias("place"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """#72: the newest review of each (source job, slide)."""
    return reviews.groupBy("source_job_id", "slide").agg(F.max_by("job_id", "created").alias("job_id"))


def lineage(jobs: DataFrame) -> DataFrame:
    """#35: the subject of each job: its own, else that of the nearest source job that has one; cycles and unknown sources find none.

    Each open job points `steps` hops up; a round puts that job's own pointer in its place, so hops double from round to round.
    What is still open when hops exceed the number of jobs goes in a cycle.
    """
    own = F.col("subject").isNotNull()
    state = jobs.select("job_id", "subject", F.when(~own, F.col("source_job_id")).alias("next"), F.when(own, 0).otherwise(1).cast("long").alias("steps"))
    state, hops = durable(state), 1
    n = state.count()
    while hops <= n and not state.filter("next IS NOT NULL").isEmpty():
        up = state.select(F.col("job_id").alias("next"), F.col("subject").alias("up_subject"), F.col("next").alias("up_next"), F.col("steps").alias("up_steps"))
        moved = state.join(up, "next", "left")
        state = durable(moved.select("job_id", F.coalesce("subject", "up_subject").alias("subject"), F.col("up_next").alias("next"), (F.col("steps") + F.coalesce("up_steps", F.lit(0))).alias("steps")))
        hops *= 2
    return state.select("job_id", "subject", F.when(own, F.col("steps").cast("int")).alias("steps"))


def pending_models(jobs: DataFrame, needs: DataFrame, present: DataFrame) -> DataFrame:
    """#36: models that unfinished jobs need and that are missing; `:latest` is the default tag."""
    plain = lambda c: F.regexp_replace(c, ":latest$", "")
    wanted = jobs.filter(F.col("status").isin("queued", "running", "waiting")).join(needs, "kind").select(plain("model").alias("model"))
    n = wanted.groupBy("model").agg(F.count("*").alias("n_jobs"))
    return n.join(present.select(plain("model").alias("model")).distinct(), "model", "left_anti")


#: What a translation request must have in common with a job to use its result.
REQUEST_FIELDS = ("source_job_id", "target_language", "slide_number", "source_explanation", "source_slide_content")


def reusable_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """#37: for each translation request the newest translation, neither failed nor cancelled, of the same source, language, slide and texts; nulls are equal."""
    usable = jobs.filter("kind = 'translation'").filter(F.col("status").isin("queued", "waiting", "running", "deferred", "completed"))
    # One row for each set of fields, so a request meets one job at most, however many are alike.
    newest = usable.groupBy(*(F.col(c).alias(f"_{c}") for c in REQUEST_FIELDS)).agg(F.max_by("job_id", F.struct("created", "job_id")).alias("job_id"))
    same = F.lit(True)
    for c in REQUEST_FIELDS:
        same = same & requests[c].eqNullSafe(newest[f"_{c}"])
    return requests.join(newest, same, "left").select("request_id", newest["job_id"])


def stage_progress(messages: DataFrame) -> DataFrame:
    """#87: percent from a stage and a message such as `(3/7)` or `3/7 chunks complete`."""
    base = F.coalesce(*[F.when(F.col("stage") == s, v) for s, v in STAGE_BASE.items()], F.when(F.col("stage") == "recording", 5), F.lit(1))
    pattern = F.when(F.col("stage") == "recording", F.regexp_extract("message", r"(\d+/\d+) chunks complete", 1)).otherwise(F.regexp_extract("message", r"\((\d+/\d+)\)", 1))
    k, n = F.split_part(pattern, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(pattern, F.lit("/"), F.lit(2)).try_cast("int")
    steps = F.coalesce(*[F.when(F.col("stage") == s, F.least(F.lit(top), a + F.bround(F.lit(span) * k / F.greatest(F.lit(1), n), 0).cast("int"))) for s, (a, span, top) in STAGE_STEPS.items()])
    return messages.select("event_id", F.coalesce(F.when(k.isNotNull(), steps), base).alias("percent"))


def backfilled_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """#93: one synthetic event for every job without history."""
    return jobs.join(events.select("job_id").distinct(), "job_id", "left_anti").select("job_id", "status", F.concat(F.lit("backfilled: "), "status").alias("message"))


def parsed_payloads(events: DataFrame) -> DataFrame:
    """#14: JSON columns as values; what cannot be parsed becomes an empty object."""
    k = F.get_json_object("data", "$.k").cast("int")
    broken = F.expr("try_parse_json(data)").isNull()
    return events.select("event_id", k.alias("k"), F.when(broken, "{}").otherwise(F.col("data")).alias("data"))


def unpivoted_manifest(runs: DataFrame) -> DataFrame:
    """#13: role and path of every artifact of a run, empty where absent."""
    long = runs.unpivot(["run_id"], ["transcript", "slides", "notes"], "role", "path")
    return long.select("run_id", "role", F.coalesce("path", F.lit("")).alias("path"))


def _messages(events: DataFrame) -> DataFrame:
    stages = F.array(*map(F.lit, [*STAGE_BASE, "recording", "other"]))
    k, n = F.col("event_id") % 11, F.col("event_id") % 7
    text = F.when(F.col("event_id") % 5 == 0, "working").otherwise(F.concat(F.lit("("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(") "), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" chunks complete")))
    return events.select("event_id", F.element_at(stages, (F.col("event_id") % 13 + 1).cast("int")).alias("stage"), text.alias("message"))


def _needs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = jobs.sparkSession
    return s.createDataFrame([("lecture", "embed:latest"), ("lecture", "chat"), ("translation", "chat:latest"), ("review", "judge:7b")], "kind string, model string"), s.createDataFrame([("chat:latest",)], "model string")


def _manifest(docs: DataFrame) -> DataFrame:
    d = F.col("document_id")
    part = lambda n, c: F.when(d % n > 0, F.concat(F.lit(c + "/"), d.cast("string"))).alias(c)
    return docs.select(d.alias("run_id"), part(2, "transcript"), part(3, "slides"), part(5, "notes"))


def _translations(jobs: DataFrame) -> DataFrame:
    """Jobs with the fields of translation requests, many of them equal."""
    j = F.col("job_id")
    text = lambda n, name: F.when(j % n > 0, F.concat(F.lit(name + " "), (j % n).cast("string")))
    return jobs.select(
        "job_id", "kind", "status", (F.col("created") % 97).alias("created"), (F.col("source_job_id") % 5).alias("source_job_id"), F.when(j % 2 == 0, "fr").otherwise("de").alias("target_language"),
        F.when(j % 3 > 0, (j % 2).cast("int")).alias("slide_number"), text(2, "explanation").alias("source_explanation"), text(3, "content").alias("source_slide_content"),
    )


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests, with some to cancel, defer and resume among them."""
    e = F.col("event_id")
    request = F.when(e % 11 == 0, "cancel").when(e % 13 == 0, "defer").when(e % 7 == 0, "resume").when(e % 17 == 0, "deferred").when(e % 5 == 0, "running").otherwise(F.col("status"))
    return events.select("job_id", "event_id", request.alias("request"), "progress")


def _stopped(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "status", (F.col("job_id") % 4 == 0).alias("defer_requested"), (F.col("n_events") % 100).cast("int").alias("progress"))


_J, _E = cte("m_jobs"), cte("m_events")
_LEGAL = ", ".join(f"({i}, '{r}', {n})" for (i, r), n in automaton.NEXT.items())
_NAMED = ", ".join(f"({i}, {'NULL' if s == 'none' else repr(s)}, {c}, {d})" for i, (s, c, d) in enumerate(automaton.STATES))
_FOLD = f"""{_E}, tr(b, r, a) AS (VALUES {_LEGAL}), st(i, status, c, d) AS (VALUES {_NAMED}),
      o AS (SELECT job_id, event_id, progress, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS k, CASE WHEN event_id % 11 = 0 THEN 'cancel' WHEN event_id % 13 = 0 THEN 'defer' WHEN event_id % 7 = 0 THEN 'resume' WHEN event_id % 17 = 0 THEN 'deferred' WHEN event_id % 5 = 0 THEN 'running' ELSE status END AS request FROM m_events),
      f AS (SELECT job_id, k, event_id, request, progress, {automaton.NONE} AS b, a, coalesce(a, {automaton.NONE}) AS s FROM o LEFT JOIN tr ON tr.b = {automaton.NONE} AND r = request WHERE k = 1 UNION ALL
        SELECT o.job_id, o.k, o.event_id, o.request, o.progress, f.s, tr.a, coalesce(tr.a, f.s) FROM f JOIN o ON o.job_id = f.job_id AND o.k = f.k + 1 LEFT JOIN tr ON tr.b = f.s AND tr.r = o.request)"""
_STAGES = [*STAGE_BASE, "recording", "other"]

QUERIES = {
    "queue_order": query(lambda j: queue_order(j.withColumn("status", F.when(F.col("job_id") % 4 == 0, "queued").otherwise(F.col("status")))), "m_jobs"),
    "display_order": query(display_order, "m_jobs"),
    "latest_events": query(latest_events, "m_events"),
    "latest_reviews": query(lambda j: latest_reviews(j.filter("kind <> 'lecture'").withColumn("slide", F.col("job_id") % 4).withColumn("source_job_id", F.col("source_job_id") % 10)), "m_jobs"),
    "job_lineage": query(lineage, "m_jobs"),
    "pending_models": query(lambda j: pending_models(j, *_needs(j)), "m_jobs"),
    "request_reuse": query(lambda j: reusable_requests(_translations(j).drop("kind", "status", "created").withColumnRenamed("job_id", "request_id"), _translations(j)), "m_jobs"),
    "job_state": query(lambda e: automaton.current_state(_requests(e)), "m_events"),
    "rejected_events": query(lambda e: automaton.rejected_events(_requests(e)), "m_events"),
    "stage_progress": query(lambda e: stage_progress(_messages(e)), "m_events"),
    "restart_recovery": query(lambda j: automaton.recovered(_stopped(j)), "m_jobs"),
    "recovery_events": query(lambda j: automaton.recovery_events(_stopped(j)), "m_jobs"),
    "event_backfill": query(lambda j, e: backfilled_events(j, e.filter("job_id % 5 <> 0")), "m_jobs", "m_events"),
    "json_payloads": query(lambda e: parsed_payloads(e.withColumn("data", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("data")))), "m_events"),
    "manifest_unpivot": query(lambda d: unpivoted_manifest(_manifest(d)), "m_docs"),
}

ORACLES = {
    "queue_order": f"{_J} SELECT job_id, kind, row_number() OVER (PARTITION BY kind ORDER BY priority, created, job_id) AS place FROM m_jobs WHERE status = 'queued' OR job_id % 4 = 0",
    "display_order": f"{_J} SELECT job_id, status, CASE status WHEN 'running' THEN 0 WHEN 'waiting' THEN 1 WHEN 'queued' THEN 2 WHEN 'deferred' THEN 3 ELSE 4 END AS rank FROM m_jobs ORDER BY 3, created DESC, job_id LIMIT 50",
    "latest_events": f"{_E}, l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS k FROM m_events) SELECT job_id, event_id, status, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS place FROM l WHERE k <= 5",
    "latest_reviews": f"{_J} SELECT source_job_id % 10 AS source_job_id, job_id % 4 AS slide, arg_max(job_id, created) AS job_id FROM m_jobs WHERE kind <> 'lecture' GROUP BY 1, 2",
    "job_lineage": f"{_J}, up AS (SELECT job_id, subject, source_job_id AS nxt, 0 AS steps FROM m_jobs UNION ALL SELECT u.job_id, j.subject, j.source_job_id, u.steps + 1 FROM up u JOIN m_jobs j ON u.nxt = j.job_id WHERE u.subject IS NULL) SELECT job_id, max(subject) AS subject, max(CASE WHEN subject IS NOT NULL THEN steps END) AS steps FROM up GROUP BY job_id",
    "pending_models": f"{_J} SELECT model, count(*) AS n_jobs FROM m_jobs JOIN (VALUES ('lecture', 'embed'), ('review', 'judge:7b')) n(kind, model) USING (kind) WHERE status IN ('queued', 'running', 'waiting') GROUP BY model",
    "request_reuse": f"""{_J}, t AS (SELECT job_id, kind, status, created % 97 AS created, source_job_id % 5 AS src, CASE WHEN job_id % 2 = 0 THEN 'fr' ELSE 'de' END AS lang, CASE WHEN job_id % 3 > 0 THEN job_id % 2 END AS slide,
        CASE WHEN job_id % 2 > 0 THEN 'explanation ' || job_id % 2 END AS e, CASE WHEN job_id % 3 > 0 THEN 'content ' || job_id % 3 END AS c FROM m_jobs)
      SELECT job_id AS request_id, (SELECT arg_max(k.job_id, (k.created, k.job_id)) FROM t k WHERE k.kind = 'translation' AND k.status NOT IN ('failed', 'cancelled') AND k.src IS NOT DISTINCT FROM j.src AND k.lang = j.lang
        AND k.slide IS NOT DISTINCT FROM j.slide AND k.e IS NOT DISTINCT FROM j.e AND k.c IS NOT DISTINCT FROM j.c) AS job_id FROM t j""",
    "job_state": f"""{_FOLD} SELECT job_id, any_value(z.status) AS status, any_value(z.c) AS cancel_requested, any_value(z.d) AS defer_requested, max(event_id) FILTER (a IS NOT NULL AND p.status IS DISTINCT FROM n.status) AS since, max(progress) FILTER (a IS NOT NULL) AS progress, count(*) AS n_events, count(*) FILTER (a IS NULL) AS n_rejected
      FROM f JOIN st p ON p.i = f.b JOIN st n ON n.i = f.s JOIN (SELECT job_id, arg_max(s, k) AS e FROM f GROUP BY job_id) g USING (job_id) JOIN st z ON z.i = g.e GROUP BY job_id""",
    "rejected_events": f"{_FOLD} SELECT job_id, event_id, request, status, c AS cancel_requested, d AS defer_requested FROM f JOIN st ON st.i = f.b WHERE a IS NULL",
    "stage_progress": f"""{_E}, m AS (SELECT event_id, ({_STAGES})[event_id % 13 + 1] AS stage, event_id % 5 <> 0 AS counted, event_id % 11 AS k, greatest(1, event_id % 7) AS n FROM m_events)
      SELECT event_id, CASE WHEN counted AND stage = 'recording' THEN least(60, 5 + round_even(55 * k / n, 0)::INT) WHEN counted AND stage = 'cleanup' THEN least(68, 60 + round_even(8 * k / n, 0)::INT) WHEN counted AND stage = 'notes' THEN least(96, 84 + round_even(12 * k / n, 0)::INT)
        WHEN counted AND stage = 'translation' THEN least(95, 5 + round_even(90 * k / n, 0)::INT) WHEN stage = 'recording' THEN 5 ELSE coalesce(({list(STAGE_BASE.values())})[list_position({list(STAGE_BASE)}, stage)], 1) END AS percent FROM m""",
    "restart_recovery": f"""{_J} SELECT job_id, CASE WHEN status IN ('running', 'waiting') THEN 'deferred' ELSE status END AS status, job_id % 4 = 0 AND status NOT IN ('running', 'waiting') AS defer_requested,
      CASE WHEN status IN ('running', 'waiting') THEN CASE WHEN job_id % 4 = 0 THEN '{automaton.STOPPED}' ELSE '{automaton.MOVED}' END END AS message FROM m_jobs""",
    "recovery_events": f"{_J} SELECT job_id, 'warning' AS level, 'deferred' AS status, (n_events % 100)::INT AS progress, CASE WHEN job_id % 4 = 0 THEN '{automaton.STOPPED_EVENT}' ELSE '{automaton.MOVED_EVENT}' END AS message FROM m_jobs WHERE status IN ('running', 'waiting')",
    "event_backfill": f"{_J} SELECT job_id, status, 'backfilled: ' || status AS message FROM m_jobs WHERE job_id % 5 = 0",
    "json_payloads": f"{_E} SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (data->>'$.k')::INT END AS k, CASE WHEN event_id % 9 = 0 THEN '{{}}' ELSE data END AS data FROM m_events",
    "manifest_unpivot": f"{cte('m_docs')} SELECT document_id AS run_id, unnest(['transcript', 'slides', 'notes']) AS role, unnest([CASE WHEN document_id % 2 > 0 THEN 'transcript/' || document_id ELSE '' END, CASE WHEN document_id % 3 > 0 THEN 'slides/' || document_id ELSE '' END, CASE WHEN document_id % 5 > 0 THEN 'notes/' || document_id ELSE '' END]) AS path FROM m_docs",
}
