"""The engine's tables, derived from the given ones.

Each table is one SELECT that Spark and the SQL oracle share but for a few function
names, so both sides start from the same rows. `frame` gives the Spark DataFrame,
`cte` the WITH clause for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")

TABLES = {
    # Catalog: subject = source, folder = language or none, one text file each.
    "m_docs": """
        SELECT doc_id AS document_id, source AS subject, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS folder,
               'doc_' || CAST(doc_id AS STRING) || '.txt' AS name, text, @BYTES(text) AS size_bytes, @SHA(text) AS digest
        FROM {documents}""",
    "m_folders": """
        SELECT DISTINCT subject, folder FROM (
          SELECT source AS subject, lang AS folder FROM {documents} UNION ALL SELECT DISTINCT source, 'empty' FROM {documents}) f WHERE folder IS NOT NULL""",
    # Speech: one conversation is one lecture, its turns are segments on a millisecond clock.
    "m_segments": """
        SELECT conv_id AS lecture, turn AS segment, role, text, gap_ms, dur_ms,
               CAST(sum(gap_ms + dur_ms) OVER w AS BIGINT) - dur_ms AS start_ms, CAST(sum(gap_ms + dur_ms) OVER w AS BIGINT) AS end_ms
        FROM (SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN 4000 ELSE 400 END AS gap_ms, 60 * length(text) AS dur_ms FROM {conversations}) s
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # Decisions of a cleanup pass over the segments.
    "m_decisions": """
        SELECT conv_id AS lecture, turn AS segment, role <> 'system' AND turn % 5 <> 4 AS keep,
               trim(replace(text, chr(10), ' ')) AS clean_text, 'from ' || role AS reason FROM {conversations}""",
    # Vectors: lectures of 50 paragraphs; a deck holds one slide for each label.
    "m_vectors": """
        SELECT vec_id @DIV 50 AS lecture, vec_id % 50 AS paragraph, embedding AS vector, label,
               CAST((vec_id % 50) * 10 AS DOUBLE) AS start_s, CAST((vec_id % 50) * 10 + 5 AS DOUBLE) AS end_s,
               CASE WHEN vec_id % 37 = 0 THEN 'as on slide ' || CAST(label + 1 AS STRING) ELSE 'next we see' END AS text
        FROM {embeddings}""",
    "m_deck": """
        SELECT lecture, row_number() OVER (PARTITION BY lecture ORDER BY label) AS slide, vector FROM (
          SELECT vec_id @DIV 50 AS lecture, label, embedding AS vector, row_number() OVER (PARTITION BY vec_id @DIV 50, label ORDER BY vec_id) AS k FROM {embeddings}) d WHERE k = 1""",
    # Slides with text: decks of twenty pages, with all paragraphs of each.
    "m_slides": r"""
        SELECT page_id @DIV 20 AS lecture, page_id % 20 + 1 AS slide, @EXTRACT(html, '<title>([^<]*)</title>') AS title, array_join(regexp_extract_all(html, '<p>([^<]*)</p>', 1), chr(10)) AS content,
               CASE WHEN page_id % 9 = 0 THEN '' ELSE @EXTRACT(html, '<h1>([^<]*)</h1>') END AS notes FROM {pages}""",
    "m_questions": """
        SELECT item_id AS question_id, trim(text) AS question FROM {benchmark}""",
    # Jobs: a user is a job, events are its history.
    "m_events": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'waiting'
               WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CAST(least(100, floor(abs(value))) AS INT) AS progress, props AS data FROM {events}""",
    "m_jobs": """
        SELECT job_id, min(event_id) AS created, max(event_id) AS updated, count(*) AS n_events, CAST(job_id % 5 AS INT) AS priority,
               CASE WHEN job_id % 3 = 0 THEN 'lecture' WHEN job_id % 3 = 1 THEN 'translation' ELSE 'review' END AS kind,
               @LATEST(status, event_id) AS status, CASE WHEN job_id % 3 = 0 THEN NULL ELSE job_id - 1 END AS source_job_id,
               CASE WHEN job_id % 3 = 0 THEN 'subject_' || CAST(job_id % 7 AS STRING) END AS subject
        FROM {m_events} GROUP BY job_id""",
}

_SPARK = [("@BYTES(text)", "octet_length(text)"), ("@SHA(text)", "sha2(text, 256)"), ("@DIV", "div"), ("@LATEST(status, event_id)", "max_by(status, event_id)")]
_DUCK = [("array_join(", "array_to_string("), ("@BYTES(text)", "strlen(text)"), ("@SHA(text)", "sha256(text)"), ("@DIV", "//"), ("AS STRING", "AS VARCHAR"), ("@LATEST(status, event_id)", "arg_max(status, event_id)")]


def _written(name: str, spark: bool) -> str:
    sql = TABLES[name]
    for a, b in _SPARK if spark else _DUCK:
        sql = sql.replace(a, b)
    return re.sub(r"@EXTRACT\((\w+), ('[^']*')\)", r"regexp_extract(\1, \2, 1)", sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _RAW:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        # A text table in fewer splits than there are cores is spread; a large one already is.
        return df.repartition(cores) if name in ("documents", "embeddings") and df.rdd.getNumPartitions() < cores else df
    sql = _written(name, True)
    return spark.sql(sql, **{t: frame(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def cte(*names: str) -> str:
    """WITH clause of these tables and what they need, for the SQL oracle."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in _RAW and name not in order:
            for t in re.findall(r"\{(\w+)\}", TABLES[name]):
                add(t)
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _written(n, False))})" for n in order)


def query(operator, *names: str):
    """A registered query: the operator on these tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(frame(spark, sf_dir, n) for n in names))

    run.__doc__ = operator.__doc__
    return run
