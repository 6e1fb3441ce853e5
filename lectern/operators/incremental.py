"""Content-addressed reuse, staleness and integrity audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.durable import shared_folder
from lectern.functions.rules import clean_text, suffix
from lectern.operators.align import _anchored, backtracks, coverage_diff, source_coverage
from lectern.sources import artifacts
from lectern.sources.model import cte, query

VERSION = 2
# Endings of recordings, and the files that a lecture with one consists of.
RECORDINGS = (".m4a", ".mp3", ".wav", ".flac", ".ogg", ".opus", ".aac", ".mp4", ".mov", ".webm", ".m4v", ".mkv")
PORTABLE = ("slides.json", "slide_summaries.json", "alignment.json", "transcript.json", "transcript.txt")


def batch_digests(rows: DataFrame, version: int = VERSION, settings: str = "") -> DataFrame:
    """#94: one digest per batch over its rows in order; fields are separated by U+001F, rows by U+001E."""
    row = F.concat_ws("\x1f", F.col("segment").cast("string"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), clean_text("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", row.alias("row")))), lambda x: x["row"]), "\x1e")
    return rows.groupBy("lecture", "batch").agg(F.sha2(F.concat_ws("\x1e", F.lit(str(version)), F.lit(settings), body), 256).alias("digest"))


def reuse_plan(now: DataFrame, before: DataFrame) -> DataFrame:
    """#95: batches whose digest and version are unchanged and whose result is valid are reused, all others are to do."""
    old = before.filter("valid").select("lecture", "batch", F.col("digest").alias("old"), "result")
    out = now.join(old, ["lecture", "batch"], "left")
    same = F.col("digest") == F.col("old")
    return out.select("lecture", "batch", F.when(same, F.col("result")).alias("result"), (~F.coalesce(same, F.lit(False))).alias("to_do"))


def staleness(lectures: DataFrame, alignment: DataFrame, coverage: DataFrame) -> DataFrame:
    """#96: why a lecture's results need rebuilding."""
    a = alignment.groupBy("lecture").agg(F.max("version").alias("version"))
    c = coverage.groupBy("lecture").agg(F.count("*").alias("covered"))
    out = lectures.join(a, "lecture", "left").join(c, "lecture", "left")
    reasons = F.array_compact(F.array(F.when(F.col("version").isNull(), "alignment missing"), F.when(F.col("version") < VERSION, "alignment version"), F.when(F.col("covered").isNull(), "source coverage missing")))
    return out.select("lecture", F.array_join(reasons, "; ").alias("reasons")).filter("reasons <> ''")


def provenance_backfill(notes: DataFrame, coverage: DataFrame) -> DataFrame:
    """#97: notes whose stored source flags differ from the recomputed ones, with the new flags; a second run finds none."""
    both = notes.join(coverage, ["lecture", "slide"])
    differs = ~(F.col("has_slide").eqNullSafe(F.col("slide_evidence")) & F.col("has_audio").eqNullSafe(F.col("teacher_audio")))
    return both.filter(differs).select("lecture", "slide", F.col("slide_evidence").alias("has_slide"), F.col("teacher_audio").alias("has_audio"), F.lit(True).alias("reconstructed"))


def file_audit(files: DataFrame, disk: DataFrame) -> DataFrame:
    """#98: violations (level, rule, what) of stored files, one query per rule."""
    both = files.join(disk.select("path", F.col("size_bytes").alias("found_size"), F.col("digest").alias("found_digest"), "head"), "path", "left")
    say = lambda df, rule: _said(df, "error", rule, F.col("path"))
    return (
        say(both.filter("found_size IS NULL"), "missing file")
        .unionByName(say(both.filter("found_size <> size_bytes"), "size"))
        .unionByName(say(both.filter("found_size = size_bytes AND found_digest <> digest"), "digest"))
        .unionByName(say(both.filter("head LIKE 'version https://git-lfs%'"), "pointer file"))
        .unionByName(say(both.filter(F.col("path").rlike(r"(^|/)\.\.(/|$)")), "path escape"))
    )


def folder_audit(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """#98: files that a folder with results lacks, and folders with a recording that have no results at all.

    `artifacts` holds (subject, folder, artifact). A folder without a recording needs its notes only.
    """
    place = ["subject", "folder"]
    what = F.concat_ws("/", *place)
    folders = docs.filter("folder IS NOT NULL").groupBy(*place).agg(F.bool_or(suffix(F.col("name")).isin(*RECORDINGS)).alias("recorded"))
    built = artifacts.select(*place).distinct()
    needed = F.explode(F.when(F.col("recorded"), F.array(*map(F.lit, PORTABLE))).otherwise(F.array(F.lit("slide_summaries.json")))).alias("artifact")
    lost = folders.join(built, place, "left_semi").select(*place, needed).join(artifacts, [*place, "artifact"], "left_anti")
    none = folders.filter("recorded").join(built, place, "left_anti")
    return _said(lost, "error", "missing artifact", F.concat_ws("/", *place, "artifact")).unionByName(_said(none, "error", "no artifacts", what))


def lecture_audit(alignment: DataFrame, slides: DataFrame, notes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """#98: violations of a lecture's results: notes that do not cover its deck once each, empty notes, alignments to nothing or backwards."""
    known, place = slides.select("lecture", "slide").distinct(), F.concat_ws("/", "lecture", "slide")
    decks = slides.select("lecture").distinct()
    uncovered = coverage_diff(slides, notes).join(decks, "lecture", "left_semi").select("lecture").distinct()
    empty = notes.filter(clean_text("note") == "").select("lecture", "slide").distinct()
    unknown = alignment.join(decks, "lecture", "left_semi").join(known, ["lecture", "slide"], "left_anti").select("lecture", "slide").distinct()
    unheard = alignment.join(paragraphs.select("lecture", "paragraph"), ["lecture", "paragraph"], "left_anti").select("lecture", "paragraph").distinct()
    back = backtracks(alignment).select("lecture").distinct()
    return (
        _said(uncovered, "error", "slide set", F.col("lecture").cast("string"))
        .unionByName(_said(empty, "error", "empty note", place))
        .unionByName(_said(unknown, "error", "unknown slide", place))
        .unionByName(_said(unheard, "error", "unknown paragraph", F.concat_ws("/", "lecture", "paragraph")))
        .unionByName(_said(back, "warning", "backwards", F.col("lecture").cast("string")))
    )


def _said(rows: DataFrame, level: str, rule: str, what) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), what.alias("what"))


def _batched(s: DataFrame) -> DataFrame:
    return s.withColumn("batch", F.floor(F.col("segment") / 3))


def _reuse(s: DataFrame) -> DataFrame:
    now = batch_digests(_batched(s))
    old = batch_digests(_batched(s.withColumn("text", F.when(F.col("lecture") % 4 == 1, F.upper("text")).otherwise(F.col("text")))))
    return reuse_plan(now, old.filter("batch <> 1").withColumns({"valid": F.col("lecture") % 7 != 0, "result": F.concat(F.lit("r"), F.col("batch").cast("string"))}))


def _files(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = F.col("document_id")
    path = F.concat(F.when(i % 97 == 0, "../").otherwise(""), F.lit("files/"), F.col("name"))
    files = d.select(path.alias("path"), "size_bytes", "digest")
    disk = d.filter(i % 50 != 3).select(path.alias("path"), F.when(i % 60 == 7, 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(i % 45 == 2, "x").otherwise(F.col("digest")).alias("digest"), F.when(i % 80 == 9, "version https://git-lfs v1").otherwise("text").alias("head"))
    return files, disk


def _audit(d: DataFrame, s: DataFrame) -> DataFrame:
    """Files, folders and lectures with planted faults."""
    alignment = _anchored(s).withColumn("slide", F.when(F.col("paragraph") % 23 == 1, F.col("slide") + 50).otherwise(F.col("slide")))
    # Lectures with odd numbers have a note for every slide, half of the others lack some.
    notes = s.filter("lecture % 2 = 1 OR length(content) >= 1000").select("lecture", "slide", F.when(F.col("title").contains("7"), " ").otherwise("note").alias("note"))
    paragraphs = s.select("lecture", F.explode(F.sequence(F.col("slide") * 3, F.col("slide") * 3 + 1)).alias("paragraph"))
    named = d.withColumn("name", F.when(F.col("document_id") % 8 == 1, F.concat("name", F.lit(".M4A"))).otherwise(F.col("name")))
    artifacts = d.filter("folder IS NOT NULL").select("subject", "folder", F.element_at(F.array(*map(F.lit, PORTABLE)), (F.col("document_id") % 5 + 1).cast("int")).alias("artifact")).filter("subject NOT LIKE '%3'").distinct()
    return file_audit(*_files(d)).unionByName(folder_audit(named, artifacts)).unionByName(lecture_audit(alignment, s, notes, paragraphs))


def _provenance(s: DataFrame) -> DataFrame:
    slides = s.withColumn("notes", F.lit(""))
    notes = s.select("lecture", "slide", (F.col("slide") % 2 == 0).alias("has_slide"), F.when(F.col("slide") % 3 > 0, F.lit(True)).alias("has_audio"))
    return provenance_backfill(notes, source_coverage(slides, _anchored(s)))


_S, _L = cte("m_segments"), cte("m_slides")
_WS = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_DG = lambda text, where="": f"SELECT lecture, segment // 3 AS batch, sha256(concat_ws(chr(30), '2', '', string_agg(concat_ws(chr(31), segment, start_ms, end_ms, {_WS.format(text)}), chr(30) ORDER BY segment))) AS digest FROM m_segments {where} GROUP BY 1, 2"
_AN = """an AS (SELECT lecture, p AS paragraph, CASE WHEN p % 17 = 5 THEN greatest(1, slide - 2) ELSE slide END AS slide, CASE WHEN p % 5 = 0 THEN ' ' ELSE 'said' END AS text FROM (SELECT lecture, slide, unnest(range(slide * 3, slide * 3 + 3)) AS p FROM m_slides WHERE slide % 4 <> 3))"""

def _slide_files(slides: DataFrame) -> DataFrame:
    """Slide files of lectures with broken files and items among them."""
    item = F.expr("""CASE WHEN slide % 11 = 0 THEN '5' WHEN slide % 7 = 0 THEN '{"slide":"x"}' WHEN slide % 5 = 0 THEN '{"slide":"' || slide || '","title":4}' ELSE '{"slide":' || slide || ',"title":"t' || slide || '","extra":[1]}' END""")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", item.alias("item")))), lambda x: x["item"]), ",")
    rows = slides.groupBy("lecture").agg(listed.alias("items"))
    value = F.when(F.col("lecture") % 5 == 0, F.lit("[{")).when(F.col("lecture") % 5 == 1, F.lit('{"pages": []}')).when(F.col("lecture") % 5 == 2, F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit('{"slides":['), "items", F.lit("]}")))
    return rows.select(F.lit("s").alias("subject"), F.col("lecture").cast("string").alias("lecture"), value.alias("value"))


def _exported(slides: DataFrame) -> DataFrame:
    """Slides that went through files and back."""
    spark = slides.sparkSession
    folder = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    rows = slides.select(F.concat(F.lit("subject "), (F.col("lecture") % 3).cast("string")).alias("subject"), F.col("lecture").cast("string").alias("lecture"), F.col("slide").cast("int").alias("slide"), "title", "content", "notes")
    artifacts.export_artifacts(rows, "slides", folder)
    return artifacts.read_slides(artifacts.exported_files(spark, folder, "slides")).select("subject", "lecture", "slide", "title", "content", "notes")


QUERIES = {
    "artifact_slides": query(_exported, "m_slides"),
    "artifact_titles": query(lambda s: artifacts.read_slides(_slide_files(s)).select("lecture", "slide", "title"), "m_slides"),
    "artifact_rejects": query(lambda s: artifacts.rejected_items(_slide_files(s), "slides"), "m_slides"),
    "batch_digests": query(lambda s: batch_digests(_batched(s)), "m_segments"),
    "reuse_plan": query(_reuse, "m_segments"),
    "staleness_plan": query(lambda s: staleness(s.select("lecture").distinct(), s.filter("lecture % 5 > 0").select("lecture", (F.col("lecture") % 3).alias("version")), s.filter("lecture % 4 <> 2").select("lecture")), "m_slides"),
    "provenance_backfill": query(_provenance, "m_slides"),
    "integrity_audit": query(_audit, "m_docs", "m_slides"),
}

ORACLES = {
    "artifact_slides": f"{_L} SELECT 'subject ' || lecture % 3 AS subject, lecture::VARCHAR AS lecture, slide, title, content, notes FROM m_slides",
    "artifact_titles": f"{_L} SELECT lecture::VARCHAR AS lecture, slide, CASE WHEN slide % 5 = 0 THEN '4' ELSE 't' || slide END AS title FROM m_slides WHERE lecture % 5 > 1 AND slide % 11 <> 0 AND slide % 7 <> 0",
    "artifact_rejects": f"""{_L}, i AS (SELECT lecture, slide, row_number() OVER (PARTITION BY lecture ORDER BY slide) - 1 AS item FROM m_slides WHERE lecture % 5 > 1)
      SELECT 's' AS subject, lecture::VARCHAR AS lecture, item, CASE WHEN slide % 11 = 0 THEN 'no object' ELSE 'no slide number' END AS reason FROM i WHERE slide % 11 = 0 OR slide % 7 = 0
      UNION ALL SELECT DISTINCT 's', lecture::VARCHAR, NULL, CASE lecture % 5 WHEN 0 THEN 'not JSON' ELSE 'no list of items' END FROM m_slides WHERE lecture % 5 <= 1""",
    "batch_digests": f"{_S} {_DG('text')}",
    "reuse_plan": f"{_S}, a AS ({_DG('text')}), b AS ({_DG('CASE WHEN lecture % 4 = 1 THEN upper(text) ELSE text END')}) SELECT a.lecture, a.batch, CASE WHEN b.digest = a.digest THEN 'r' || a.batch END AS result, b.digest IS DISTINCT FROM a.digest AS to_do FROM a LEFT JOIN b ON b.lecture = a.lecture AND b.batch = a.batch AND b.batch <> 1 AND b.lecture % 7 <> 0",
    "staleness_plan": f"{_L}, l AS (SELECT DISTINCT lecture FROM m_slides), r AS (SELECT lecture, concat_ws('; ', CASE WHEN lecture % 5 = 0 THEN 'alignment missing' WHEN lecture % 3 < 2 THEN 'alignment version' END, CASE WHEN lecture % 4 = 2 THEN 'source coverage missing' END) AS reasons FROM l) SELECT * FROM r WHERE reasons <> ''",
    "provenance_backfill": f"""{_L}, {_AN}, c AS (SELECT s.lecture, s.slide, trim(title) NOT IN ('', 'slide', 'Slide ' || s.slide, s.slide::VARCHAR) OR trim(content) <> '' AS a, EXISTS (FROM an WHERE an.lecture = s.lecture AND an.slide = s.slide AND trim(text) <> '') AS b FROM m_slides s)
      SELECT lecture, slide, a AS has_slide, b AS has_audio, true AS reconstructed FROM c WHERE a <> (slide % 2 = 0) OR b IS DISTINCT FROM CASE WHEN slide % 3 > 0 THEN true END""",
    "integrity_audit": f"""{cte("m_docs", "m_slides")}, f AS (SELECT document_id AS i, CASE WHEN document_id % 97 = 0 THEN '../' ELSE '' END || 'files/' || name AS path, size_bytes FROM m_docs),
      al AS (SELECT lecture, p, CASE WHEN p % 23 = 1 THEN s + 50 ELSE s END AS slide, CASE WHEN p % 3 < lecture % 4 THEN 'temporal_fallback' WHEN lecture % 2 = 0 AND p % 17 = 5 THEN 'spoken_reference' ELSE 'semantic' END AS method FROM (SELECT lecture, p, CASE WHEN p % 17 = 5 THEN greatest(1, slide - 2) ELSE slide END AS s FROM (SELECT lecture, slide, unnest(range(slide * 3, slide * 3 + 3)) AS p FROM m_slides WHERE slide % 4 <> 3)))
      SELECT 'error' AS level, 'missing file' AS rule, path AS what FROM f WHERE i % 50 = 3 UNION ALL SELECT 'error', 'size', path FROM f WHERE i % 50 <> 3 AND i % 60 = 7 AND size_bytes <> 1 UNION ALL SELECT 'error', 'digest', path FROM f WHERE i % 50 <> 3 AND i % 45 = 2 AND (i % 60 <> 7 OR size_bytes = 1)
      UNION ALL SELECT 'error', 'pointer file', path FROM f WHERE i % 50 <> 3 AND i % 80 = 9 UNION ALL SELECT 'error', 'path escape', path FROM f WHERE i % 97 = 0 UNION ALL SELECT DISTINCT 'error', 'unknown slide', lecture || '/' || slide FROM al WHERE (lecture, slide) NOT IN (SELECT (lecture, slide) FROM m_slides)
      UNION ALL SELECT 'error', 'slide set', lecture::VARCHAR FROM m_slides GROUP BY lecture HAVING lecture % 2 = 0 AND bool_or(length(content) < 1000)
      UNION ALL SELECT 'error', 'empty note', lecture || '/' || slide FROM m_slides WHERE (lecture % 2 = 1 OR length(content) >= 1000) AND contains(title, '7')
      UNION ALL SELECT DISTINCT 'error', 'unknown paragraph', lecture || '/' || p FROM al WHERE p % 3 = 2
      UNION ALL SELECT DISTINCT 'warning', 'backwards', lecture::VARCHAR FROM (SELECT lecture, method, slide < lag(slide) OVER (PARTITION BY lecture ORDER BY p) AS back FROM al) WHERE back AND method <> 'spoken_reference'
      UNION ALL SELECT 'error', CASE WHEN artifact IS NULL THEN 'no artifacts' ELSE 'missing artifact' END, concat_ws('/', subject, folder, artifact) FROM (
        SELECT subject, folder, CASE WHEN subject NOT LIKE '%3' THEN unnest(CASE WHEN recorded THEN names ELSE ['slide_summaries.json'] END) END AS artifact, recorded, have FROM (
          SELECT subject, folder, bool_or(document_id % 8 = 1) AS recorded, list(DISTINCT document_id % 5) AS have, {list(PORTABLE)} AS names FROM m_docs WHERE folder IS NOT NULL GROUP BY ALL))
        WHERE CASE WHEN artifact IS NULL THEN recorded ELSE NOT list_contains(have, list_position({list(PORTABLE)}, artifact) - 1) END GROUP BY ALL""",
}
