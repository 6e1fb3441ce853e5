"""Transcript operators: plans, segments, paragraphs, cues and decisions.

Times are integer milliseconds; order within a lecture is the segment number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import clean_text, clock, words_with_terms
from lectern.sources.model import cte, query

GAP_MS, PARAGRAPH_CHARS = 2750, 900
SECTION_MS = 900_000
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


def media_plan(lectures: DataFrame, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """#39: (lecture, duration_ms) to cores that tile the recording, with extracts that overlap their neighbours."""
    n = F.ceil(F.col("duration_ms") / chunk_ms)
    at = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk")
    rows = lectures.filter("duration_ms > 0").select("lecture", "duration_ms", at)
    start, end = F.col("chunk") * chunk_ms, F.least(F.col("duration_ms"), (F.col("chunk") + 1) * chunk_ms)
    return rows.select("lecture", "chunk", start.alias("core_start"), end.alias("core_end"), F.greatest(F.lit(0), start - overlap_ms).alias("extract_start"), F.least(F.col("duration_ms"), end + overlap_ms).alias("extract_end"))


def owned_segments(heard: DataFrame, plan: DataFrame) -> DataFrame:
    """#32: of segments heard by overlapping chunks, those whose midpoint lies in the chunk's own core; the last core is open."""
    last = F.col("core_end") == F.max("core_end").over(Window.partitionBy("lecture"))
    cores = plan.select("lecture", "chunk", "core_start", "core_end", last.alias("is_last"))
    mid = F.col("start_ms") + F.col("end_ms")
    joined = heard.join(cores, ["lecture", "chunk"])
    return joined.filter((mid >= 2 * F.col("core_start")) & (F.col("is_last") | (mid < 2 * F.col("core_end")))).select("lecture", "chunk", "segment")


def renumbered(segments: DataFrame) -> DataFrame:
    """#43: running numbers in the order of chunk, then start."""
    w = Window.partitionBy("lecture").orderBy("chunk", "segment")
    return segments.select("lecture", "segment", F.row_number().over(w).alias("id"))


def paragraphs(segments: DataFrame, gap_ms: int = GAP_MS, most: int = PARAGRAPH_CHARS) -> DataFrame:
    """#44: segments joined until a pause is longer than the gap or the text would exceed the limit.

    The fold keeps one boundary per paragraph; texts are put together once at the end.
    """
    row = F.struct("segment", "start_ms", "end_ms", F.length("text").alias("n"))
    rows = segments.groupBy("lecture").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("end_ms"), F.lit(0).alias("n"), F.array().cast("array<struct<segment:long,no:int>>").alias("out"))

    def step(acc, x):
        new = (acc["no"] == 0) | (x["start_ms"] - acc["end_ms"] > gap_ms) | (acc["n"] + x["n"] > most)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        size = F.when(new, x["n"]).otherwise(acc["n"] + x["n"] + 1)
        return F.struct(no.alias("no"), x["end_ms"].alias("end_ms"), size.alias("n"), F.array_append(acc["out"], F.struct(x["segment"].alias("segment"), no.alias("no"))).alias("out"))

    numbered = rows.select("lecture", F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("x")).select("lecture", "x.segment", F.col("x.no").alias("paragraph"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "text")))
    return (
        segments.join(numbered, ["lecture", "segment"])
        .groupBy("lecture", "paragraph")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.array_sort(F.collect_list("segment")).alias("segment_ids"))
    )


def transcript_metadata(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """#67: chunk counts, duration and whether chunks are missing."""
    have = segments.groupBy("lecture").agg(F.count_distinct("chunk").alias("completed"), F.max("end_ms").alias("last_ms"), F.count("*").alias("segments"))
    want = plan.groupBy("lecture").agg(F.count("*").alias("total"), F.max("core_end").alias("duration_ms"))
    out = want.join(have, "lecture", "left").fillna(0, ["completed", "segments"])
    return out.select("lecture", "total", "completed", "segments", "duration_ms", "last_ms", (F.col("completed") < F.col("total")).alias("is_partial"))


def recording_sections(segments: DataFrame, length_ms: int = SECTION_MS) -> DataFrame:
    """#49: equal tiles up to the last end, titled by their times."""
    spans = segments.groupBy("lecture").agg(F.max("end_ms").alias("last"))
    n = F.greatest(F.lit(1), F.ceil(F.col("last") / length_ms))
    rows = spans.select("lecture", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("section"), "last")
    start, end = (F.col("section") - 1) * length_ms, F.least(F.col("last"), F.col("section") * length_ms)
    return rows.select("lecture", "section", start.alias("start_ms"), end.alias("end_ms"), F.concat(clock(start / 1000), F.lit("–"), clock(end / 1000)).alias("title"))


def section_of_segments(segments: DataFrame, sections: DataFrame, length_ms: int = SECTION_MS) -> DataFrame:
    """#31: the first section that ends after the midpoint, else the last one. Tiles are equal, so the range join is arithmetic."""
    n = sections.groupBy("lecture").agg(F.count("*").alias("n"))
    mid2 = F.col("start_ms") + F.col("end_ms")
    section = F.least(F.floor(mid2 / (2 * length_ms)) + 1, F.col("n"))
    return segments.join(n, "lecture").select("lecture", "segment", section.alias("section"), F.lit(1.0).alias("confidence"))


def merged_decisions(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """#33: texts that decisions keep, in their cleaned form."""
    return segments.join(decisions, ["lecture", "segment"]).filter("keep").select("lecture", "segment", "clean_text")


def missing_decisions(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """#33: segments without a decision; an error unless the pass is partial."""
    return segments.join(decisions, ["lecture", "segment"], "left_anti").select("lecture", "segment")


def decision_audit(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """#64: kept and removed counts, and the removed ones with their reasons."""
    both = segments.join(decisions, ["lecture", "segment"])
    gone = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.concat(F.col("segment").cast("string"), F.lit(": "), F.col("reason")))))
    return both.groupBy("lecture").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"), F.array_join(gone, "; ").alias("removed_list"))


def raw_and_clean(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """#28: cleaned cues beside the raw text; blank cues go, a missing end is the start."""
    kept = decisions.filter("keep AND trim(clean_text) <> ''").select("lecture", "segment", "clean_text")
    return kept.join(segments, ["lecture", "segment"], "left").select("lecture", "segment", "clean_text", F.col("text").alias("raw_text"), "start_ms", F.coalesce("end_ms", "start_ms").alias("end_ms"))


def usable_transcripts(transcripts: DataFrame) -> DataFrame:
    """#19: kind empty or `cleaned`, cleanup enabled, text not blank."""
    return transcripts.filter("(kind = '' OR kind = 'cleaned') AND cleanup AND trim(text) <> ''").select("lecture", "segment", "kind")


def word_retention(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """#63: share of the kept segments' words, as a multiset, that cleaned texts retain, and the ratio of lengths."""
    kept = segments.join(decisions, ["lecture", "segment"]).filter("keep")
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"((?U)[\w'-]+)"), 1)).alias("word")
    raw = kept.select("lecture", words("text")).groupBy("lecture", "word").agg(F.count("*").alias("a"))
    new = kept.select("lecture", words("clean_text")).groupBy("lecture", "word").agg(F.count("*").alias("b"))
    share = raw.join(new, ["lecture", "word"], "left").groupBy("lecture").agg(F.sum("a").alias("words"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("retained"))
    size = kept.groupBy("lecture").agg(F.sum(F.length("text")).alias("raw_chars"), F.sum(F.length("clean_text")).alias("clean_chars"))
    ratio = F.col("clean_chars") / F.col("raw_chars")
    ok = (F.col("retained") >= 0.55 * F.col("words")) & ratio.between(0.45, 1.65)
    return share.join(size, "lecture").select("lecture", "words", "retained", "raw_chars", "clean_chars", ok.alias("passed"))


def cues_at(times: DataFrame, cues: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """#29: per (lecture, t_ms) the first cue with start <= t <= max(end, start + 500), else the latest started one.

    Cues are listed in every bucket that they span, so the interval join is an equi-join.
    """
    end = F.greatest(F.col("end_ms"), F.col("start_ms") + 500)
    spread = cues.select("lecture", "segment", "start_ms", end.alias("until"), F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(end / bucket_ms))).alias("bucket"))
    asked = times.withColumn("bucket", F.floor(F.col("t_ms") / bucket_ms))
    active = asked.join(spread, ["lecture", "bucket"]).filter("start_ms <= t_ms AND t_ms <= until").groupBy("lecture", "t_ms").agg(F.min("segment").alias("active"))
    # As-of fallback: times and cues in one ordered stream, the last cue start seen so far.
    both = times.select("lecture", "t_ms", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("segment")).unionByName(cues.select("lecture", F.col("start_ms").alias("t_ms"), F.lit(0).alias("kind"), F.col("segment").cast("long").alias("segment")))
    w = Window.partitionBy("lecture").orderBy("t_ms", "kind", "segment").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("latest", F.last("segment", ignorenulls=True).over(w)).filter("kind = 1").select("lecture", "t_ms", "latest").distinct()
    return latest.join(active, ["lecture", "t_ms"], "left").select("lecture", "t_ms", F.coalesce("active", "latest").alias("segment"))


def active_cue_changes(times: DataFrame, cues: DataFrame) -> DataFrame:
    """#91: of the cues at successive times, only the changes."""
    now = cues_at(times, cues)
    before = F.lag("segment").over(Window.partitionBy("lecture").orderBy("t_ms"))
    return now.withColumn("before", before).filter("NOT segment <=> before").select("lecture", "t_ms", "segment")


def focus_cues(questions: DataFrame, cues: DataFrame, most: int = 12) -> DataFrame:
    """#30: per question the cue that contains most of its terms of three letters or more; the earliest on a tie."""
    terms = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"([a-z0-9]{3,})"), 1)), 1, most)
    asked = questions.select("question_id", F.explode(terms).alias("term"))
    # Terms meet the cues' own words of which they are a part, so only words are compared, once each.
    words = cues.select("lecture", "segment", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9]+"))).alias("word"))
    hits = words.join(words_with_terms(words, asked), "word").select("lecture", "segment", "term").distinct().join(asked, "term")
    n = hits.groupBy("question_id", "lecture", "segment").agg(F.count("*").alias("hits"))
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hits"), "lecture", "segment"))
    return n.withColumn("place", best).filter("place = 1").select("question_id", "lecture", "segment", "hits")


def truncated_narration(segments: DataFrame) -> DataFrame:
    """#106: segments shorter than 0.42 of the time that their words (175 a minute) and CJK characters (4.5 a second) need."""
    plain = F.regexp_replace("text", CJK, " ")
    words, cjk = F.size(F.regexp_extract_all(plain, F.lit(r"((?U)\b[\w']+\b)"), 1)), F.length("text") - F.length(F.regexp_replace("text", CJK, ""))
    least = F.greatest(F.lit(0.18), (words * 60 / 175 + cjk / 4.5) * 0.42)
    return segments.select("lecture", "segment", ((F.col("end_ms") - F.col("start_ms")) / 1000 < least).alias("short")).groupBy("lecture").agg(F.count("*").alias("segments"), F.count_if("short").alias("short_segments"))


def transcript_text(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """#9: one text per lecture: `[from–to] text` blocks of its paragraphs, or of its segments where it has none; blank ones are dropped."""
    blocks = paragraphs.select("lecture", F.col("paragraph").cast("long").alias("place"), "start_ms", "end_ms", "text")
    single = segments.select("lecture", F.col("segment").cast("long").alias("place"), "start_ms", "end_ms", "text")
    units = blocks.unionByName(single.join(paragraphs.select("lecture").distinct(), "lecture", "left_anti"))
    line = F.concat(F.lit("["), clock(F.col("start_ms") / 1000), F.lit("–"), clock(F.col("end_ms") / 1000), F.lit("] "), clean_text("text"))
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return units.filter(clean_text("text") != "").groupBy("lecture").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))


def _durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy("lecture").agg(F.max("end_ms").alias("duration_ms"))


def _plan(segments: DataFrame) -> DataFrame:
    return media_plan(_durations(segments), 60_000, 15_000)


def _heard(segments: DataFrame) -> DataFrame:
    p = _plan(segments).select("lecture", "chunk", "extract_start", "extract_end")
    return segments.join(p, "lecture").filter("start_ms < extract_end AND end_ms > extract_start").select("lecture", "chunk", "segment", "start_ms", "end_ms")


def _times(segments: DataFrame) -> DataFrame:
    return _durations(segments).select("lecture", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(7000).cast("long"))).alias("t_ms"))


def _chunked(segments: DataFrame) -> DataFrame:
    return segments.withColumn("chunk", F.floor(F.col("start_ms") / 60_000)).filter("lecture % 4 <> 0 OR chunk <> 1")


_S, _SD = cte("m_segments"), cte("m_segments", "m_decisions")
_CLOCK = "lpad((({0}) // 3600)::VARCHAR, greatest(2, length((({0}) // 3600)::VARCHAR))::INT, '0') || ':' || lpad((({0}) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) % 60)::VARCHAR, 2, '0')"
_SEC = lambda c: _CLOCK.format(f"round_even({c} / 1000.0, 0)::BIGINT")
_DUR = "du AS (SELECT lecture, max(end_ms) AS d FROM m_segments GROUP BY lecture)"
_PLAN = f"{_DUR}, pl AS (SELECT lecture, chunk, chunk * 60000 AS core_start, least(d, (chunk + 1) * 60000) AS core_end, greatest(0, chunk * 60000 - 15000) AS extract_start, least(d, least(d, (chunk + 1) * 60000) + 15000) AS extract_end, d FROM (SELECT lecture, d, unnest(range(0, ceil(d / 60000.0)::BIGINT)) AS chunk FROM du))"
_CUES = f"{_DUR}, t AS (SELECT lecture, unnest(range(0, d + 1, 7000)) AS t_ms FROM du), c AS (SELECT lecture, t_ms, coalesce((SELECT min(segment) FROM m_segments s WHERE s.lecture = t.lecture AND start_ms <= t_ms AND t_ms <= greatest(end_ms, start_ms + 500)), (SELECT max_by(segment, start_ms) FROM m_segments s WHERE s.lecture = t.lecture AND start_ms <= t_ms)) AS segment FROM t)"
_WS = r"regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')"

QUERIES = {
    "media_plan": query(_plan, "m_segments"),
    "overlap_dedup": query(lambda s: owned_segments(_heard(s), _plan(s)), "m_segments"),
    "segment_renumber": query(lambda s: renumbered(owned_segments(_heard(s), _plan(s))), "m_segments"),
    "paragraphs": query(paragraphs, "m_segments"),
    "transcript_metadata": query(lambda s: transcript_metadata(_chunked(s), _plan(s)), "m_segments"),
    "recording_sections": query(lambda s: recording_sections(s, 30_000), "m_segments"),
    "section_assignment": query(lambda s: section_of_segments(s, recording_sections(s, 30_000), 30_000), "m_segments"),
    "decision_merge": query(merged_decisions, "m_segments", "m_decisions"),
    "missing_decisions": query(lambda s, d: missing_decisions(s, d.filter("segment % 7 <> 3")), "m_segments", "m_decisions"),
    "decision_audit": query(decision_audit, "m_segments", "m_decisions"),
    "raw_clean_audit": query(raw_and_clean, "m_segments", "m_decisions"),
    "usable_transcripts": query(lambda s: usable_transcripts(s.select("lecture", "segment", "text", F.expr("CASE segment % 3 WHEN 0 THEN '' WHEN 1 THEN 'cleaned' ELSE 'raw' END").alias("kind"), (F.col("lecture") % 4 > 0).alias("cleanup"))), "m_segments"),
    "word_retention": query(word_retention, "m_segments", "m_decisions"),
    "cue_lookup": query(lambda s: cues_at(_times(s), s), "m_segments"),
    "active_cue_changes": query(lambda s: active_cue_changes(_times(s), s), "m_segments"),
    "focus_cues": query(focus_cues, "m_questions", "m_segments"),
    "truncated_narration": query(truncated_narration, "m_segments"),
    "transcript_text": query(lambda s: transcript_text(paragraphs(s.filter("lecture % 3 <> 0")), s), "m_segments"),
}

ORACLES = {
    "media_plan": f"{_S}, {_PLAN} SELECT lecture, chunk, core_start, core_end, extract_start, extract_end FROM pl",
    "overlap_dedup": f"{_S}, {_PLAN} SELECT lecture, chunk, segment FROM m_segments s JOIN pl USING (lecture) WHERE start_ms < extract_end AND end_ms > extract_start AND start_ms + end_ms >= 2 * core_start AND (core_end = d OR start_ms + end_ms < 2 * core_end)",
    "segment_renumber": f"{_S}, {_PLAN} SELECT lecture, segment, row_number() OVER (PARTITION BY lecture ORDER BY chunk, segment) AS id FROM m_segments s JOIN pl USING (lecture) WHERE start_ms < extract_end AND end_ms > extract_start AND start_ms + end_ms >= 2 * core_start AND (core_end = d OR start_ms + end_ms < 2 * core_end)",
    "paragraphs": f"""{_S}, o AS (SELECT *, row_number() OVER (PARTITION BY lecture ORDER BY segment) AS k, length(text) AS n FROM m_segments),
      f AS (SELECT lecture, k, segment, 1 AS paragraph, n AS size, end_ms AS e FROM o WHERE k = 1 UNION ALL
        SELECT o.lecture, o.k, o.segment, CASE WHEN o.start_ms - f.e > 2750 OR f.size + o.n > 900 THEN f.paragraph + 1 ELSE f.paragraph END, CASE WHEN o.start_ms - f.e > 2750 OR f.size + o.n > 900 THEN o.n ELSE f.size + o.n + 1 END, o.end_ms FROM f JOIN o ON o.lecture = f.lecture AND o.k = f.k + 1)
      SELECT lecture, paragraph, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY segment) AS text, list(segment ORDER BY segment) AS segment_ids FROM f JOIN m_segments USING (lecture, segment) GROUP BY lecture, paragraph""",
    "transcript_metadata": f"""{_S}, {_PLAN}, h AS (SELECT lecture, count(DISTINCT start_ms // 60000) AS completed, max(end_ms) AS last_ms, count(*) AS segments FROM m_segments WHERE lecture % 4 <> 0 OR start_ms // 60000 <> 1 GROUP BY lecture), w AS (SELECT lecture, count(*) AS total, max(core_end) AS duration_ms FROM pl GROUP BY lecture)
      SELECT lecture, total, coalesce(completed, 0) AS completed, coalesce(segments, 0) AS segments, duration_ms, last_ms, coalesce(completed, 0) < total AS is_partial FROM w LEFT JOIN h USING (lecture)""",
    "recording_sections": f"{_S}, {_DUR} SELECT lecture, section, (section - 1) * 30000 AS start_ms, least(d, section * 30000) AS end_ms, {_SEC('((section - 1) * 30000)')} || '–' || {_SEC('least(d, section * 30000)')} AS title FROM (SELECT lecture, d, unnest(range(1, greatest(1, ceil(d / 30000.0)::BIGINT) + 1)) AS section FROM du)",
    "section_assignment": f"{_S}, {_DUR}, n AS (SELECT lecture, greatest(1, ceil(d / 30000.0)::BIGINT) AS n FROM du) SELECT lecture, segment, least((start_ms + end_ms) // 60000 + 1, n) AS section, 1.0::DOUBLE AS confidence FROM m_segments JOIN n USING (lecture)",
    "decision_merge": f"{_SD} SELECT lecture, segment, clean_text FROM m_decisions WHERE keep",
    "missing_decisions": f"{_S} SELECT lecture, segment FROM m_segments WHERE segment % 7 = 3",
    "decision_audit": f"{_SD} SELECT lecture, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed, coalesce(string_agg(segment || ': ' || reason, '; ' ORDER BY segment || ': ' || reason) FILTER (NOT keep), '') AS removed_list FROM m_decisions GROUP BY lecture",
    "raw_clean_audit": f"{_SD} SELECT lecture, segment, clean_text, text AS raw_text, start_ms, end_ms FROM m_decisions JOIN m_segments USING (lecture, segment) WHERE keep AND trim(clean_text) <> ''",
    "usable_transcripts": f"{_S} SELECT lecture, segment, CASE segment % 3 WHEN 0 THEN '' ELSE 'cleaned' END AS kind FROM m_segments WHERE segment % 3 < 2 AND lecture % 4 > 0 AND trim(text) <> ''",
    "word_retention": f"""{_SD}, k AS (SELECT lecture, segment, text, clean_text FROM m_segments JOIN m_decisions USING (lecture, segment) WHERE keep),
      a AS (SELECT lecture, w, count(*) AS a FROM (SELECT lecture, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS w FROM k) GROUP BY ALL), b AS (SELECT lecture, w, count(*) AS b FROM (SELECT lecture, unnest(regexp_extract_all(lower(clean_text), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS w FROM k) GROUP BY ALL),
      s AS (SELECT lecture, sum(a)::BIGINT AS words, sum(least(a, coalesce(b, 0)))::BIGINT AS retained FROM a LEFT JOIN b USING (lecture, w) GROUP BY lecture), z AS (SELECT lecture, sum(length(text))::BIGINT AS raw_chars, sum(length(clean_text))::BIGINT AS clean_chars FROM k GROUP BY lecture)
      SELECT *, retained >= 0.55 * words AND clean_chars / raw_chars BETWEEN 0.45 AND 1.65 AS passed FROM s JOIN z USING (lecture)""".replace("\\\\", "\\"),
    "cue_lookup": f"{_S}, {_CUES} SELECT * FROM c",
    "active_cue_changes": f"{_S}, {_CUES}, l AS (SELECT *, lag(segment) OVER (PARTITION BY lecture ORDER BY t_ms) AS b FROM c) SELECT lecture, t_ms, segment FROM l WHERE segment IS DISTINCT FROM b",
    "focus_cues": f"""{cte("m_questions", "m_segments")}, t AS (SELECT question_id, unnest(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 12)) AS term FROM (SELECT question_id, regexp_extract_all(lower(question), '[a-z0-9]{{3,}}') AS w FROM m_questions)),
      h AS (SELECT question_id, lecture, segment, count(*) AS hits FROM t JOIN m_segments ON contains(lower(text), term) GROUP BY ALL) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, lecture, segment) = 1""",
    "truncated_narration": f"{_S} SELECT lecture, count(*) AS segments, count(*) FILTER ((end_ms - start_ms) / 1000.0 < greatest(0.18, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_''][\\p{{L}}\\p{{M}}\\p{{N}}_'']*')) * 60 / 175 * 0.42)) AS short_segments FROM m_segments GROUP BY lecture",
}

ORACLES["transcript_text"] = f"""{_S}, pa AS ({ORACLES["paragraphs"]}), u AS (SELECT lecture, paragraph AS place, start_ms, end_ms, text FROM pa WHERE lecture % 3 <> 0 UNION ALL SELECT lecture, segment, start_ms, end_ms, text FROM m_segments WHERE lecture % 3 = 0)
      SELECT lecture, string_agg('[' || {_SEC('start_ms')} || '–' || {_SEC('end_ms')} || '] ' || trim({_WS}), chr(10) || chr(10) ORDER BY place) AS text FROM u WHERE trim({_WS}) <> '' GROUP BY lecture"""
