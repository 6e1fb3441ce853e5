"""Alignment of paragraphs with slides, and the quality of the evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import clean_text, clock, cosine
from lectern.sources.model import cte, query

# Costs of the alignment, the least semantic confidence, and the pattern of spoken references.
TIME_COST, JUMP_COST, SEMANTIC = 0.14, 0.025, 0.20
WARN_RATIO, FAIL_RATIO = 0.35, 0.70
REFERENCE = r"(?i)\b(?:slide|page|figure)\s*(?:number\s*)?(\d{1,3})\b"


def spoken_references(paragraphs: DataFrame, deck: DataFrame) -> DataFrame:
    """#102: the first slide number that a paragraph names, if the lecture's deck has it."""
    number = F.expr(f"try_cast(regexp_extract(text, r'{REFERENCE}', 1) AS INT)")
    named = paragraphs.select("lecture", "paragraph", number.alias("slide")).filter("slide IS NOT NULL")
    return named.join(deck.select("lecture", F.col("slide").cast("int").alias("slide")).distinct(), ["lecture", "slide"], "left_semi").select("lecture", "paragraph", "slide")


def similarities(paragraphs: DataFrame, deck: DataFrame) -> DataFrame:
    """#76: cosine of every paragraph with every slide of its own lecture."""
    d = deck.select("lecture", "slide", F.col("vector").alias("slide_vector"))
    return paragraphs.join(d, "lecture").select("lecture", "paragraph", "slide", cosine(F.col("vector"), F.col("slide_vector")).alias("cosine"))


def _path(found: pd.DataFrame) -> pd.DataFrame:
    """One lecture: rows (paragraph, t, reference, emissions over slides in order)."""
    found = found.sort_values("paragraph")
    e = np.stack(found["emissions"].to_numpy())
    n = e.shape[1]
    prior, back = np.zeros(n), np.zeros(e.shape, dtype=int)
    climb = JUMP_COST * np.arange(n)
    for i, pin in enumerate(found["pin"]):
        if pin >= 0:
            now = np.full(n, -np.inf)
            back[i] = int(prior.argmax())
            now[pin] = prior.max() + e[i, pin]
        else:
            value = prior + climb
            best = np.maximum.accumulate(value)
            # The earliest predecessor that reaches the running maximum.
            back[i] = np.maximum.accumulate(np.where(np.append(True, value[1:] > best[:-1]), np.arange(n), 0))
            now = best - climb + e[i]
        prior = now
    place, out = int(prior.argmax()), []
    for i in reversed(range(len(e))):
        out.append(place)
        place = back[i, place]
    return pd.DataFrame({"lecture": found["lecture"], "paragraph": found["paragraph"], "place": out[::-1]})


def aligned(paragraphs: DataFrame, deck: DataFrame) -> DataFrame:
    """#50, #51: slide, method and confidence of each paragraph along the best path through its deck.

    The path needs all paragraphs of a lecture in order; lectures are computed in parallel.
    """
    refs = spoken_references(paragraphs, deck).withColumnRenamed("slide", "named")
    slides = deck.withColumn("place", F.row_number().over(Window.partitionBy("lecture").orderBy("slide")) - 1)
    n, last = F.count("*").over(Window.partitionBy("lecture", "paragraph")), F.max("end_s").over(Window.partitionBy("lecture"))
    duration = paragraphs.select("lecture", "paragraph", "start_s", "end_s", last.alias("duration"))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("start_s") + F.col("end_s")) / 2 / F.greatest(F.col("duration"), F.lit(1e-9))))
    scored = similarities(paragraphs, deck).join(slides.select("lecture", "slide", "place"), ["lecture", "slide"]).join(duration, ["lecture", "paragraph"])
    cost = TIME_COST * F.abs(F.col("place") / F.greatest(F.lit(1), n - 1) - t)
    emission = scored.withColumn("emission", F.col("cosine") - cost).join(refs, ["lecture", "paragraph"], "left")
    rows = emission.groupBy("lecture", "paragraph").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "emission"))), lambda x: x["emission"]).alias("emissions"),
        F.coalesce(F.max(F.when(F.col("slide") == F.col("named"), F.col("place"))), F.lit(-1)).alias("pin"),
    )
    path = rows.groupBy("lecture").applyInPandas(_path, "lecture long, paragraph long, place int")
    found = path.join(emission, ["lecture", "paragraph", "place"])
    method = F.when(F.col("named").isNotNull(), "spoken_reference").when(F.col("cosine") >= SEMANTIC, "semantic").otherwise("temporal_fallback")
    confidence = F.when(F.col("named").isNotNull(), 1.0).otherwise(F.bround(F.greatest(F.col("cosine"), F.lit(0.0)), 4))
    return found.select("lecture", "paragraph", F.col("slide").cast("int").alias("slide"), method.alias("method"), confidence.alias("confidence"))


def slide_rollup(alignment: DataFrame, deck: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """#52: every slide with its paragraphs in order, its first time and the counts of methods."""
    rows = alignment.join(paragraphs.select("lecture", "paragraph", "start_s"), ["lecture", "paragraph"])
    per = rows.groupBy("lecture", "slide").agg(
        F.array_sort(F.collect_list("paragraph")).alias("paragraph_ids"), F.min_by("start_s", "paragraph").alias("slide_time"), F.count_if(F.col("method") == "semantic").alias("semantic")
    )
    out = deck.select("lecture", F.col("slide").cast("int").alias("slide")).join(per, ["lecture", "slide"], "left")
    return out.select("lecture", "slide", F.coalesce(F.array_join("paragraph_ids", ","), F.lit("")).alias("paragraph_ids"), clock(F.coalesce("slide_time", F.lit(0.0))).alias("slide_time"), F.coalesce("semantic", F.lit(0)).alias("semantic"))


def backtracks(alignment: DataFrame) -> DataFrame:
    """#68: paragraphs that go back to an earlier slide without a spoken reference."""
    before = F.lag("slide").over(Window.partitionBy("lecture").orderBy("paragraph"))
    return alignment.withColumn("before", before).filter("slide < before AND method <> 'spoken_reference'").select("lecture", "paragraph", "before", "slide")


def source_coverage(slides: DataFrame, aligned_texts: DataFrame) -> DataFrame:
    """#62: whether a slide has evidence of its own, text recognised in its images (`visual_text`, where there is such a column) included, and whether speech is aligned with it."""
    title = clean_text("title")
    number = F.col("slide").cast("string")
    meaningful = (title != "") & (F.lower(title) != F.concat(F.lit("slide "), number)) & (title != number)
    seen = F.coalesce(F.size("visual_text") > 0, F.lit(False)) if "visual_text" in slides.columns else F.lit(False)
    own = meaningful | (clean_text("content") != "") | (clean_text("notes") != "") | seen
    speech = aligned_texts.groupBy("lecture", "slide").agg(F.bool_or(clean_text("text") != "").alias("speech"))
    return slides.join(speech, ["lecture", "slide"], "left").select("lecture", "slide", own.alias("slide_evidence"), F.coalesce("speech", F.lit(False)).alias("teacher_audio"))


def evidence_quality(alignment: DataFrame, slides: DataFrame) -> DataFrame:
    """#61: one row per lecture: ratios, backtracks, mapped and empty slides, status."""
    jumps = backtracks(alignment).groupBy("lecture").agg(F.count("*").alias("backtracks"))
    mapped = alignment.select("lecture", "slide").distinct()
    none = (clean_text("content") == "") & (clean_text("notes") == "")
    empty = slides.filter(none).join(mapped, ["lecture", "slide"], "left_anti").groupBy("lecture").agg(F.count("*").alias("empty_slides"))
    n = alignment.groupBy("lecture").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("method") == "temporal_fallback").alias("fallbacks"), F.count_distinct("slide").alias("mapped_slides"))
    out = slides.groupBy("lecture").agg(F.count("*").alias("slides")).join(n, "lecture", "left").join(jumps, "lecture", "left").join(empty, "lecture", "left").fillna(0)
    ratio = F.when(F.col("paragraphs") > 0, F.col("fallbacks") / F.col("paragraphs")).otherwise(0.0)
    failed, warned = (F.col("backtracks") > 0) | (ratio > FAIL_RATIO), (ratio > WARN_RATIO) | (F.col("empty_slides") > 0) | ((F.col("paragraphs") == 0) & (F.col("slides") > 0))
    status = F.when(failed, "failed").when(warned, "warning").otherwise("passed")
    return out.select("lecture", "slides", "paragraphs", "fallbacks", F.bround(ratio, 4).alias("fallback_ratio"), "backtracks", "mapped_slides", "empty_slides", status.alias("status"))


def coverage_diff(slides: DataFrame, notes: DataFrame) -> DataFrame:
    """#77: slides without a note, notes without a slide, and slides with several notes."""
    s = slides.select("lecture", "slide").distinct()
    n = notes.groupBy("lecture", "slide").agg(F.count("*").alias("n"))
    both = s.withColumn("known", F.lit(True)).join(n, ["lecture", "slide"], "full")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select("lecture", "slide", kind.alias("kind")).filter("kind IS NOT NULL")


def _anchored(slides: DataFrame) -> DataFrame:
    """A stand-in alignment over the slide tables: a few paragraphs per slide."""
    p = slides.filter("slide % 4 <> 3").select("lecture", F.explode(F.sequence(F.col("slide") * 3, F.col("slide") * 3 + 2)).alias("paragraph"), "slide")
    slide = F.when(F.col("paragraph") % 17 == 5, F.greatest(F.lit(1), F.col("slide") - 2)).otherwise(F.col("slide"))
    method = F.expr("CASE WHEN paragraph % 3 < lecture % 4 THEN 'temporal_fallback' WHEN lecture % 2 = 0 AND paragraph % 17 = 5 THEN 'spoken_reference' ELSE 'semantic' END")
    return p.select("lecture", "paragraph", slide.alias("slide"), method.alias("method"), F.when(F.col("paragraph") % 5 == 0, " ").otherwise("said").alias("text"))


def _notes(slides: DataFrame) -> DataFrame:
    return slides.filter("slide % 5 <> 2").select("lecture", F.when(F.col("slide") % 7 == 3, F.col("slide") + 1).otherwise(F.when(F.col("slide") % 11 == 0, 900).otherwise(F.col("slide"))).alias("slide"))


_V = cte("m_vectors", "m_deck")
_L = cte("m_slides")
_REF = r"""rf AS (SELECT lecture, paragraph, slide FROM (SELECT lecture, paragraph, try_cast(regexp_extract(text, '(?i)\b(?:slide|page|figure)\s*(?:number\s*)?(\d{1,3})\b', 1) AS INT) AS slide FROM m_vectors) WHERE (lecture, slide) IN (SELECT (lecture, slide::INT) FROM m_deck))"""
_EM = f"""{_REF}, sl AS (SELECT lecture, slide, vector, row_number() OVER (PARTITION BY lecture ORDER BY slide) - 1 AS i, count(*) OVER (PARTITION BY lecture) AS n FROM m_deck),
  em AS (SELECT v.lecture, v.paragraph, s.slide, s.i, list_cosine_similarity(v.vector::DOUBLE[], s.vector::DOUBLE[]) AS cos, list_cosine_similarity(v.vector::DOUBLE[], s.vector::DOUBLE[]) - 0.14 * abs(s.i / greatest(1, n - 1) - least(1.0, (start_s + end_s) / 2 / max(end_s) OVER (PARTITION BY v.lecture))) AS e, r.slide AS named, row_number() OVER (PARTITION BY v.lecture, s.i ORDER BY v.paragraph) AS k
    FROM m_vectors v JOIN sl s USING (lecture) LEFT JOIN rf r ON r.lecture = v.lecture AND r.paragraph = v.paragraph),
  dp AS (SELECT lecture, 1 AS k, i, CASE WHEN named IS NULL OR named = slide THEN e ELSE '-infinity'::DOUBLE END AS val, 0 AS b FROM em WHERE k = 1 UNION ALL
    SELECT x.lecture, x.k, x.i, CASE WHEN x.named IS NULL THEN x.run - 0.025 * x.i + x.e WHEN x.named = x.slide THEN x.top + x.e ELSE '-infinity'::DOUBLE END, CASE WHEN x.named IS NULL THEN x.arg ELSE x.argtop END
    FROM (SELECT em.lecture, em.k::INT AS k, em.i::BIGINT AS i, em.e, em.named, em.slide, max(dp.val + 0.025 * dp.i) OVER u AS run, arg_max(dp.i, dp.val + 0.025 * dp.i) OVER u AS arg, max(dp.val) OVER f AS top, arg_max(dp.i, dp.val) OVER f AS argtop
      FROM dp JOIN em ON em.lecture = dp.lecture AND em.i = dp.i AND em.k = dp.k + 1 WINDOW u AS (PARTITION BY em.lecture, em.k ORDER BY dp.i), f AS (PARTITION BY em.lecture, em.k ORDER BY dp.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) x),
  ls AS (SELECT lecture, max(k) AS k FROM dp GROUP BY lecture),
  wk AS (SELECT lecture, k, arg_max(i, val ORDER BY i) AS i FROM dp JOIN ls USING (lecture, k) GROUP BY lecture, k UNION ALL SELECT wk.lecture, wk.k - 1, dp.b FROM wk JOIN dp ON dp.lecture = wk.lecture AND dp.k = wk.k AND dp.i = wk.i WHERE wk.k > 1),
  al AS (SELECT em.lecture, em.paragraph, em.slide::INT AS slide, CASE WHEN named IS NOT NULL THEN 'spoken_reference' WHEN cos >= 0.2 THEN 'semantic' ELSE 'temporal_fallback' END AS method, CASE WHEN named IS NOT NULL THEN 1.0 ELSE round_even(greatest(cos, 0.0), 4) END::DOUBLE AS confidence FROM wk JOIN em ON em.lecture = wk.lecture AND em.k = wk.k AND em.i = wk.i)"""
_AN = """an AS (SELECT lecture, p AS paragraph, CASE WHEN p % 17 = 5 THEN greatest(1, slide - 2) ELSE slide END AS slide, CASE WHEN p % 3 < lecture % 4 THEN 'temporal_fallback' WHEN lecture % 2 = 0 AND p % 17 = 5 THEN 'spoken_reference' ELSE 'semantic' END AS method, CASE WHEN p % 5 = 0 THEN ' ' ELSE 'said' END AS text
  FROM (SELECT lecture, slide, unnest(range(slide * 3, slide * 3 + 3)) AS p FROM m_slides WHERE slide % 4 <> 3)),
  bt AS (SELECT * FROM (SELECT *, lag(slide) OVER (PARTITION BY lecture ORDER BY paragraph) AS before FROM an) WHERE slide < before AND method <> 'spoken_reference')"""

def _seen(slides: DataFrame) -> DataFrame:
    """Slides without notes, some of which have nothing but text in their images, and some nothing at all."""
    bare = F.col("slide") % 4 == 1
    recognised = F.when(F.col("slide") % 12 == 5, F.array(F.lit("x = 1"))).when(F.col("slide") % 12 == 9, F.array().cast("array<string>"))
    return slides.withColumns({"notes": F.lit(""), "content": F.when(bare, "").otherwise(F.col("content")), "title": F.when(bare, F.concat(F.lit("SLIDE "), F.col("slide").cast("string"))).otherwise(F.col("title")), "visual_text": recognised})


QUERIES = {
    "spoken_references": query(spoken_references, "m_vectors", "m_deck"),
    "vector_cosine": query(lambda v, d: similarities(v, d).select("lecture", "paragraph", "slide", F.round("cosine", 4).alias("cosine")), "m_vectors", "m_deck"),
    "alignment": query(aligned, "m_vectors", "m_deck"),
    "slide_rollup": query(lambda v, d: slide_rollup(aligned(v, d), d, v), "m_vectors", "m_deck"),
    "backtracks": query(lambda s: backtracks(_anchored(s)), "m_slides"),
    "source_coverage": query(lambda s: source_coverage(_seen(s), _anchored(s)), "m_slides"),
    "evidence_quality": query(lambda s: evidence_quality(_anchored(s), s.withColumn("content", F.when(F.col("slide") % 3 == 0, "").otherwise(F.col("content"))).withColumn("notes", F.lit(""))), "m_slides"),
    "coverage_diff": query(lambda s: coverage_diff(s, _notes(s)), "m_slides"),
}

ORACLES = {
    "spoken_references": f"{_V}, {_REF} SELECT * FROM rf",
    "vector_cosine": f"{_V} SELECT lecture, paragraph, slide, round(list_cosine_similarity(v.vector::DOUBLE[], d.vector::DOUBLE[]), 4) AS cosine FROM m_vectors v JOIN m_deck d USING (lecture)",
    "alignment": f"{_V}, {_EM} SELECT * FROM al",
    "slide_rollup": f"""{_V}, {_EM} SELECT d.lecture, d.slide::INT AS slide, coalesce(string_agg(a.paragraph, ',' ORDER BY a.paragraph), '') AS paragraph_ids,
      lpad((coalesce(arg_min(start_s, a.paragraph), 0)::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((coalesce(arg_min(start_s, a.paragraph), 0)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((coalesce(arg_min(start_s, a.paragraph), 0)::BIGINT % 60)::VARCHAR, 2, '0') AS slide_time, count(*) FILTER (method = 'semantic') AS semantic
      FROM m_deck d LEFT JOIN al a ON a.lecture = d.lecture AND a.slide = d.slide LEFT JOIN m_vectors v ON v.lecture = a.lecture AND v.paragraph = a.paragraph GROUP BY d.lecture, d.slide""",
    "backtracks": f"{_L}, {_AN} SELECT lecture, paragraph, before, slide FROM bt",
    "source_coverage": f"{_L}, {_AN} SELECT s.lecture, s.slide, (s.slide % 4 <> 1 AND trim(title) <> '' AND lower(trim(title)) NOT IN ('slide ' || s.slide, s.slide::VARCHAR)) OR (s.slide % 4 <> 1 AND trim(content) <> '') OR s.slide % 12 = 5 AS slide_evidence, coalesce((SELECT bool_or(trim(text) <> '') FROM an WHERE an.lecture = s.lecture AND an.slide = s.slide), false) AS teacher_audio FROM m_slides s",
    "evidence_quality": f"""{_L}, {_AN}, n AS (SELECT lecture, count(*) AS paragraphs, count(*) FILTER (method = 'temporal_fallback') AS fallbacks, count(DISTINCT slide) AS mapped_slides FROM an GROUP BY lecture),
      z AS (SELECT s.lecture, count(*) AS slides, count(*) FILTER ((slide % 3 = 0 OR trim(content) = '') AND NOT EXISTS (FROM an WHERE an.lecture = s.lecture AND an.slide = s.slide)) AS empty_slides FROM m_slides s GROUP BY s.lecture),
      r AS (SELECT lecture, slides, coalesce(paragraphs, 0) AS paragraphs, coalesce(fallbacks, 0) AS fallbacks, CASE WHEN paragraphs > 0 THEN fallbacks / paragraphs ELSE 0.0 END AS ratio, (SELECT count(*) FROM bt WHERE bt.lecture = z.lecture) AS backtracks, coalesce(mapped_slides, 0) AS mapped_slides, empty_slides FROM z LEFT JOIN n USING (lecture))
      SELECT lecture, slides, paragraphs, fallbacks, round_even(ratio, 4)::DOUBLE AS fallback_ratio, backtracks, mapped_slides, empty_slides, CASE WHEN backtracks > 0 OR ratio > 0.7 THEN 'failed' WHEN ratio > 0.35 OR empty_slides > 0 OR paragraphs = 0 THEN 'warning' ELSE 'passed' END AS status FROM r""",
    "coverage_diff": f"""{_L}, n AS (SELECT lecture, CASE WHEN slide % 7 = 3 THEN slide + 1 WHEN slide % 11 = 0 THEN 900 ELSE slide END AS slide, count(*) AS n FROM m_slides WHERE slide % 5 <> 2 GROUP BY ALL)
      SELECT lecture, slide, CASE WHEN n IS NULL THEN 'missing' WHEN known IS NULL THEN 'unexpected' ELSE 'duplicate' END AS kind FROM (SELECT lecture, slide, true AS known FROM m_slides) s FULL JOIN n USING (lecture, slide) WHERE n IS NULL OR known IS NULL OR n > 1""",
}
