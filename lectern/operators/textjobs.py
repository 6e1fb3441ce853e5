"""Text jobs: column expressions that run over whole corpora, with reports of what they changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.durable import written
from lectern.functions.order import numbered_within
from lectern.functions.rules import clean_text, words_within
from lectern.operators import chunking
from lectern.operators.chunking import markdown_batches
from lectern.operators.models import transformed
from lectern.sources.model import cte, query

# Bounds, marks and patterns of notes, names and Markdown structure.
NOTE_WORDS = 90
PLACEHOLDER = "No concise source-grounded summary is available for this slide."
MARKER = "## Concise summary"
NUMBERED = r"(?i)\b(?:lecture|lec|week|class|session|chapter)\s*[-_ ]*0*(\d{1,3})\b"
GENERIC = r"(?i)\b(?:recording|audio|video|slides?|deck|presentation|powerpoint|final|copy)\b"
SLIDE_HEADING = r"(?i)^(?:Slide\s+|幻灯片\s*|幻燈片\s*|投影片\s*|第\s*)([0-9]+)(?:\s*[：:页頁張张]|\b)"
SIGNATURE = (("heading", r"^#{1,6}\s+"), ("bullet", r"^\s*[-*+]\s+"), ("numbered", r"^\s*\d+[.)]\s+"), ("fence", r"^\s*```"), ("quote", r"^\s*>"))


def normalised_texts(docs: DataFrame) -> DataFrame:
    """#99: cleaned text and a safe file name, and whether either changed."""
    base = F.regexp_extract("name", r"[^/]*$", 0)
    safe = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w.\-]+", "_"), "^[ .]+|[ .]+$", "")
    safe = F.when(safe == "", "upload").otherwise(safe)
    text = clean_text("text")
    return docs.select("document_id", F.md5(text).alias("text_md5"), safe.alias("safe_name"), ((text != F.col("text")) | (safe != F.col("name"))).alias("changed"))


def page_sections(pages: DataFrame) -> DataFrame:
    """#3: each paragraph block of a page is a section; blank ones are left out but counted."""
    blocks = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), 1)).alias("i", "block")
    text = clean_text(F.regexp_replace("block", r"<[^>]*>", ""))
    rows = pages.select("page_id", blocks).select("page_id", F.concat(F.lit("Page "), (F.col("i") + 1).cast("string")).alias("locator"), text.alias("text"))
    return rows.filter("text <> ''")


def slide_titles(slides: DataFrame) -> DataFrame:
    """#5: the title is the first line of 2 to 180 characters, else `Slide n`; blank slides take their recognised text."""
    content = F.when(clean_text("content") == "", F.coalesce("ocr", F.lit(""))).otherwise(F.col("content"))
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: clean_text(x)), lambda x: F.length(x).between(2, 180))
    return slides.select("lecture", "slide", F.coalesce(F.get(lines, 0), F.concat(F.lit("Slide "), F.col("slide").cast("string"))).alias("title"), F.length(content).alias("n_chars"))


def concise(note):
    """The body under the summary heading, else what stands before the first heading."""
    at = F.instr(note, MARKER)
    rest = F.regexp_replace(F.substring(note, at + len(MARKER), F.length(note)), "^[\n ]+", "")
    stop = F.instr(rest, "\n## ")
    body = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.when(at > 0, F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(clean_text(F.substring_index(note, "##", 1)))


def bounded_summary(note, most: int = NOTE_WORDS):
    """A note's summary of at most so many words; a placeholder where there is none."""
    text = clean_text(concise(note))
    return F.when(text == "", PLACEHOLDER).otherwise(words_within(text, most))


def bounded_notes(notes: DataFrame, most: int = NOTE_WORDS) -> DataFrame:
    """#100: summaries of at most 90 words; a placeholder where there is none."""
    text = clean_text(concise(F.col("note")))
    return notes.select("note_id", bounded_summary(F.col("note"), most).alias("summary"), (F.size(F.split(text, " ")) > most).alias("bounded"), (text == "").alias("placeholder"))


def upgraded_notes(notes: DataFrame) -> DataFrame:
    """#101: notes without a concise summary get one from their older sections."""

    def section(name: str):
        at = F.instr(F.col("note"), name)
        rest = F.substring("note", at + len(name), F.length("note"))
        return F.when(at > 0, clean_text(F.substring_index(rest, "\n## ", 1))).otherwise("")

    slide, teacher = section("## Slide content"), section("## Professor explanation")
    useful = F.when(F.lower(teacher).startswith("no additional professor"), "").otherwise(teacher)
    text = F.concat_ws(" ", F.when(slide != "", slide), F.when(useful != "", useful))
    new = F.concat(F.lit(MARKER + "\n"), F.when(text == "", PLACEHOLDER).otherwise(text), F.lit("\n\n"), F.regexp_replace("note", r"^\s+", ""))
    return notes.select("note_id", F.when(F.col("note").contains(MARKER), F.col("note")).otherwise(new).alias("note"))


def lecture_identities(lectures: DataFrame) -> DataFrame:
    """#103: number and topic from the first non-empty of title, deck and recording name; the running count is the default."""
    blank = lambda c: F.when(clean_text(c) != "", clean_text(c))
    source = F.coalesce(blank("title"), blank("deck"), blank("recording"), F.lit("Lecture"))
    rows = numbered_within(lectures.select("subject", "lecture", source.alias("source")), ["subject"], ["lecture"], "k", written).withColumn("k", F.col("k").cast("int"))
    number = F.greatest(F.lit(1), F.coalesce(F.regexp_extract("source", NUMBERED, 1).try_cast("int"), F.col("k")))
    topic = F.regexp_replace(F.regexp_replace("source", NUMBERED, " "), GENERIC, " ")
    topic = F.regexp_replace(F.regexp_replace(topic, r"(?:^|\s)[vV]?\d+(?:\.\d+)+(?:\s|$)", " "), r"\s*[-_–—]+\s*", " ")
    topic = F.regexp_replace(clean_text(topic), r"^[ .\-_–—()\[\]]+|[ .\-_–—()\[\]]+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.when(topic == "", "Untitled").otherwise(topic), r"(?U)[^\w.\-]+", "_"), "^[ ._-]+|[ ._-]+$", "")
    slug = F.when(slug == "", "Untitled").otherwise(slug)
    return rows.select("lecture", number.alias("number"), F.concat(F.lit("Lecture_"), F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")), F.lit("_"), slug).alias("base_name"))


def signature(text):
    """#104: the sequence of headings, list items, fences and quotes of a Markdown text."""

    def kind(line):
        depth = F.length(F.regexp_extract(line, "^(#{1,6})\\s", 1)).cast("string")
        out = F.lit("")
        for name, pattern in reversed(SIGNATURE):
            out = F.when(F.rlike(line, F.lit(pattern)), F.concat(F.lit("heading:"), depth) if name == "heading" else F.lit(name)).otherwise(out)
        return out

    return F.array_join(F.filter(F.transform(F.split(text, "\n"), kind), lambda k: k != ""), " ")


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """#104: `signature` of each document."""
    return docs.select("document_id", signature(F.col(text)).alias("signature"))


def signature_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """#104: documents whose structure a translation changed."""
    both = signatures(source).join(signatures(target).withColumnRenamed("signature", "translated"), "document_id", "full")
    return both.select("document_id", F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("translated", F.lit("")).alias("translated"), F.col("signature").eqNullSafe(F.col("translated")).alias("same"))


def translation_fault(source, target):
    """#112: a translation must keep the structure, 0.15 to 3 times the length, and not be empty."""
    ratio = F.length(F.trim(target)) / F.greatest(F.lit(1), F.length(source))
    return F.when(F.coalesce(F.trim(target), F.lit("")) == "", "empty").when(signature(source) != signature(target), "structure").when(~ratio.between(0.15, 3.0), "length")


def translation_guard(pairs: DataFrame) -> DataFrame:
    """#112: `translation_fault` of each pair of texts."""
    return pairs.select("document_id", translation_fault(F.col("source"), F.col("target")).alias("reason"))


def translated_documents(docs: DataFrame, model: Callable[[list[tuple[int, str]]], dict[int, str]], limit: int = 12_000) -> DataFrame:
    """#115: whole documents through a translation model, batch by batch, in order; the fault of the first batch that has one voids the document."""
    batches = markdown_batches(docs, limit)
    asked = batches.select(F.col("document_id").alias("lecture"), F.array(F.col("batch").cast("long")).alias("ids"), F.array("text").alias("texts"))
    got = transformed(asked, model).select(F.col("lecture").alias("document_id"), F.col("id").alias("batch"), F.col("text").alias("target"), "error")
    pairs = batches.join(got, ["document_id", "batch"]).withColumn("fault", F.when(F.col("error").isNotNull(), "model").otherwise(translation_fault(F.col("text"), F.col("target"))))
    parts = F.array_sort(F.collect_list(F.struct("batch", F.coalesce("target", F.lit("")).alias("target"))))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("batch", "fault")))["fault"]
    found = pairs.groupBy("document_id").agg(parts.alias("parts"), first.alias("fault"))
    whole = F.concat(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["target"]), "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
    reason = F.when(F.col("parts").isNull(), "nothing to translate").otherwise(F.col("fault"))
    return docs.select("document_id").join(found, "document_id", "left").select("document_id", F.when(reason.isNull(), whole).alias("text"), reason.alias("reason"))


def _swapped_vowels(items: list[tuple[int, str]]) -> dict[int, str]:
    """A stand-in model: fails on texts with 77 in them."""
    if any("77" in t for _, t in items):
        raise ValueError("marked")
    return {i: t.replace("a", "o") for i, t in items}


def translated_sections(docs: DataFrame) -> DataFrame:
    """#105: sections, with their headings, under numbered slide headings; a number that comes again after a section that is not empty voids the document."""
    parts = F.split(F.concat(F.lit("\n"), "text"), "\n(?=##[ \t])")
    rows = docs.select("document_id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("at", "part"))
    number = F.regexp_extract(F.regexp_replace("part", "^##[ \t]+", ""), SLIDE_HEADING, 1).try_cast("int")
    body = F.regexp_replace(F.substring("part", F.instr("part", "\n") + 1, F.length("part")), r"^\s+|\s+$", "")
    filled = (F.instr("part", "\n") > 0) & (body != "")
    found = rows.select("document_id", "at", number.alias("slide"), filled.alias("filled"), F.regexp_replace("part", r"\s+$", "").alias("section")).filter("slide IS NOT NULL")
    again = found.groupBy("document_id", "slide").agg(F.min(F.when(F.col("filled"), F.col("at"))).alias("first"), F.max("at").alias("last")).filter("last > first").select("document_id").distinct()
    return found.filter("filled").join(again, "document_id", "left_anti").select("document_id", "slide", "section")


def _note(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("document_id").alias("note_id"), F.expr(_NOTE).alias("note"))


_NOTE = """CASE document_id % 5 WHEN 0 THEN '## Slide content' || chr(10) || text || chr(10) || '## Professor explanation' || chr(10) || 'No additional professor words' WHEN 1 THEN 'Intro' || chr(10) || '## Concise summary' || chr(10) || text || chr(10) || '## Next' || chr(10) || 'x'
  WHEN 2 THEN '## Concise summary' || chr(10) WHEN 3 THEN '## Professor explanation' || chr(10) || text ELSE text END"""
_MD = "CASE document_id % 4 WHEN 0 THEN '# ' || replace(text, '. ', chr(10) || '- ') WHEN 1 THEN '1. ' || replace(text, ' the ', chr(10) || '> ') ELSE '## Slide ' || (document_id % 6) || chr(10) || text || chr(10) || '## 第' || (document_id % 8) || '页' || chr(10) || ' body ' || chr(10) || '## Slide 5' END"
_TITLE = "CASE document_id % 6 WHEN 0 THEN 'Week 03 - ' || substr(name, 1, 6) || ' final' WHEN 1 THEN 'Slides v1.2 (intro)' WHEN 2 THEN 'Lecture-12_graph theory' WHEN 3 THEN 'deck' WHEN 4 THEN 'Algebra  audio  basics' ELSE '' END"


def _md(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.expr(_MD).alias("text"))


def _changed(docs: DataFrame) -> DataFrame:
    return _md(docs).withColumn("text", F.when(F.col("document_id") % 3 == 0, F.replace("text", F.lit("- "), F.lit(""))).otherwise(F.col("text")))


_D = cte("m_docs")
_WS = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_SIG = r"""array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^#{{1,6}}\s+') THEN 'heading:' || length(regexp_extract(l, '^(#{{1,6}})\s', 1)) WHEN regexp_matches(l, '^\s*[-*+]\s+') THEN 'bullet'
  WHEN regexp_matches(l, '^\s*\d+[.)]\s+') THEN 'numbered' WHEN regexp_matches(l, '^\s*```') THEN 'fence' WHEN regexp_matches(l, '^\s*>') THEN 'quote' ELSE '' END), lambda k: k <> ''), ' ')"""
_NB = f"{_D}, n AS (SELECT document_id AS note_id, {_NOTE} AS note FROM m_docs)"
_MB = f"{_D}, md AS (SELECT document_id, {_MD} AS a, CASE WHEN document_id % 3 = 0 THEN replace({_MD}, '- ', '') ELSE {_MD} END AS b FROM m_docs)"

QUERIES = {
    "translated_documents": query(lambda d: translated_documents(d, _swapped_vowels, 700), "m_docs"),
    "text_normalisation": query(normalised_texts, "m_docs"),
    "page_sections": query(page_sections, "pages"),
    "slide_titles": query(lambda s: slide_titles(s.withColumn("ocr", F.col("title")).withColumn("content", F.when(F.col("slide") % 3 == 0, " ").otherwise(F.concat("content", F.lit("\nsecond"))))), "m_slides"),
    "bounded_notes": query(lambda d: bounded_notes(_note(d)), "m_docs"),
    "upgraded_notes": query(lambda d: upgraded_notes(_note(d)), "m_docs"),
    "lecture_identities": query(lambda d: lecture_identities(d.select("subject", F.col("document_id").alias("lecture"), F.expr(_TITLE).alias("title"), F.lit("").alias("deck"), F.when(F.col("document_id") % 12 == 5, "class 7 recording").alias("recording"))), "m_docs"),
    "markdown_signatures": query(lambda d: signature_diff(_md(d), _changed(d)), "m_docs"),
    "translation_guard": query(lambda d: translation_guard(d.select("document_id", F.expr(_MD).alias("source"), F.expr(f"CASE WHEN document_id % 7 = 0 THEN ' ' WHEN document_id % 5 = 0 THEN repeat({_MD} || ' ', 4) ELSE {_MD} END").alias("target"))), "m_docs"),
    "translated_sections": query(lambda d: translated_sections(_md(d)), "m_docs"),
}

ORACLES = {
    "translated_documents": f"""{cte("m_docs")}, b AS ({chunking.ORACLES["markdown_batches"]}), g AS (SELECT document_id, string_agg(replace(text, 'a', 'o'), chr(10) || chr(10) ORDER BY batch) AS text, bool_or(contains(text, '77')) AS bad FROM b GROUP BY document_id)
      SELECT document_id, CASE WHEN NOT bad THEN g.text || chr(10) END AS text, CASE WHEN bad IS NULL THEN 'nothing to translate' WHEN bad THEN 'model' END AS reason FROM m_docs LEFT JOIN g USING (document_id)""",
    "text_normalisation": f"{_D} SELECT document_id, md5({_WS.format('text')}) AS text_md5, name AS safe_name, {_WS.format('text')} <> text AS changed FROM m_docs",
    "page_sections": f"""WITH b AS (SELECT page_id, unnest(x) AS block, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS x FROM pages)), t AS (SELECT page_id, 'Page ' || i AS locator, {_WS.format("regexp_replace(block, '<[^>]*>', '', 'g')")} AS text FROM b) SELECT * FROM t WHERE text <> ''""",
    "slide_titles": f"""{cte("m_slides")}, c AS (SELECT lecture, slide, CASE WHEN slide % 3 = 0 THEN title ELSE content || chr(10) || 'second' END AS c FROM m_slides)
      SELECT lecture, slide, coalesce(list_filter(list_transform(string_split(c, chr(10)), lambda x: {_WS.format('x')}), lambda x: length(x) BETWEEN 2 AND 180)[1], 'Slide ' || slide) AS title, length(c) AS n_chars FROM c""",
    "bounded_notes": f"""{_NB}, c AS (SELECT note_id, {_WS.format("CASE WHEN contains(note, '## Concise summary') THEN split_part(ltrim(substr(note, instr(note, '## Concise summary') + 18), chr(10) || ' '), chr(10) || '## ', 1) ELSE split_part(note, '##', 1) END")} AS t FROM n)
      SELECT note_id, CASE WHEN t = '' THEN '{PLACEHOLDER}' WHEN len(string_split(t, ' ')) > 90 THEN rtrim(array_to_string(string_split(t, ' ')[1:90], ' '), ' ,;:') || '…' ELSE t END AS summary, len(string_split(t, ' ')) > 90 AS bounded, t = '' AS placeholder FROM c""",
    "upgraded_notes": f"""{_NB}, s AS (SELECT note_id, note, CASE WHEN contains(note, '## Slide content') THEN {_WS.format("split_part(split_part(note, '## Slide content', 2), chr(10) || '## ', 1)")} ELSE '' END AS a, CASE WHEN contains(note, '## Professor explanation') THEN {_WS.format("split_part(split_part(note, '## Professor explanation', 2), chr(10) || '## ', 1)")} ELSE '' END AS p FROM n),
      u AS (SELECT *, concat_ws(' ', nullif(a, ''), CASE WHEN NOT starts_with(lower(p), 'no additional professor') THEN nullif(p, '') END) AS t FROM s) SELECT note_id, CASE WHEN contains(note, '## Concise summary') THEN note ELSE '## Concise summary' || chr(10) || CASE WHEN t = '' THEN '{PLACEHOLDER}' ELSE t END || chr(10) || chr(10) || regexp_replace(note, '^\\s+', '') END AS note FROM u""",
    "lecture_identities": f"""{_D}, l AS (SELECT document_id AS lecture, row_number() OVER (PARTITION BY subject ORDER BY document_id) AS k, coalesce(nullif({_WS.format(_TITLE)}, ''), CASE WHEN document_id % 12 = 5 THEN 'class 7 recording' END, 'Lecture') AS source FROM m_docs),
      n AS (SELECT lecture, greatest(1, coalesce(try_cast(regexp_extract(source, '{NUMBERED}', 1) AS INT), k)) AS number, regexp_replace({_WS.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '" + NUMBERED + "', ' ', 'g'), '" + GENERIC + "', ' ', 'g'), '(?:^|\\s)[vV]?\\d+(?:\\.\\d+)+(?:\\s|$)', ' ', 'g'), '\\s*[-_–—]+\\s*', ' ', 'g')")}, '^[ .\\-_–—()\\[\\]]+|[ .\\-_–—()\\[\\]]+$', '', 'g') AS topic FROM l)
      SELECT lecture, number, 'Lecture_' || lpad(number::VARCHAR, greatest(2, length(number::VARCHAR))::INT, '0') || '_' || coalesce(nullif(regexp_replace(regexp_replace(coalesce(nullif(topic, ''), 'Untitled'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_.\\-]+', '_', 'g'), '^[ ._-]+|[ ._-]+$', '', 'g'), ''), 'Untitled') AS base_name FROM n""",
    "markdown_signatures": f"{_MB} SELECT document_id, {_SIG.format('a')} AS signature, {_SIG.format('b')} AS translated, {_SIG.format('a')} = {_SIG.format('b')} AS same FROM md",
    "translation_guard": f"""{_D}, md AS (SELECT document_id, {_MD} AS a, CASE WHEN document_id % 7 = 0 THEN ' ' WHEN document_id % 5 = 0 THEN repeat({_MD} || ' ', 4) ELSE {_MD} END AS b FROM m_docs)
      SELECT document_id, CASE WHEN trim(b) = '' THEN 'empty' WHEN {_SIG.format('a')} <> {_SIG.format('b')} THEN 'structure' WHEN NOT length(trim(b)) / greatest(1, length(a)) BETWEEN 0.15 AND 3.0 THEN 'length' END AS reason FROM md""",
    "translated_sections": f"""{_MB}, r AS (SELECT document_id, string_split(regexp_replace(chr(10) || a, '\\n(##[ \\t])', chr(1) || '\\1', 'g'), chr(1))[2:] AS parts FROM md),
      p AS (SELECT document_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM r),
      f AS (SELECT document_id, place, try_cast(regexp_extract(regexp_replace(part, '^##[ \\t]+', ''), '{SLIDE_HEADING}', 1) AS INT) AS slide, contains(part, chr(10)) AND regexp_replace(substr(part, instr(part, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') <> '' AS filled, regexp_replace(part, '\\s+$', '') AS section FROM p),
      g AS (SELECT *, min(CASE WHEN filled THEN place END) OVER w AS first, max(place) OVER w AS last FROM f WHERE slide IS NOT NULL WINDOW w AS (PARTITION BY document_id, slide))
      SELECT document_id, slide, section FROM g WHERE filled AND document_id NOT IN (SELECT document_id FROM g WHERE last > first)""",
}
