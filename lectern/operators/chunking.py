"""Chunkers and packers: order-dependent folds over one text or one lecture.

A fold works on offsets and sizes; text is cut or joined once at the end, so the
state of a fold stays small however long the text is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import clean_text
from lectern.sources.model import cte, query

LIBRARY, RETRIEVAL = (1200, 160), (900, 140)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, which a fold's plain expressions don't do."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunk_bounds(text: Column, size: int, overlap: int) -> Column:
    """#40: offsets (from 0) of overlapping chunks of a cleaned text: array of (start, stop)."""
    n = F.length(text)
    steps = F.sequence(F.lit(1), F.floor(n / max(1, size // 2 - overlap)).cast("int") + 2)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc, _):
        at = acc["at"]

        def stop_of(piece):
            return _let(
                at + F.lit(size) - F.instr(F.reverse(piece), " "),
                lambda space: F.when((at + size < n) & (space < at + size) & (space > at + size // 2), space).otherwise(F.least(at + size, n)),
            )

        def move(stop):
            out = F.array_append(acc["out"], F.struct(at.alias("start"), stop.alias("stop")))
            nearest = _let(F.greatest(stop - overlap, at + 1), lambda m: F.when(F.substring(text, m + 1, F.lit(1)) == " ", m + 1).otherwise(m))
            return F.struct(F.when(stop >= n, -1).otherwise(nearest).cast("int").alias("at"), out.alias("out"))

        return F.when(at < 0, acc).otherwise(_let(_let(F.substring(text, at + 1, F.lit(size)), stop_of), move))

    many = F.aggregate(steps, zero, step, lambda a: a["out"])
    one = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop")))
    return F.when(n == 0, F.array().cast("array<struct<start:int,stop:int>>")).when(n <= size, one).otherwise(many)


def chunked(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Rows with `text` to rows with `piece` (from 1), `pieces` and `content`; texts without content give none."""
    keep = [c for c in rows.columns if c != "text"]

    def pieces(text: Column) -> Column:
        def cut(bounds: Column) -> Column:
            content = lambda x: F.trim(F.substring(text, x["start"] + 1, x["stop"] - x["start"]))
            return F.transform(bounds, lambda x, i: F.struct((i + 1).alias("piece"), F.size(bounds).alias("pieces"), content(x).alias("content")))

        return _let(chunk_bounds(text, size, overlap), cut)

    # Cleaned text and bounds are bound once; as columns of their own they would be inlined wherever they are used.
    return rows.select(*keep, F.explode(_let(clean_text("text"), pieces)).alias("x")).select(*keep, "x.piece", "x.pieces", "x.content")


def library_chunks(sections: DataFrame) -> DataFrame:
    """#41: (document_id, section, locator, text) to numbered chunks; ` · part i` only where a section has several."""
    out = chunked(sections, *LIBRARY)
    locator = F.concat("locator", F.when(F.col("pieces") > 1, F.concat(F.lit(" · part "), F.col("piece").cast("string"))).otherwise(""))
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("section", "piece"))
    return out.select("document_id", ordinal.alias("ordinal"), locator.alias("locator"), "content")


def text_sections(docs: DataFrame) -> DataFrame:
    """One section `Text` for each document."""
    return docs.select("document_id", F.lit(1).alias("section"), F.lit("Text").alias("locator"), "text")


def index_documents(docs: DataFrame) -> DataFrame:
    """#4: status of each document after indexing: `indexed` with its chunks, else `stored`; what fails says why."""
    chunks = library_chunks(text_sections(docs)).groupBy("document_id").agg(F.count("*").alias("n"))
    failed = F.col("text").isNull()
    status = F.when(failed, "extraction_failed").when(F.col("n") > 0, "indexed").otherwise("stored")
    out = docs.join(chunks, "document_id", "left")
    return out.select("document_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"), F.when(failed, "no text").alias("error"))


def source_documents(slides: DataFrame, paragraphs: DataFrame, alignment: DataFrame) -> DataFrame:
    """#42: tagged retrieval chunks of slides and transcript paragraphs with their times; how a paragraph was aligned, where it was.

    `visual_text` of a slide is an array of what was recognised in its images, or null.
    """
    part = lambda label, c: F.when(clean_text(c) != "", F.concat(F.lit(label), c))
    head = F.concat(F.lit("Slide "), F.col("slide").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")))
    text = F.concat_ws("\n", head, part("", F.col("content")), part("Speaker notes: ", F.col("notes")), part("Text detected in diagrams/images: ", F.array_join("visual_text", " ")))
    a = chunked(slides.select("lecture", "slide", text.alias("text")), *RETRIEVAL)
    a = a.select("lecture", F.concat(F.lit("slide-"), F.col("slide"), F.lit("-chunk-"), F.col("piece")).alias("id"), F.lit("slide").alias("source"), F.col("slide").cast("long").alias("slide_number"), "piece", "content")
    mapped = alignment.select("lecture", "paragraph", F.col("slide").cast("long").alias("aligned_slide"), F.col("method").alias("alignment_method"), F.col("confidence").cast("double").alias("alignment_confidence"))
    spoken = paragraphs.select("lecture", "paragraph", F.coalesce("start_s", F.lit(0.0)).alias("start_s"), F.coalesce("end_s", F.lit(0.0)).alias("end_s")).join(mapped, ["lecture", "paragraph"], "left")
    b = chunked(paragraphs.select("lecture", "paragraph", "text"), *RETRIEVAL).join(spoken, ["lecture", "paragraph"])
    name = F.concat(F.lit("transcript-"), F.col("paragraph"), F.lit("-chunk-"), F.col("piece"))
    b = b.select("lecture", name.alias("id"), F.lit("transcript").alias("source"), F.col("paragraph").cast("long").alias("paragraph"), "start_s", "end_s", "aligned_slide", "alignment_method", "alignment_confidence", "piece", "content")
    return a.unionByName(b, allowMissingColumns=True)


def batch_numbers(rows: DataFrame, key: str, order: str, cost: Column, limit: Column | int, between: int = 0) -> DataFrame:
    """#45, #46: greedy batches in order; an item that exceeds the limit alone is a batch of its own."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cost.cast("long").alias("c")))).alias("rows"))
    zero = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:long,no:int>>").alias("out"))
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def step(acc, x):
        new = (acc["no"] == 0) | (acc["used"] + between + x["c"] > limit)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        used = F.when(new, x["c"]).otherwise(acc["used"] + between + x["c"])
        return F.struct(no.alias("no"), used.alias("used"), F.array_append(acc["out"], F.struct(x["o"].cast("long").alias("o"), no.alias("no"))).alias("out"))

    out = lists.select(key, F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("x"))
    return out.select(key, F.col("x.o").alias(order), F.col("x.no").alias("batch"))


def cleanup_batches(segments: DataFrame, configured: int, context_tokens: int) -> DataFrame:
    """#45: batches for cleanup: each text costs 120 characters more than its length."""
    limit = min(configured, max(2000, int(context_tokens * 1.2)))
    return batch_numbers(segments, "lecture", "segment", F.length("text") + 120, limit)


def block_batches(blocks: DataFrame, limit: int) -> DataFrame:
    """#46: blocks joined by blank lines whose separators do not count; blocks beyond the limit are errors."""
    fits = blocks.filter(F.length("text") <= limit)
    bad = blocks.filter(F.length("text") > limit).select("lecture", "segment", F.lit(-1).alias("batch"))
    return batch_numbers(fits, "lecture", "segment", F.length("text"), limit).unionByName(bad)


#: White space that pieces lose at their ends.
_ENDS = " \t\n\x0b\f\r"


def _pieces(text: str, limit: int, sentences: bool) -> list[str]:
    out, n = [], len(text)
    at, stop = 0, n
    while at < stop:
        if stop - at <= limit:
            out.append(text[at:stop])
            break
        space = max(text.rfind(" ", at, at + limit) - at, -1)
        first = max(max(text.rfind(m, at, at + limit) - at, -1) for m in (".!?。！？" if sentences else "\n")) + sentences
        cut = space if first < limit // 2 else first
        if cut <= 0 if sentences else cut < limit // 2:
            cut = limit
        out.append(text[at : at + cut].strip(_ENDS))
        # What is left loses its white space at both ends.
        at += cut
        while at < n and text[at] in _ENDS:
            at += 1
        if stop == n:
            stop = len(text.rstrip(_ENDS))
    return out


def cut_points(text: Column, limit: int, sentences: bool) -> Column:
    """#47, #48: pieces of at most `limit` characters, each trimmed.

    A cut falls after a sentence mark (or at a line break), else at a space where that
    comes before half of the limit, else after exactly `limit` characters. Each cut looks at
    `limit` characters of the text, which itself is not copied, so a text takes time by its length.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _pieces(t, limit, sentences) for t in texts], dtype=object)

    return cut(text)


def markdown_batches(docs: DataFrame, limit: int) -> DataFrame:
    """#47: blank-line blocks, cut where too long, packed in order; a separator counts two characters."""
    blocks = docs.select("document_id", F.posexplode(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\n\s*\n")).alias("i", "block"))
    trimmed = blocks.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).filter("block <> ''")
    pieces = trimmed.select("document_id", "i", F.posexplode(cut_points(F.col("block"), limit, sentences=False)).alias("j", "piece"))
    pieces = pieces.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("i", "j")).cast("long"))
    numbers = batch_numbers(pieces, "document_id", "n", F.length("piece"), limit, between=2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n\n")
    return pieces.join(numbers, ["document_id", "n"]).groupBy("document_id", "batch").agg(text.alias("text"))


def narration_chunks(docs: DataFrame, limit: int = 320) -> DataFrame:
    """#48: pieces for narration, cut at sentence ends."""
    return docs.select("document_id", F.posexplode(cut_points(F.col("text"), limit, sentences=True)).alias("piece", "text"))


def _slides(slides: DataFrame, segments: DataFrame) -> DataFrame:
    seen = slides.withColumn("visual_text", F.when(F.col("notes") == "", F.array("title", F.lit("axis"))))
    paragraphs = segments.select((F.col("lecture") % 20).alias("lecture"), (F.col("lecture") * 100 + F.col("segment")).alias("paragraph"), "text", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "role")
    mapped = paragraphs.filter("role <> 'user'").select("lecture", "paragraph", (F.col("paragraph") % 5 + 1).alias("slide"), F.lit("semantic").alias("method"), (F.col("paragraph") % 4 / 4).alias("confidence"))
    return source_documents(seen, paragraphs, mapped)


_D, _S = cte("m_docs"), cte("m_segments")
_WS = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def chunk_cte(source: str, keys: str, size: int, overlap: int, name: str = "ck") -> str:
    """Recursive table for the oracle: `source` has columns `keys` and cleaned text t."""
    stop = f"CASE WHEN a + {size} < length(t) AND contains(substr(t, a + 1, {size}), ' ') AND a + {size} - instr(reverse(substr(t, a + 1, {size})), ' ') > a + {size // 2} THEN a + {size} - instr(reverse(substr(t, a + 1, {size})), ' ') ELSE least(a + {size}, length(t)) END"
    return f"""{name}_b AS (SELECT *, CASE WHEN length(t) <= {size} THEN length(t) ELSE {stop} END AS z FROM (SELECT {keys}, t, 0::BIGINT AS a, 1 AS piece FROM {source} WHERE t <> '')
      UNION ALL SELECT *, {stop} AS z FROM (SELECT {keys}, t, (CASE WHEN substr(t, m + 1, 1) = ' ' THEN m + 1 ELSE m END)::BIGINT AS a, piece + 1 AS piece FROM (SELECT *, greatest(z - {overlap}, a + 1) AS m FROM {name}_b WHERE z < length(t)))),
      {name} AS (SELECT {keys}, piece, count(*) OVER (PARTITION BY {keys}) AS pieces, trim(substr(t, a + 1, z - a)) AS content FROM {name}_b)"""


CHUNKS = f"{_D}, src AS (SELECT document_id, {_WS.format('text')} AS t FROM m_docs), {chunk_cte('src', 'document_id', 1200, 160)}, m_chunks AS (SELECT document_id, piece AS ordinal, 'Text' || CASE WHEN pieces > 1 THEN ' · part ' || piece ELSE '' END AS locator, content FROM ck)"


def _fold(source: str, key: str, order: str, cost: str, limit: int, between: int = 0) -> str:
    return f"""o AS (SELECT *, {cost} AS c, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {source}),
      f AS (SELECT {key}, {order}, k, 1 AS batch, c::BIGINT AS used FROM o WHERE k = 1 UNION ALL
        SELECT o.{key}, o.{order}, o.k, CASE WHEN f.used + {between} + o.c > {limit} THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + {between} + o.c > {limit} THEN o.c ELSE f.used + {between} + o.c END FROM f JOIN o ON o.{key} = f.{key} AND o.k = f.k + 1)"""


def _cuts(source: str, keys: str, limit: int, sentences: bool) -> str:
    last = lambda m: f"(CASE WHEN contains(p, {m}) THEN {limit} - instr(reverse(p), {m}) ELSE -1 END)"
    space, half = last("' '"), limit // 2
    if sentences:
        first = "greatest(" + ", ".join(last(f"'{m}'") + " + 1" for m in ".!?。！？") + ")"
        at = f"(SELECT CASE WHEN y <= 0 THEN {limit} ELSE y END FROM (SELECT CASE WHEN x < {half} THEN {space} ELSE x END AS y FROM (SELECT {first} AS x)))"
    else:
        at = f"(SELECT CASE WHEN y < {half} THEN {limit} ELSE y END FROM (SELECT CASE WHEN x < {half} THEN {space} ELSE x END AS y FROM (SELECT {last('chr(10)')} AS x)))"
    trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""cut AS (SELECT {keys}, 0 AS j, NULL::VARCHAR AS piece, t AS rest FROM {source} UNION ALL
      SELECT {keys}, j + 1, CASE WHEN length(rest) > {limit} THEN {trim("substr(rest, 1, cutat)")} ELSE rest END, CASE WHEN length(rest) > {limit} THEN {trim("substr(rest, cutat + 1)")} ELSE '' END
      FROM (SELECT *, {at} AS cutat FROM (SELECT *, substr(rest, 1, {limit}) AS p FROM cut WHERE rest <> '')))"""


QUERIES = {
    "library_chunks": query(lambda d: library_chunks(text_sections(d)), "m_docs"),
    "index_documents": query(index_documents, "m_docs"),
    "source_documents": query(_slides, "m_slides", "m_segments"),
    "cleanup_batches": query(lambda s: cleanup_batches(s, 12_000, 1000), "m_segments"),
    "block_batches": query(lambda s: block_batches(s, 1000), "m_segments"),
    "markdown_batches": query(lambda d: markdown_batches(d, 700), "m_docs"),
    "narration_chunks": query(lambda d: narration_chunks(d), "m_docs"),
}

_PARAGRAPHS = "pp AS (SELECT lecture % 20 AS lecture, lecture * 100 + segment AS paragraph, text, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s, role FROM m_segments)"
ORACLES = {
    "library_chunks": f"{CHUNKS} SELECT * FROM m_chunks",
    "index_documents": f"{CHUNKS} SELECT document_id, CASE WHEN text IS NULL THEN 'extraction_failed' WHEN n > 0 THEN 'indexed' ELSE 'stored' END AS status, coalesce(n, 0) AS n_chunks, CASE WHEN text IS NULL THEN 'no text' END AS error FROM m_docs LEFT JOIN (SELECT document_id, count(*) AS n FROM m_chunks GROUP BY document_id) USING (document_id)",
    "source_documents": f"""{cte("m_slides", "m_segments")}, {_PARAGRAPHS},
      s1 AS (SELECT lecture, slide, {_WS.format("concat_ws(chr(10), 'Slide ' || slide || ': ' || coalesce(title, ''), CASE WHEN " + _WS.format('content') + " <> '' THEN content END, CASE WHEN " + _WS.format('notes') + " <> '' THEN 'Speaker notes: ' || notes END, CASE WHEN notes = '' THEN 'Text detected in diagrams/images: ' || title || ' axis' END)")} AS t FROM m_slides), {chunk_cte("s1", "lecture, slide", 900, 140, "c1")},
      s2 AS (SELECT lecture, paragraph, {_WS.format("text")} AS t FROM pp), {chunk_cte("s2", "lecture, paragraph", 900, 140, "c2")}
      SELECT lecture, 'slide-' || slide || '-chunk-' || piece AS id, 'slide' AS source, slide AS slide_number, NULL::BIGINT AS paragraph, NULL::DOUBLE AS start_s, NULL::DOUBLE AS end_s, piece, content, NULL::BIGINT AS aligned_slide, NULL AS alignment_method, NULL::DOUBLE AS alignment_confidence FROM c1
      UNION ALL SELECT lecture, 'transcript-' || paragraph || '-chunk-' || piece, 'transcript', NULL, paragraph, start_s, end_s, piece, content, CASE WHEN role <> 'user' THEN paragraph % 5 + 1 END, CASE WHEN role <> 'user' THEN 'semantic' END, CASE WHEN role <> 'user' THEN paragraph % 4 / 4 END FROM c2 JOIN pp USING (lecture, paragraph)""",
    "cleanup_batches": f"{_S}, {_fold('m_segments', 'lecture', 'segment', 'length(text) + 120', 2000)} SELECT lecture, segment, batch FROM f",
    "block_batches": f"{_S}, fit AS (SELECT * FROM m_segments WHERE length(text) <= 1000), {_fold('fit', 'lecture', 'segment', 'length(text)', 1000)} SELECT lecture, segment, batch FROM f UNION ALL SELECT lecture, segment, -1 FROM m_segments WHERE length(text) > 1000",
    "markdown_batches": f"""{_D}, bl AS (SELECT document_id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT document_id, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n') AS b FROM m_docs)),
      src AS (SELECT document_id, i, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS t FROM bl), {_cuts("src", "document_id, i", 700, False)}, pc AS (SELECT document_id, piece, row_number() OVER (PARTITION BY document_id ORDER BY i, j) AS n FROM cut WHERE j > 0),
      {_fold("pc", "document_id", "n", "length(piece)", 700, 2)} SELECT document_id, batch, string_agg(piece, chr(10) || chr(10) ORDER BY n) AS text FROM f JOIN pc USING (document_id, n) GROUP BY ALL""",
    "narration_chunks": f"{_D}, src AS (SELECT document_id, text AS t FROM m_docs), {_cuts('src', 'document_id', 320, True)} SELECT document_id, j - 1 AS piece, piece AS text FROM cut WHERE j > 0",
}
ORACLES["narration_chunks"] = ORACLES["narration_chunks"].replace("piece AS text", "piece AS text")
