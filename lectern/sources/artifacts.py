"""Readers and writers of files: corpora of texts, lecture artifacts, ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.rules import clean_text

# Suffixes that are read as text.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".csv", ".json", ".html", ".htm", ".xml", ".py", ".js", ".tex", ".srt", ".vtt")
# The file of each kind of artifact, and where its items are.
ARTIFACTS = {"slides": ("slides.json", "slides"), "summaries": ("slide_summaries.json", "slides"), "alignment": ("alignment.json", "slides"), "transcript": ("transcript.json", "segments"), "paragraphs": ("transcript.json", "paragraphs")}


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """#1: files with a listed suffix as UTF-8 with replacement; those of white space alone give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "[^/]*$", 0)
    listed = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*TEXT_SUFFIXES)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.filter(listed).select("path", name.alias("name"), text.alias("text"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes")).filter(clean_text("text") != "")


def artifact_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """#6: (subject, lecture, value) of one kind of artifact under subject/lecture folders."""
    name = ARTIFACTS[kind][0]
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).withColumn("path", F.col("_metadata.file_path"))
    parts = F.split("path", "/")
    return files.select(F.url_decode(F.element_at(parts, -3)).alias("subject"), F.url_decode(F.element_at(parts, -2)).alias("lecture"), "value")


def _items(kind: str) -> Column:
    """The items of a file as variants, whether the file is a list or has one under its key; null where it has neither."""
    of = lambda path: F.expr(f"try_variant_get(try_parse_json(value), '{path}', 'array<variant>')")
    return F.coalesce(of("$." + ARTIFACTS[kind][1]), of("$"))


def _opened(files: DataFrame, kind: str) -> DataFrame:
    """One row for each item, with its place in the file and whether it is an object."""
    rows = files.select("subject", "lecture", F.posexplode(_items(kind)).alias("item", "v"))
    return rows.withColumn("object", F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)))


def _get(path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")


def _text(path: str) -> Column:
    return F.coalesce(_get(path, "string"), F.lit(""))


def _number() -> Column:
    """The number of a slide: an integer or a string of digits."""
    return F.when(_get("slide", "string").rlike("^[0-9]{1,9}$"), _get("slide", "string").cast("int"))


def _numbered(files: DataFrame, kind: str) -> DataFrame:
    return _opened(files, kind).filter("object").withColumn("slide", _number()).filter("slide IS NOT NULL")


def read_slides(files: DataFrame) -> DataFrame:
    """#6: slides; items that are no objects or have no number are dropped, unreadable files give no row."""
    return _numbered(files, "slides").select(
        "subject", "lecture", "slide", _text("title").alias("title"), _text("content").alias("content"), _text("notes").alias("notes"), F.coalesce(_get("images", "array<string>"), F.array().cast("array<string>")).alias("images"),
        F.coalesce(_get("visual_text", "array<string>"), F.array().cast("array<string>")).alias("visual_text"), _text("preview_image").alias("preview_image"),
    )


def read_summaries(files: DataFrame) -> DataFrame:
    """#6: summaries of slides with the sources that they name, null where they name none."""
    return _numbered(files, "summaries").select("subject", "lecture", "slide", _text("title").alias("title"), _text("summary").alias("summary"), _get("sources.slide", "boolean").alias("slide_source"), _get("sources.teacher_audio", "boolean").alias("audio_source"))


def read_alignment(files: DataFrame) -> DataFrame:
    """#6: the paragraphs that each slide is aligned with, in order."""
    slides = _numbered(files, "alignment").select("subject", "lecture", "slide", F.posexplode(F.expr("try_variant_get(v, '$.paragraphs', 'array<variant>')")).alias("place", "v"))
    slides = slides.filter(F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)))
    return slides.select("subject", "lecture", "slide", "place", _text("start_time").alias("start_time"), _text("end_time").alias("end_time"), _text("text").alias("text"), F.coalesce(_get("alignment.method", "string"), F.lit("unknown")).alias("method"), F.coalesce(_get("alignment.confidence", "double"), F.lit(0.0)).alias("confidence"))


def read_transcript(files: DataFrame, kind: str = "transcript") -> DataFrame:
    """#6: the segments (kind `transcript`) or paragraphs of a transcript; items without text are dropped."""
    rows = _opened(files, kind).filter("object")
    return rows.select("subject", "lecture", F.coalesce(_get("id", "long"), (F.col("item") + 1).cast("long")).alias("id"), _get("start", "double").alias("start"), _get("end", "double").alias("end"), _text("text").alias("text")).filter(clean_text("text") != "")


def rejected_items(files: DataFrame, kind: str) -> DataFrame:
    """#6: what a reader leaves out: whole files (item null) and single items, with the reason."""
    broken = F.when(F.expr("try_parse_json(value)").isNull(), "not JSON").when(_items(kind).isNull(), "no list of items")
    whole = files.select("subject", "lecture", F.lit(None).cast("int").alias("item"), broken.alias("reason"))
    rows = _opened(files, kind).withColumn("slide", _number())
    wrong = F.when(~F.col("object"), "no object")
    wrong = wrong.when(clean_text(_get("text", "string")) == "", "no text") if kind in ("transcript", "paragraphs") else wrong.when(F.col("slide").isNull(), "no slide number")
    return whole.unionByName(rows.select("subject", "lecture", "item", wrong.alias("reason"))).filter("reason IS NOT NULL")


def export_artifacts(rows: DataFrame, kind: str, folder: str) -> None:
    """#7: one JSON document for each subject and lecture; slides lose their images, which other machines do not have.

    `rows` are as the readers give them; a document holds one lecture.
    """
    listed = rows.drop("images", "preview_image")
    if kind == "alignment":
        one = F.struct("place", "start_time", "end_time", "text", F.struct("method", "confidence").alias("alignment"))
        per_slide = listed.groupBy("subject", "lecture", "slide").agg(F.array_sort(F.collect_list(one)).alias("p"))
        listed = per_slide.select("subject", "lecture", "slide", F.transform("p", lambda x: x.dropFields("place")).alias("paragraphs"))
    if kind == "summaries":
        listed = listed.withColumn("sources", F.struct(F.col("slide_source").alias("slide"), F.col("audio_source").alias("teacher_audio"))).drop("slide_source", "audio_source")
    first = "id" if kind in ("transcript", "paragraphs") else "slide"
    fields = [first, *(c for c in listed.columns if c not in ("subject", "lecture", first))]
    items = F.array_sort(F.collect_list(F.struct(*fields)))
    documents = listed.groupBy("subject", "lecture").agg(F.to_json(F.struct(items.alias(ARTIFACTS[kind][1]))).alias("value"))
    documents.write.mode("overwrite").partitionBy("subject", "lecture").text(f"{folder}/{kind}")


def exported_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The documents that `export_artifacts` has written, for the readers."""
    rows = spark.read.text(f"{folder}/{kind}", wholetext=True, lineSep="\n")
    return rows.select(F.col("subject").cast("string").alias("subject"), F.col("lecture").cast("string").alias("lecture"), "value")


def write_texts(rows: DataFrame, column: str, folder: str) -> None:
    """#9 to #11: one text column as text files."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def write_lines(lines: DataFrame, number: str, line: str, folder: str) -> None:
    """#12: numbered lines as text files whose names and lines follow the numbers."""
    lines.repartitionByRange(number).sortWithinPartitions(number).select(F.col(line).alias("value")).write.mode("overwrite").text(folder)
