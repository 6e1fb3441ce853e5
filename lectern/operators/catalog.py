"""Catalog operators: subjects, folders, documents, and change jobs on them.

A change job takes a table of requests and gives one row per request with a reason
where it is rejected; `apply_*` gives the catalog after the accepted ones. Of accepted
requests that would clash with each other the one of the lowest document applies. Names
compare without the case of A-Z, a missing folder is the subject's root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.durable import written
from lectern.functions.order import numbered, numbered_within
from lectern.functions.rules import byte_size, nocase, suffix
from lectern.sources.model import cte, query

# Endings of generated files' stems, after runs of other characters became `_`.
INTERNAL_ENDINGS = ("transcript_raw", "transcript_cleaned", "slides_extracted", "slide_summaries", "alignment", "quality_report", "manifest")
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".pdf": "application/pdf", ".json": "application/json"}
# How a request for a change starts, and what a plan may do.
CHANGE_REQUEST = r"^\s*(?:please\s+)?(?:rename|move|list|change\s+(?:the\s+)?(?:file\s+)?name|show\s+(?:my\s+)?(?:files|documents)|create\s+(?:a\s+)?(?:subject|folder))\b"
ACTIONS = ("answer", "list_documents", "rename_document", "move_document", "create_subject")
STATUSES = ("queued", "running", "waiting", "deferred", "completed", "failed", "cancelled")


def in_scope(docs: DataFrame, subject: str | None = None, folder: str | None = None, root: bool = False) -> DataFrame:
    """#15: documents of a subject, of a folder, or of the subjects' roots."""
    if subject is not None:
        docs = docs.filter(F.col("subject") == subject)
    if root:
        return docs.filter("folder IS NULL")
    return docs if folder is None else docs.filter(F.col("folder") == folder)


def is_internal(name):
    """#16: whether a file name is that of a generated file."""
    ext = F.substring(suffix(name), 2, 20)
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    key = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    markdown = ext.isin("md", "markdown")
    return (
        (key.contains("transcript") & ext.isin("json", "txt"))
        | key.rlike("(" + "|".join(INTERNAL_ENDINGS) + ")$")
        | (key.endswith("_notes") & markdown)
        | ((markdown | (ext == "pdf")) & stem.rlike(r"^(notes\.|slide_[0-9]+\.)"))
        | (F.concat(F.lit("_"), key, F.lit("_")).contains("_deep_review_") & markdown)
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """#2: digest, size and media type of each document, with the reason where it is empty."""
    kind = F.coalesce(*[F.when(suffix(F.col("name")) == s, t) for s, t in MEDIA_TYPES.items()], F.lit("application/octet-stream"))
    size = F.octet_length("text")
    return docs.select("document_id", F.sha2("text", 256).alias("digest"), size.alias("size_bytes"), kind.alias("media_type"), F.when(size == 0, "empty file").alias("rejected"))


def listing(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """#21: every document with its folder's name, empty at the root, newest first per subject."""
    f = folders.select("subject", "folder", F.concat(F.lit("folder "), "folder").alias("folder_name"))
    rows = docs.join(f, ["subject", "folder"], "left").select("document_id", "subject", "name", F.coalesce("folder_name", F.lit("")).alias("folder_name"))
    return numbered_within(rows, ["subject"], [F.desc("document_id")], "place", written).withColumn("place", F.col("place").cast("int"))


def duplicate_content(docs: DataFrame) -> DataFrame:
    """#23: within a subject the first document of a digest is accepted, the others name it."""
    w = Window.partitionBy("subject", "digest").orderBy("document_id")
    return docs.select("document_id", F.first("name").over(w).alias("existing"), (F.row_number().over(w) == 1).alias("accepted"))


def name_collisions(docs: DataFrame) -> DataFrame:
    """#24: documents whose name, but for case, another document of the subject has."""
    keyed = docs.select("document_id", "subject", nocase("name").alias("key"))
    taken = keyed.groupBy("subject", "key").agg(F.count("*").alias("n"), F.min("document_id").alias("first_id")).filter("n > 1")
    return keyed.join(taken, ["subject", "key"]).select("document_id", "subject", "key", "n", "first_id")


def related_documents(docs: DataFrame) -> DataFrame:
    """#26: per document, how many others lie in the same folder or root, and the least of them."""
    place = docs.groupBy("subject", "folder").agg(F.count("*").alias("n"), F.min("document_id").alias("first_id"))
    same = (docs["subject"] == place["subject"]) & docs["folder"].eqNullSafe(place["folder"])
    return docs.join(place, same).select("document_id", (F.col("n") - 1).alias("n_related"), "first_id")


#: Artifacts of a lecture, and what their names hold.
ARTIFACT_TOKENS = {"slides": ("slides", "extracted"), "summaries": ("slide", "summaries"), "alignment": ("alignment",)}


def related_artifacts(docs: DataFrame, tokens: dict[str, tuple[str, ...]] = ARTIFACT_TOKENS) -> DataFrame:
    """#26: for each document and kind of artifact the newest document beside it whose name has all tokens of the kind; null where there is none."""
    key = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"))
    holds = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(key, w))
    kinds = F.filter(F.array(*(F.when(holds(words), kind) for kind, words in tokens.items())), lambda k: k.isNotNull())
    found = docs.select("subject", "folder", "document_id", F.explode(kinds).alias("kind")).groupBy("subject", "folder", "kind").agg(F.max("document_id").alias("artifact_id"))
    asked = docs.select("document_id", F.col("subject").alias("s"), F.col("folder").alias("f"), F.explode(F.array(*map(F.lit, tokens))).alias("k"))
    same = asked["s"].eqNullSafe(found["subject"]) & asked["f"].eqNullSafe(found["folder"]) & (asked["k"] == found["kind"])
    return asked.join(found, same, "left").select("document_id", F.col("k").alias("kind"), "artifact_id")


def subject_counts(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """#58: documents per folder, empty folders included, ordered by count."""
    n = docs.filter("folder IS NOT NULL").groupBy("subject", "folder").agg(F.count("*").alias("n"))
    out = folders.join(n, ["subject", "folder"], "left").select("subject", "folder", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))
    keyed = out.withColumn("key", nocase("folder"))
    return numbered_within(keyed, ["subject"], [F.desc("n_documents"), "key"], "place", written).drop("key").withColumn("place", F.col("place").cast("int"))


def explorer_counts(docs: DataFrame) -> DataFrame:
    """#66: documents per folder where a missing folder is `Subject root`."""
    return docs.groupBy("subject", F.coalesce("folder", F.lit("Subject root")).alias("folder")).agg(F.count("*").alias("n_documents"))


def library_stats(docs: DataFrame, folders: DataFrame, chunks: DataFrame) -> DataFrame:
    """#59: subjects, folders, documents, indexed documents and chunks in one row."""
    a = docs.agg(F.count_distinct("subject").alias("subjects"), F.count("*").alias("documents"))
    b = folders.agg(F.count("*").alias("folders"))
    c = chunks.agg(F.count_distinct("document_id").alias("indexed"), F.count("*").alias("chunks"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def status_counts(jobs: DataFrame) -> DataFrame:
    """#60: jobs per status, all seven of them."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = jobs.groupBy("status").agg(F.count("*").alias("n"))
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"))


def pairing_candidates(docs: DataFrame) -> DataFrame:
    """#18: folders with exactly one recording and exactly one deck."""
    one = lambda ending, c: F.count_if(F.col("kind") == ending).alias(c)
    of = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col("document_id"))).alias(c)
    found = docs.groupBy("subject", "folder").agg(one("recording", "recordings"), one("deck", "decks"), of("recording", "recording_id"), of("deck", "deck_id"))
    return found.filter("recordings = 1 AND decks = 1").select("subject", "folder", "recording_id", "deck_id")


def _with_kind(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("document_id") % 29 == 0, "recording").when(F.col("document_id") % 31 == 1, "deck").otherwise("other")
    return docs.select("document_id", "subject", "folder", kind.alias("kind"))


#: What a run puts before the names of its stored inputs.
STORED_PREFIXES = ("slides_", "recording_")


def deck_flags(docs: DataFrame, pages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """#17: whether a file is a slide deck: ppt and pptx always; pdf with slides by name, as an input of its own run, or by page count.

    `sources` holds (document_id, stored_name) of the inputs of the run that a document comes from.
    """
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_")
    joined = docs.withColumn("ext", suffix(F.col("name"))).join(pages, "document_id", "left").fillna(0, ["n_pages", "n_slides"])
    if sources is None:
        joined = joined.withColumn("source", F.lit(False))
    else:
        stored = F.lower("stored_name")
        plain = F.coalesce(*(F.when(F.startswith(stored, F.lit(p)), F.substring(stored, len(p) + 1, F.length(stored))) for p in STORED_PREFIXES), stored)
        names = sources.select("document_id", F.explode(F.array_distinct(F.array(stored, plain))).alias("low")).distinct().withColumn("source", F.lit(True))
        joined = joined.withColumn("low", F.lower("name")).join(names, ["document_id", "low"], "left").fillna(False, ["source"])
    pdf = (F.col("ext") == ".pdf") & (F.col("n_slides") > 0) & ~F.lower("name").contains("notes") & (key.contains("slides") | F.col("source") | (F.col("n_pages") == F.col("n_slides")))
    return joined.select("document_id", "name", (F.col("ext").isin(".ppt", ".pptx") | pdf).alias("is_deck"))


# Beyond which a shared file is large, and beyond which it is refused unless large files are tracked.
LARGE_BYTES, BLOCKED_BYTES = 50 * 1024 * 1024, 100 * 1024 * 1024
#: Summaries name sizes as pages do, in GB at most; the written index goes on to TB.
LARGEST_UNIT = "GB"


def sharing_summary(files: DataFrame, large: int = LARGE_BYTES, blocked: int = BLOCKED_BYTES) -> DataFrame:
    """#65: files (path, size_bytes, origin, tracked) per origin and, as `all`, of all origins with each path once; a tracked file is never refused."""
    refused = (F.col("size_bytes") > blocked) & ~F.coalesce("tracked", F.lit(False))
    total = F.sum("size_bytes").cast("long")
    figures = (F.count("*").alias("files"), total.alias("bytes"), F.count_if(F.col("size_bytes") > large).alias("large"), F.count_if(refused).alias("blocked"), byte_size(total, LARGEST_UNIT).alias("label"))
    once = files.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.bool_or(F.coalesce("tracked", F.lit(False))).alias("tracked"))
    return files.groupBy("origin").agg(*figures).unionByName(once.withColumn("origin", F.lit("all")).groupBy("origin").agg(*figures))


def storage_summary(docs: DataFrame, large: int, blocked: int) -> DataFrame:
    """#65: per subject, sizes and how many files are large or too large."""
    total = F.sum("size_bytes").cast("long")
    return docs.groupBy("subject").agg(F.count("*").alias("files"), total.alias("bytes"), F.count_if(F.col("size_bytes") > large).alias("large"), F.count_if(F.col("size_bytes") > blocked).alias("blocked"), byte_size(total, LARGEST_UNIT).alias("label"))


def largest_files(docs: DataFrame, n: int = 20) -> DataFrame:
    """#65: the n largest files."""
    return docs.orderBy(F.desc("size_bytes"), "document_id").limit(n).select("document_id", "name", "size_bytes", byte_size(F.col("size_bytes"), LARGEST_UNIT).alias("label"))


def artifact_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """#78: per path, whether a copy is new, the same, in conflict, or only there already."""
    both = old.select("path", F.col("digest").alias("a")).join(new.select("path", F.col("digest").alias("b")), "path", "full")
    state = F.when(F.col("a").isNull(), "copy").when(F.col("b").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("conflict")
    return both.select("path", state.alias("state"))


def inventory(*tables: DataFrame) -> DataFrame:
    """#79: distinct paths of several sources in folded order, without paths that leave the root."""
    out = tables[0].select("path")
    for t in tables[1:]:
        out = out.union(t.select("path"))
    return out.filter(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")).distinct()


def rename_requests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """#81: (document_id, new_name): the extension stays, is added if absent, must not change; names must be free."""
    ext, new_ext = suffix(F.col("name")), suffix(F.col("new_name"))
    asked = wanted.join(docs, "document_id").withColumn("target", F.when(new_ext == "", F.concat("new_name", ext)).otherwise(F.col("new_name")))
    taken = docs.select(F.col("subject").alias("s"), nocase("name").alias("k"), F.col("document_id").alias("holder"))
    hit = (asked["subject"] == taken["s"]) & (nocase("target") == taken["k"]) & (asked["document_id"] != taken["holder"])
    clash = asked.join(taken, hit, "left_semi").select("document_id", F.lit(True).alias("clash"))
    reason = F.when((new_ext != "") & (new_ext != ext), "extension").when(F.col("clash"), "taken").when(F.col("target") == F.col("name"), "unchanged")
    return asked.join(clash, "document_id", "left").select("document_id", "target", reason.alias("reason"))


def _first_of(accepted: DataFrame, *clashes: list) -> DataFrame:
    """Accepted requests without those that an earlier one forbids."""
    for keys in clashes:
        accepted = accepted.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("document_id"))).filter("nth = 1").drop("nth")
    return accepted


def apply_renames(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """#81: the documents with their new names; `decided` comes from `rename_requests`."""
    accepted = decided.filter("reason IS NULL").join(docs.select("document_id", "subject"), "document_id")
    new = _first_of(accepted, ["subject", nocase("target")]).select("document_id", "target")
    return docs.join(new, "document_id", "left").withColumn("name", F.coalesce("target", "name")).drop("target")


def apply_moves(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """#82: the documents at their new places; `decided` comes from `move_requests`."""
    accepted = decided.filter("reason IS NULL").join(docs.select("document_id", "name", "digest"), "document_id")
    new = _first_of(accepted, ["to_subject", "digest"], ["to_subject", nocase("name")]).select("document_id", "to_subject", "to_folder")
    moved = docs.join(new, "document_id", "left")
    folder = F.when(F.col("to_subject").isNull(), F.col("folder")).otherwise(F.col("to_folder"))
    return moved.withColumns({"folder": folder, "subject": F.coalesce("to_subject", "subject")}).drop("to_subject", "to_folder")


def apply_replacements(docs: DataFrame, wanted: DataFrame, decided: DataFrame) -> DataFrame:
    """#84: the documents with their new digests and sizes; `decided` comes from `replace_content` on `wanted`."""
    accepted = decided.filter("state = 'replaced'").join(wanted, "document_id").join(docs.select("document_id", "subject"), "document_id")
    new = _first_of(accepted, ["subject", "new_digest"]).select("document_id", "new_digest", "new_size")
    out = docs.join(new, "document_id", "left")
    return out.withColumns({"digest": F.coalesce("new_digest", "digest"), "size_bytes": F.coalesce("new_size", "size_bytes")}).drop("new_digest", "new_size")


def apply_names(existing: DataFrame, decided: DataFrame) -> DataFrame:
    """#80: all names after the missing ones were created; `decided` comes from `ensure_names`."""
    return existing.select("name").distinct().unionByName(decided.filter("state = 'created'").select("name"))


def move_requests(docs: DataFrame, folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """#82: (document_id, to_subject, to_folder): rejected for equal content or name there, or an unknown folder."""
    asked = wanted.join(docs.select("document_id", "name", "digest"), "document_id")
    there = docs.select(F.col("subject").alias("to_subject"), F.col("document_id").alias("other"), F.col("digest").alias("d"), nocase("name").alias("k"))
    same = asked.join(there, "to_subject").filter("other <> document_id")
    content = same.filter("d = digest").select("document_id").distinct().withColumn("content", F.lit(True))
    name = same.filter(nocase("name") == F.col("k")).select("document_id").distinct().withColumn("named", F.lit(True))
    known = folders.select(F.col("subject").alias("to_subject"), F.col("folder").alias("to_folder"), F.lit(True).alias("known"))
    out = asked.join(known, ["to_subject", "to_folder"], "left").join(content, "document_id", "left").join(name, "document_id", "left")
    reason = F.when(F.col("to_folder").isNotNull() & F.col("known").isNull(), "folder").when(F.col("content"), "content").when(F.col("named"), "name")
    return out.select("document_id", "to_subject", "to_folder", reason.alias("reason"))


def delete_subjects(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """#83: deleting subjects takes their documents along."""
    return docs.join(gone, "subject", "left_anti").select("document_id", "subject", "folder")


def delete_folders(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """#83: (subject, folder, with_content): documents go along if that is asked for; else a folder that holds some stays."""
    asked = gone.filter("with_content").select("subject", "folder").distinct()
    return docs.join(asked, ["subject", "folder"], "left_anti").select("document_id", "subject", "folder")


def replace_content(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """#84: (document_id, new_digest, new_size): empty, unchanged and duplicate contents are told apart."""
    asked = wanted.join(docs.select("document_id", "subject", "digest"), "document_id")
    there = docs.select("subject", F.col("digest").alias("new_digest"), F.col("document_id").alias("other"))
    twin = asked.join(there, ["subject", "new_digest"]).filter("other <> document_id").select("document_id").distinct().withColumn("twin", F.lit(True))
    state = F.when(F.col("new_size") == 0, "empty").when(F.col("new_digest") == F.col("digest"), "unchanged").when(F.col("twin"), "duplicate").otherwise("replaced")
    return asked.join(twin, "document_id", "left").select("document_id", state.alias("state"))


def ensure_names(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """#80: wanted names, normalised; what exists is returned, what is new is created, lengths are 1 to 120."""
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    asked = wanted.select(name.alias("name")).withColumn("key", nocase("name")).groupBy("key").agg(F.min("name").alias("name"))
    have = existing.select(nocase("name").alias("key"), F.col("name").alias("current")).groupBy("key").agg(F.min("current").alias("current"))
    state = F.when(~F.length("name").between(1, 120), "invalid").when(F.col("current").isNotNull(), "existing").otherwise("created")
    return asked.join(have, "key", "left").select(F.coalesce("current", "name").alias("name"), state.alias("state"))


def content_provenance(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """#25: per document the latest completed job of its subject with an input of equal suffix, size and digest."""
    done = jobs.filter("status = 'completed'")
    found = docs.withColumn("ext", suffix(F.col("name"))).join(done, ["subject", "ext", "size_bytes", "digest"]).groupBy("document_id").agg(F.max_by("job_id", "created").alias("job_id"))
    return docs.join(found, "document_id", "left").select("document_id", "job_id")


# Files without which a run is not exported.
REQUIRED_FILES = ("slides.json", "slide_summaries.json", "alignment.json", "transcript.json")


def run_matches(runs: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """#8: runs that have all required files (run_id, name) and whose recording and deck both resolve to one subject and folder; the later run wins there."""
    whole = files.filter(F.col("name").isin(*REQUIRED_FILES)).groupBy("run_id").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(REQUIRED_FILES)).select("run_id")
    d = docs.filter("folder IS NOT NULL").select("digest", "subject", "folder").distinct()
    a = runs.join(whole, "run_id", "left_semi").join(d.withColumnRenamed("digest", "recording_digest"), "recording_digest")
    b = d.select(F.col("digest").alias("deck_digest"), F.col("subject").alias("s"), F.col("folder").alias("f"))
    both = a.join(b, "deck_digest").filter("subject = s AND folder = f")
    return both.groupBy("subject", "folder").agg(F.max("run_id").alias("run_id"))


def share_index(docs: DataFrame) -> DataFrame:
    """#12: the catalog as numbered Markdown lines: subjects by name, in each the root's documents first, then folders by name.

    Lines are ordered where they lie, so a subject of any size spreads over partitions; `write_lines` keeps the order.
    """
    label = F.regexp_replace("name", r"([\\\[\]])", r"\\$1")
    line = F.concat(F.lit("- ["), label, F.lit("]("), F.col("subject"), F.lit("/"), F.col("name"), F.lit(") · "), byte_size(F.col("size_bytes")))
    rows = docs.select("subject", F.coalesce("folder", F.lit("")).alias("f"), F.lit(2).alias("kind"), F.lower("name").alias("k"), line.alias("line"))
    heads = docs.filter("folder IS NOT NULL").select("subject", F.col("folder").alias("f"), F.lit(1), F.lit(""), F.concat(F.lit("### "), "folder")).distinct()
    titles = docs.select("subject", F.lit("").alias("f"), F.lit(0), F.lit(""), F.concat(F.lit("## "), "subject")).distinct()
    lines = rows.union(heads).union(titles)
    return numbered(lines, ["subject", "f", "kind", "k", "line"], "line_number", written).select("line_number", "line")


def is_change_request(text):
    """#34: whether a request asks for a change of the library, or else is a question."""
    return F.coalesce(text.rlike("(?iU)" + CHANGE_REQUEST), F.lit(False))


def checked_plans(plans: DataFrame, docs: DataFrame, subjects: DataFrame) -> DataFrame:
    """#34: one row per plan with the first reason against it; null where it is accepted."""
    known = docs.select(F.col("document_id").alias("known_document")).distinct()
    places = subjects.select(F.col("subject").alias("known_subject")).distinct()
    found = plans.join(known, F.col("document_id") == F.col("known_document"), "left").join(places, F.trim("target_subject") == F.col("known_subject"), "left")
    action, blank = F.col("action"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown action")
        .when(action.isin("rename_document", "move_document") & F.col("known_document").isNull(), "unknown document")
        .when((action == "rename_document") & blank("new_name"), "no new name")
        .when((action == "move_document") & F.col("known_subject").isNull(), "unknown subject")
        .when((action == "list_documents") & ~blank("target_subject") & F.col("known_subject").isNull(), "unknown subject")
        .when((action == "create_subject") & blank("subject_name"), "no subject name")
    )
    return found.select("plan_id", "action", reason.alias("reason"))


def _paths(docs: DataFrame, shift: int = 0) -> DataFrame:
    n = F.col("document_id") + shift
    return docs.select(F.concat(F.when(n % 50 == 0, "../").otherwise(""), F.lit("f"), (n % 400).cast("string")).alias("path"), "digest").groupBy("path").agg(F.min("digest").alias("digest"))


def _with_artifact_names(docs: DataFrame) -> DataFrame:
    name = F.expr("CASE document_id % 17 WHEN 0 THEN 'Week 1 Slides-Extracted.json' WHEN 1 THEN 'slide summaries v' || document_id % 3 || '.json' WHEN 2 THEN 'alignment.json' ELSE name END")
    return docs.select("document_id", "subject", "folder", name.alias("name"))


def _stored_names(docs: DataFrame) -> DataFrame:
    return _named(docs).select("document_id", F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("Slides_"), F.upper("name"))).otherwise(F.concat(F.lit("x_"), "name")).alias("stored_name"))


def _shared_files(docs: DataFrame) -> DataFrame:
    d = F.col("document_id")
    origin = F.when(d % 5 == 0, "loose").when(d % 101 == 0, "generated").otherwise("library")
    return docs.select(F.concat(F.lit("f"), (d % 700).cast("string")).alias("path"), (F.col("size_bytes").cast("long") * 4000).alias("size_bytes"), origin.alias("origin"), (d % 3 == 0).alias("tracked"))


def _run_files(docs: DataFrame) -> DataFrame:
    """Files of runs; some runs lack one."""
    name = F.explode(F.array(*map(F.lit, (*REQUIRED_FILES, "transcript.txt")))).alias("name")
    return docs.select(F.col("document_id").alias("run_id"), name).filter("NOT (run_id % 5 = 0 AND name = 'alignment.json')")


def _ids(rest: int, of: int):
    return F.col("document_id") % of == rest


def _runs(docs: DataFrame) -> DataFrame:
    later = docs.select((F.col("document_id") - 20).alias("document_id"), F.col("digest").alias("deck_digest"))
    return docs.filter(F.col("document_id") % 3 == 0).join(later, "document_id").select(F.col("document_id").alias("run_id"), F.col("digest").alias("recording_digest"), "deck_digest")


def _jobs_of(docs: DataFrame) -> DataFrame:
    status = F.when(F.col("document_id") % 4 == 3, "failed").otherwise("completed")
    return docs.filter(~_ids(0, 6)).select(F.col("document_id").alias("job_id"), F.col("document_id").alias("created"), status.alias("status"), "subject", F.lit(".txt").alias("ext"), "size_bytes", "digest")


_D = cte("m_docs")
_DF = cte("m_docs", "m_folders")
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIZE = """CASE WHEN {0} >= 1073741824 THEN printf('%.1f GB', {0} / 1073741824.0) WHEN {0} >= 1048576 THEN printf('%.1f MB', {0} / 1048576.0)
    WHEN {0} >= 1024 THEN printf('%.1f KB', {0} / 1024.0) ELSE printf('%d B', {0}::BIGINT) END"""
_NAMES = "CASE document_id % 9 WHEN 0 THEN 'x_Transcript.json' WHEN 1 THEN 'Week 1 alignment.txt' WHEN 2 THEN 'my_notes.md' WHEN 3 THEN 'notes.fr.pdf' WHEN 4 THEN 'slide_3.md' WHEN 5 THEN 'a_deep_review_b.md' WHEN 6 THEN 'slides.pdf' WHEN 7 THEN 'Notes slides.pdf' ELSE 'intro.pptx' END"


_REQUEST = "CASE document_id % 8 WHEN 0 THEN '  Please RENAME ' || name WHEN 1 THEN 'create a folder' WHEN 2 THEN 'renamed ' || name WHEN 3 THEN 'Show documents of ' || subject WHEN 4 THEN 'change the name' ELSE text END"
_ACTION = "CASE document_id % 6 WHEN 0 THEN 'answer' WHEN 1 THEN 'list_documents' WHEN 2 THEN 'rename_document' WHEN 3 THEN 'move_document' WHEN 4 THEN 'create_subject' ELSE 'erase' END"
_PLAN = (
    "document_id AS plan_id",
    f"{_ACTION} AS action",
    "CASE WHEN document_id % 5 = 0 THEN -1 - document_id ELSE document_id END AS document_id",
    "CASE WHEN document_id % 7 = 0 THEN ' ' ELSE name END AS new_name",
    "CASE WHEN document_id % 11 = 0 THEN 'nowhere' WHEN document_id % 13 = 0 THEN '' ELSE subject END AS target_subject",
    "CASE WHEN document_id % 9 = 1 THEN '' ELSE 'new' END AS subject_name",
)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.expr(_NAMES).alias("name"))


def _renames(d: DataFrame) -> DataFrame:
    return d.filter(_ids(1, 3)).select("document_id", F.expr("CASE document_id % 4 WHEN 0 THEN 'DOC_' || (document_id + 20) || '.txt' WHEN 1 THEN 'fresh' || document_id WHEN 2 THEN 'x.pdf' ELSE name END").alias("new_name"))


def _moves(d: DataFrame) -> DataFrame:
    return d.filter(_ids(2, 5)).select("document_id", F.concat(F.lit("src"), (F.col("document_id") % 20).cast("string")).alias("to_subject"), F.expr("CASE document_id % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'en' END").alias("to_folder"))


def _replacements(d: DataFrame) -> DataFrame:
    return d.filter(_ids(1, 4)).select("document_id", F.expr("CASE document_id % 3 WHEN 0 THEN digest WHEN 1 THEN sha2('x' || document_id, 256) ELSE sha2('same', 256) END").alias("new_digest"), (F.col("document_id") % 5).alias("new_size"))


def _names(d: DataFrame) -> DataFrame:
    return d.select(F.expr("CASE WHEN document_id % 5 = 0 THEN ' ' ELSE upper(coalesce(folder, 'new  one')) END").alias("name"))


def _folder_names(f: DataFrame) -> DataFrame:
    return f.select(F.col("folder").alias("name"))


QUERIES = {
    "renamed_documents": query(lambda d: apply_renames(d, rename_requests(d, _renames(d))).select("document_id", "subject", "name"), "m_docs"),
    "moved_documents": query(lambda d, f: apply_moves(d, move_requests(d, f, _moves(d))).select("document_id", "subject", "folder"), "m_docs", "m_folders"),
    "replaced_documents": query(lambda d: apply_replacements(d, _replacements(d), replace_content(d, _replacements(d))).select("document_id", "digest", F.col("size_bytes").cast("long").alias("size_bytes")), "m_docs"),
    "created_names": query(lambda d, f: apply_names(_folder_names(f), ensure_names(_folder_names(f), _names(d))), "m_docs", "m_folders"),
    "scope_filter": query(lambda d: in_scope(d, "src1", root=True).select("document_id", "name"), "m_docs"),
    "internal_artifacts": query(lambda d: _named(d).select("document_id", "name", is_internal(F.col("name")).alias("internal")), "m_docs"),
    "fingerprints": query(fingerprints, "m_docs"),
    "document_listing": query(listing, "m_docs", "m_folders"),
    "duplicate_content": query(duplicate_content, "m_docs"),
    "name_collisions": query(lambda d: name_collisions(d.withColumn("name", F.concat(F.when(_ids(0, 2), "Doc_").otherwise("doc_"), (F.col("document_id") % 300).cast("string")))), "m_docs"),
    "related_documents": query(related_documents, "m_docs"),
    "folder_counts": query(subject_counts, "m_docs", "m_folders"),
    "explorer_counts": query(explorer_counts, "m_docs"),
    "status_counts": query(status_counts, "m_jobs"),
    "pairing_candidates": query(lambda d: pairing_candidates(_with_kind(d)), "m_docs"),
    "deck_classifier": query(lambda d: deck_flags(_named(d), d.filter(~_ids(0, 4)).select("document_id", (F.col("document_id") % 3 + 1).alias("n_pages"), (F.col("document_id") % 2 + 1).alias("n_slides"))), "m_docs"),
    "storage_summary": query(lambda d: storage_summary(d, 4096, 16384), "m_docs"),
    "largest_files": query(largest_files, "m_docs"),
    "artifact_conflicts": query(lambda d: artifact_conflicts(_paths(d.filter(_ids(0, 3))), _paths(d.filter(_ids(0, 2)))), "m_docs"),
    "file_inventory": query(lambda d: inventory(_paths(d.filter(_ids(0, 3))), _paths(d.filter(_ids(0, 2)), 7)), "m_docs"),
    "rename_documents": query(lambda d: rename_requests(d, _renames(d)), "m_docs"),
    "move_documents": query(lambda d, f: move_requests(d, f, _moves(d)), "m_docs", "m_folders"),
    "delete_subjects": query(lambda d: delete_subjects(d, d.filter("subject LIKE 'src1%'").select("subject").distinct()), "m_docs"),
    "delete_folders": query(lambda d, f: delete_folders(d, f.filter("folder IN ('de', 'fr')").select("subject", "folder", (F.col("folder") == "de").alias("with_content"))), "m_docs", "m_folders"),
    "replace_content": query(lambda d: replace_content(d, _replacements(d)), "m_docs"),
    "ensure_names": query(lambda d, f: ensure_names(_folder_names(f), _names(d)), "m_docs", "m_folders"),
    "content_provenance": query(lambda d: content_provenance(d, _jobs_of(d)), "m_docs"),
    "run_matches": query(lambda d: run_matches(_runs(d), d, _run_files(d)), "m_docs"),
    "related_artifacts": query(lambda d: related_artifacts(_with_artifact_names(d)), "m_docs"),
    "sharing_summary": query(lambda d: sharing_summary(_shared_files(d)), "m_docs"),
    "deck_sources": query(lambda d: deck_flags(_named(d), d.filter(~_ids(0, 4)).select("document_id", (F.col("document_id") % 7 + 1).alias("n_pages"), (F.col("document_id") % 2 + 1).alias("n_slides")), _stored_names(d)), "m_docs"),
    "request_routes": query(lambda d: d.select("document_id", is_change_request(F.expr(_REQUEST)).alias("is_change")), "m_docs"),
    "checked_plans": query(lambda d: checked_plans(d.selectExpr(*_PLAN), d, d), "m_docs"),
    "share_index": query(share_index, "m_docs"),
}

_INTERNAL = """(contains(key, 'transcript') AND ext IN ('json', 'txt')) OR regexp_matches(key, '(transcript_raw|transcript_cleaned|slides_extracted|slide_summaries|alignment|quality_report|manifest)$')
  OR (ends_with(key, '_notes') AND ext IN ('md', 'markdown')) OR (ext IN ('md', 'markdown', 'pdf') AND regexp_matches(stem, '^(notes\\.|slide_[0-9]+\\.)')) OR (contains('_' || key || '_', '_deep_review_') AND ext IN ('md', 'markdown'))""".replace("\\\\", "\\")

ORACLES = {
    "scope_filter": f"{_D} SELECT document_id, name FROM m_docs WHERE subject = 'src1' AND folder IS NULL",
    "internal_artifacts": f"""{_D}, n AS (SELECT document_id, {_NAMES} AS name FROM m_docs), k AS (SELECT *, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM n),
      s AS (SELECT *, regexp_replace(regexp_replace(stem, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM k) SELECT document_id, name, {_INTERNAL} AS internal FROM s""",
    "fingerprints": f"{_D} SELECT document_id, digest, size_bytes, 'text/plain' AS media_type, CASE WHEN size_bytes = 0 THEN 'empty file' END AS rejected FROM m_docs",
    "document_listing": f"{_DF} SELECT document_id, subject, name, coalesce('folder ' || f.folder, '') AS folder_name, row_number() OVER (PARTITION BY subject ORDER BY document_id DESC) AS place FROM m_docs d LEFT JOIN m_folders f USING (subject, folder)",
    "duplicate_content": f"{_D} SELECT document_id, first_value(name) OVER w AS existing, row_number() OVER w = 1 AS accepted FROM m_docs WINDOW w AS (PARTITION BY subject, digest ORDER BY document_id)",
    "name_collisions": f"""{_D}, k AS (SELECT document_id, subject, 'doc_' || (document_id % 300) AS key FROM m_docs)
      SELECT document_id, subject, key, count(*) OVER w AS n, min(document_id) OVER w AS first_id FROM k WINDOW w AS (PARTITION BY subject, key) QUALIFY count(*) OVER w > 1""",
    "related_documents": f"{_D} SELECT document_id, count(*) OVER w - 1 AS n_related, min(document_id) OVER w AS first_id FROM m_docs WINDOW w AS (PARTITION BY subject, folder)",
    "folder_counts": f"""{_DF}, n AS (SELECT f.subject, f.folder, count(document_id) AS n_documents FROM m_folders f LEFT JOIN m_docs d ON d.subject = f.subject AND d.folder = f.folder GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n_documents DESC, folder) AS place FROM n""",
    "explorer_counts": f"{_D} SELECT subject, coalesce(folder, 'Subject root') AS folder, count(*) AS n_documents FROM m_docs GROUP BY ALL",
    "status_counts": cte("m_jobs") + " SELECT s AS status, (SELECT count(*) FROM m_jobs WHERE status = s) AS n_jobs FROM (SELECT unnest(['queued', 'running', 'waiting', 'deferred', 'completed', 'failed', 'cancelled']) AS s)",
    "pairing_candidates": f"""{_D} SELECT subject, folder, min(document_id) FILTER (document_id % 29 = 0) AS recording_id, min(document_id) FILTER (document_id % 29 <> 0 AND document_id % 31 = 1) AS deck_id FROM m_docs
      GROUP BY subject, folder HAVING count(*) FILTER (document_id % 29 = 0) = 1 AND count(*) FILTER (document_id % 29 <> 0 AND document_id % 31 = 1) = 1""",
    "deck_classifier": f"""{_D}, n AS (SELECT document_id, {_NAMES} AS name, document_id % 4 <> 0 AS has, document_id % 3 + 1 AS n_pages, document_id % 2 + 1 AS n_slides FROM m_docs)
      SELECT document_id, name, ends_with(name, '.pptx') OR (ends_with(name, '.pdf') AND has AND NOT contains(lower(name), 'notes') AND (contains(name, 'slides') OR n_pages = n_slides)) AS is_deck FROM n""",
    "storage_summary": f"""{_D}, s AS (SELECT subject, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (size_bytes > 4096) AS large, count(*) FILTER (size_bytes > 16384) AS blocked FROM m_docs GROUP BY subject)
      SELECT *, {_SIZE.format("bytes")} AS label FROM s""",
    "largest_files": f"{_D} SELECT document_id, name, size_bytes, {_SIZE.format('size_bytes')} AS label FROM m_docs ORDER BY size_bytes DESC, document_id LIMIT 20",
    "artifact_conflicts": f"""{_D}, p AS (SELECT CASE WHEN document_id % 50 = 0 THEN '../' ELSE '' END || 'f' || (document_id % 400) AS path, document_id, digest FROM m_docs),
      a AS (SELECT path, min(digest) AS a FROM p WHERE document_id % 3 = 0 GROUP BY path), b AS (SELECT path, min(digest) AS b FROM p WHERE document_id % 2 = 0 GROUP BY path)
      SELECT path, CASE WHEN a IS NULL THEN 'copy' WHEN b IS NULL THEN 'extra' WHEN a = b THEN 'same' ELSE 'conflict' END AS state FROM a FULL JOIN b USING (path)""",
    "file_inventory": f"""{_D} SELECT DISTINCT 'f' || (n % 400) AS path FROM (SELECT document_id AS n FROM m_docs WHERE document_id % 3 = 0 UNION ALL SELECT document_id + 7 FROM m_docs WHERE document_id % 2 = 0) WHERE n % 50 <> 0""",
    "rename_documents": f"""{_D}, w AS (SELECT *, CASE document_id % 4 WHEN 0 THEN 'DOC_' || (document_id + 20) || '.txt' WHEN 1 THEN 'fresh' || document_id || '.txt' WHEN 2 THEN 'x.pdf' ELSE name END AS target FROM m_docs WHERE document_id % 3 = 1)
      SELECT document_id, target, CASE WHEN ends_with(target, '.pdf') THEN 'extension' WHEN EXISTS (FROM m_docs d WHERE d.subject = w.subject AND d.document_id <> w.document_id AND {_LOW.format("d.name")} = {_LOW.format("w.target")}) THEN 'taken' WHEN target = name THEN 'unchanged' END AS reason FROM w""",
    "move_documents": f"""{_DF}, w AS (SELECT *, 'src' || (document_id % 20) AS to_subject, CASE document_id % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'en' END AS to_folder FROM m_docs WHERE document_id % 5 = 2)
      SELECT document_id, to_subject, to_folder, CASE WHEN to_folder IS NOT NULL AND NOT EXISTS (FROM m_folders f WHERE f.subject = to_subject AND f.folder = to_folder) THEN 'folder'
        WHEN EXISTS (FROM m_docs d WHERE d.subject = to_subject AND d.document_id <> w.document_id AND d.digest = w.digest) THEN 'content' WHEN EXISTS (FROM m_docs d WHERE d.subject = to_subject AND d.document_id <> w.document_id AND d.name = w.name) THEN 'name' END AS reason FROM w""",
    "delete_subjects": f"{_D} SELECT document_id, subject, folder FROM m_docs WHERE NOT starts_with(subject, 'src1')",
    "delete_folders": f"{_D} SELECT document_id, subject, folder FROM m_docs WHERE folder IS NULL OR folder <> 'de'",
    "replace_content": f"""{_D}, w AS (SELECT *, CASE document_id % 3 WHEN 0 THEN digest WHEN 1 THEN sha256('x' || document_id) ELSE sha256('same') END AS new_digest, document_id % 5 AS new_size FROM m_docs WHERE document_id % 4 = 1)
      SELECT document_id, CASE WHEN new_size = 0 THEN 'empty' WHEN new_digest = digest THEN 'unchanged' WHEN EXISTS (FROM m_docs d WHERE d.subject = w.subject AND d.digest = w.new_digest AND d.document_id <> w.document_id) THEN 'duplicate' ELSE 'replaced' END AS state FROM w""",
    "ensure_names": f"""{_DF}, w AS (SELECT DISTINCT trim(CASE WHEN document_id % 5 = 0 THEN ' ' ELSE upper(coalesce(folder, 'new one')) END) AS name FROM m_docs), h AS (SELECT DISTINCT folder FROM m_folders)
      SELECT coalesce(folder, name) AS name, CASE WHEN length(name) = 0 THEN 'invalid' WHEN folder IS NOT NULL THEN 'existing' ELSE 'created' END AS state FROM w LEFT JOIN h ON lower(name) = lower(folder)""",
    "content_provenance": f"{_D} SELECT document_id, (SELECT max(j.document_id) FROM m_docs j WHERE j.document_id % 6 <> 0 AND j.document_id % 4 <> 3 AND j.subject = d.subject AND j.digest = d.digest AND j.size_bytes = d.size_bytes) AS job_id FROM m_docs d",
    "run_matches": f"""{_D}, r AS (SELECT a.document_id AS run_id, a.digest AS x, b.digest AS y FROM m_docs a JOIN m_docs b ON b.document_id = a.document_id + 20 WHERE a.document_id % 3 = 0 AND a.document_id % 5 <> 0)
      SELECT p.subject, p.folder, max(run_id) AS run_id FROM r JOIN m_docs p ON p.digest = x JOIN m_docs q ON q.digest = y AND q.subject = p.subject AND q.folder = p.folder GROUP BY p.subject, p.folder""",
    "related_artifacts": f"""{_D}, n AS (SELECT document_id, subject, folder, trim(regexp_replace(lower(CASE document_id % 17 WHEN 0 THEN 'Week 1 Slides-Extracted.json' WHEN 1 THEN 'slide summaries v' || document_id % 3 || '.json' WHEN 2 THEN 'alignment.json' ELSE name END), '[^a-z0-9]+', '_', 'g')) AS key FROM m_docs),
      t(kind, a, b) AS (VALUES ('slides', 'slides', 'extracted'), ('summaries', 'slide', 'summaries'), ('alignment', 'alignment', ''))
      SELECT n.document_id, kind, (SELECT max(o.document_id) FROM n o WHERE o.subject = n.subject AND o.folder IS NOT DISTINCT FROM n.folder AND contains(o.key, a) AND contains(o.key, b)) AS artifact_id FROM n, t""",
    "sharing_summary": f"""{_D}, s AS (SELECT 'f' || document_id % 700 AS path, size_bytes::BIGINT * 4000 AS n, CASE WHEN document_id % 5 = 0 THEN 'loose' WHEN document_id % 101 = 0 THEN 'generated' ELSE 'library' END AS origin, document_id % 3 = 0 AS tracked FROM m_docs),
      u AS (SELECT n, origin, tracked FROM s UNION ALL SELECT max(n), 'all', bool_or(tracked) FROM s GROUP BY path), z AS (SELECT origin, count(*) AS files, sum(n)::BIGINT AS bytes, count(*) FILTER (n > {LARGE_BYTES}) AS large, count(*) FILTER (n > {BLOCKED_BYTES} AND NOT tracked) AS blocked FROM u GROUP BY origin)
      SELECT *, {_SIZE.format("bytes")} AS label FROM z""",
    "deck_sources": f"""{_D}, n AS (SELECT document_id, {_NAMES} AS name, document_id % 4 <> 0 AS has, document_id % 7 + 1 AS n_pages, document_id % 2 + 1 AS n_slides FROM m_docs)
      SELECT document_id, name, ends_with(name, '.pptx') OR (ends_with(name, '.pdf') AND has AND NOT contains(lower(name), 'notes') AND (contains(name, 'slides') OR document_id % 2 = 0 OR n_pages = n_slides)) AS is_deck FROM n""",
    "request_routes": f"{_D} SELECT document_id, coalesce(regexp_matches({_REQUEST}, '{CHANGE_REQUEST}', 'i'), false) AS is_change FROM m_docs",
    "checked_plans": f"""{_D}, p AS (SELECT {", ".join(_PLAN)} FROM m_docs)
      SELECT plan_id, action, CASE WHEN action = 'erase' THEN 'unknown action' WHEN action IN ('rename_document', 'move_document') AND document_id NOT IN (SELECT document_id FROM m_docs) THEN 'unknown document'
        WHEN action = 'rename_document' AND trim(new_name) = '' THEN 'no new name' WHEN action IN ('move_document', 'list_documents') AND (action = 'move_document' OR target_subject <> '') AND target_subject NOT IN (SELECT subject FROM m_docs) THEN 'unknown subject'
        WHEN action = 'create_subject' AND subject_name = '' THEN 'no subject name' END AS reason FROM p""",
    "share_index": f"""{_D}, r AS (SELECT subject, coalesce(folder, '') AS f, 2 AS kind, lower(name) AS k, '- [' || name || '](' || subject || '/' || name || ') · ' || {_SIZE.format("size_bytes")} AS line FROM m_docs
      UNION ALL SELECT DISTINCT subject, folder, 1, '', '### ' || folder FROM m_docs WHERE folder IS NOT NULL UNION ALL SELECT DISTINCT subject, '', 0, '', '## ' || subject FROM m_docs)
      SELECT row_number() OVER (ORDER BY subject, f, kind, k, line) AS line_number, line FROM r""",
}

# The catalog after the accepted requests.
ORACLES |= {
    "renamed_documents": f"""{_D} SELECT d.document_id, d.subject, coalesce(r.target, d.name) AS name FROM m_docs d LEFT JOIN (SELECT q.document_id, q.target FROM ({ORACLES["rename_documents"]}) q JOIN m_docs m USING (document_id) WHERE reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY m.subject, {_LOW.format("q.target")} ORDER BY q.document_id) = 1) r USING (document_id)""",
    "moved_documents": f"""{_DF}, a AS (SELECT q.*, m.digest, m.name FROM ({ORACLES["move_documents"]}) q JOIN m_docs m USING (document_id) WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY to_subject, m.digest ORDER BY q.document_id) = 1),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY to_subject, name ORDER BY document_id) = 1)
      SELECT document_id, coalesce(to_subject, subject) AS subject, CASE WHEN to_subject IS NULL THEN folder ELSE to_folder END AS folder FROM m_docs LEFT JOIN b USING (document_id)""",
    "replaced_documents": f"""{_D}, r AS (SELECT q.document_id, CASE q.document_id % 3 WHEN 1 THEN sha256('x' || q.document_id) ELSE sha256('same') END AS new_digest FROM ({ORACLES["replace_content"]}) q JOIN m_docs m USING (document_id) WHERE state = 'replaced' QUALIFY row_number() OVER (PARTITION BY m.subject, new_digest ORDER BY q.document_id) = 1)
      SELECT document_id, coalesce(new_digest, digest) AS digest, CASE WHEN new_digest IS NULL THEN size_bytes ELSE document_id % 5 END::BIGINT AS size_bytes FROM m_docs LEFT JOIN r USING (document_id)""",
    "created_names": f"""{_DF} SELECT DISTINCT folder AS name FROM m_folders UNION ALL SELECT name FROM ({ORACLES["ensure_names"]}) WHERE state = 'created'""",
}
