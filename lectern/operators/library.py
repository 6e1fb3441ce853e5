"""#80 to #84: changes of the library across documents, folders, chunks and derived artifacts, as versioned snapshots.

A change takes the library as it is and a table of requests, and gives the library as it will be and a
reason for each request that is refused. `applied` commits what has changed as one version, so that readers see
documents, chunks and artifacts of the same state. Of requests that exclude each other the one with
the smallest id is taken.

Tables: documents (document_id, subject, folder_id, name, stored_path, size_bytes, digest, status), folders
(folder_id, subject, name), chunks (document_id, ordinal, locator, content), artifacts (subject, key,
path, digest), whose key is a folder's id or, for a document in the root, its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.durable import shared_folder, written
from lectern.functions.rules import clean_text, nocase, suffix
from lectern.operators.chunking import LIBRARY, _WS, chunk_cte, library_chunks, text_sections
from lectern.sources.model import cte, query
from lectern.sources.snapshot import Snapshots

TABLES = ("documents", "folders", "chunks", "artifacts")
LONGEST_NAME = 120


@dataclass
class Library:
    documents: DataFrame
    folders: DataFrame
    chunks: DataFrame
    artifacts: DataFrame


def opened(store: Snapshots, version: int | None = None) -> Library:
    """The library as of one version."""
    version = store.latest() if version is None else version
    return Library(*(store.read(t, version) for t in TABLES))


def applied(store: Snapshots, change, *requests: DataFrame) -> DataFrame:
    """Commits what a change makes of the latest version; the decisions on its requests. A library that changed meanwhile is a `Conflict`."""
    version = store.latest()
    before = opened(store, version)
    after, decided = change(before, *requests)
    decided = written(decided)
    store.commit({t: getattr(after, t) for t in TABLES if getattr(after, t) is not getattr(before, t)}, based_on=version, note=store.state(version)["note"])
    return decided


def stored_path() -> Column:
    """Where a document lies: its subject, its folder if it has one, its id and its name."""
    file = F.concat(F.col("document_id").cast("string"), F.lit("_"), "name")
    return F.concat_ws("/", F.lit("subjects"), "subject", F.lit("files"), "folder_id", file)


def _first(rows: DataFrame, keys: list[Column], by: str) -> DataFrame:
    """Of rows that agree in `keys`, the one with the smallest `by`."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    least = rows.groupBy(*named).agg(F.min(by).alias(by))
    return rows.join(least.select(by).distinct(), by, "left_semi")


def _name_reason(name: Column) -> Column:
    return F.when(name == "", "empty").when(F.length(name) > LONGEST_NAME, "too long")


def create_folders(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#80: (subject, name): folder names are cleaned, of 1 to 120 characters, and differ within a subject not only in the case of A-Z."""
    asked = wanted.select("subject", clean_text("name").alias("name")).groupBy("subject", nocase("name").alias("key")).agg(F.min("name").alias("name"))
    have = library.folders.select("subject", nocase("name").alias("key"), F.lit(True).alias("there")).distinct()
    known = library.documents.select("subject").union(library.folders.select("subject")).distinct().withColumn("known", F.lit(True))
    joined = asked.join(have, ["subject", "key"], "left").join(known, "subject", "left")
    reason = F.coalesce(_name_reason(F.col("name")), F.when(F.col("known").isNull(), "unknown subject"), F.when(F.col("there"), "taken"))
    decided = written(joined.select("subject", "name", "key", reason.alias("reason")))
    new_id = F.substring(F.sha2(F.concat_ws("/", "subject", "key"), 256), 1, 12)
    new = decided.filter("reason IS NULL").select(new_id.alias("folder_id"), "subject", "name")
    return replace(library, folders=library.folders.unionByName(new)), decided.drop("key")


def rename_folders(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#81: (folder_id, new_name): files stay where they lie, as paths hold the folder's id."""
    asked = wanted.groupBy("folder_id").agg(F.min(clean_text("new_name")).alias("target")).join(library.folders, "folder_id", "left")
    others = library.folders.select(F.col("subject").alias("_s"), nocase("name").alias("_k"), F.col("folder_id").alias("_f"))
    clash = asked.join(others, (F.col("subject") == F.col("_s")) & (nocase("target") == F.col("_k")) & (F.col("folder_id") != F.col("_f"))).select("folder_id").distinct().withColumn("clash", F.lit(True))
    reason = F.coalesce(F.when(F.col("subject").isNull(), "unknown folder"), _name_reason(F.col("target")), F.when(F.col("clash"), "taken"))
    judged = written(asked.join(clash, "folder_id", "left").select("folder_id", "subject", "target", reason.alias("reason")))
    first = _first(judged.filter("reason IS NULL"), [F.col("subject"), nocase("target")], "folder_id").select("folder_id", F.lit(True).alias("first"))
    decided = judged.join(first, "folder_id", "left").select("folder_id", "target", F.coalesce("reason", F.when(F.col("first").isNull(), "taken")).alias("reason"))
    decided = written(decided)
    new = decided.filter("reason IS NULL").select("folder_id", "target")
    folders = library.folders.join(new, "folder_id", "left").withColumn("name", F.coalesce("target", "name")).drop("target")
    return replace(library, folders=folders), decided


def rename_documents(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#81: (document_id, new_name): the extension stays and is added where it is left out; names are free within the subject; the path follows."""
    asked = wanted.groupBy("document_id").agg(F.min("new_name").alias("new_name")).join(library.documents, "document_id", "left")
    ext, new_ext = suffix(F.col("name")), suffix(F.col("new_name"))
    own = F.regexp_extract("name", r"[^.](\.[^.]+)$", 1)
    asked = asked.withColumn("target", F.when(new_ext == "", F.concat("new_name", own)).otherwise(F.col("new_name")))
    others = library.documents.select(F.col("subject").alias("_s"), nocase("name").alias("_k"), F.col("document_id").alias("_d"))
    clash = asked.join(others, (F.col("subject") == F.col("_s")) & (nocase("target") == F.col("_k")) & (F.col("document_id") != F.col("_d"))).select("document_id").distinct().withColumn("clash", F.lit(True))
    reason = F.when(F.col("subject").isNull(), "unknown document").when(F.trim("new_name") == "", "empty").when((new_ext != "") & (new_ext != ext), "extension").when(F.col("target") == F.col("name"), "unchanged").when(F.col("clash"), "taken")
    judged = written(asked.join(clash, "document_id", "left").select("document_id", "subject", "target", reason.alias("reason")))
    first = _first(judged.filter("reason IS NULL"), [F.col("subject"), nocase("target")], "document_id").select("document_id", F.lit(True).alias("first"))
    decided = written(judged.join(first, "document_id", "left").select("document_id", "target", F.coalesce("reason", F.when(F.col("first").isNull(), "taken")).alias("reason")))
    new = decided.filter("reason IS NULL").select("document_id", "target")
    documents = library.documents.join(new, "document_id", "left").withColumn("name", F.coalesce("target", "name")).drop("target")
    return replace(library, documents=documents.withColumn("stored_path", stored_path())), decided


def _key(document_id: str, folder_id: str) -> Column:
    """Under what a document's artifacts are filed."""
    return F.coalesce(folder_id, F.col(document_id).cast("string"))


def move_documents(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#82: (document_id, to_subject, to_folder_id): into the root of another subject, or into a folder or the root of its own.

    Another subject must not have the content or the name already. Artifacts are copied to the new place
    and stay at the old one for what is left there; where other artifacts lie already, the move is refused.
    """
    asked = wanted.groupBy("document_id").agg(F.min_by(F.struct("to_subject", "to_folder_id"), F.struct("to_subject", "to_folder_id")).alias("to")).select("document_id", "to.*")
    asked = asked.join(library.documents, "document_id", "left").withColumn("to_subject", F.coalesce("to_subject", "subject"))
    away = F.col("to_subject") != F.col("subject")
    subjects = library.documents.select("subject").union(library.folders.select("subject")).distinct().select(F.col("subject").alias("to_subject"), F.lit(True).alias("known"))
    places = library.folders.select(F.col("folder_id").alias("to_folder_id"), F.col("subject").alias("of_subject"))
    there = library.documents.select(F.col("subject").alias("_s"), F.col("digest").alias("_digest"), nocase("name").alias("_k"))
    met = lambda on, name: asked.filter(away).join(there, (F.col("to_subject") == F.col("_s")) & on).select("document_id").distinct().withColumn(name, F.lit(True))
    same, named = met(F.col("digest") == F.col("_digest"), "same"), met(nocase("name") == F.col("_k"), "named")
    own, new = _key("document_id", "folder_id"), _key("document_id", "to_folder_id")
    asked = written(asked.join(subjects, "to_subject", "left").join(places, "to_folder_id", "left").join(same, "document_id", "left").join(named, "document_id", "left").withColumns({"old_key": own, "new_key": new}))

    files = lambda subject, key, at: asked.select("document_id", F.col(subject).alias("subject"), F.col(key).alias("key")).join(library.artifacts, ["subject", "key"]).select("document_id", "path", F.col("digest").alias(at))
    sides = files("subject", "old_key", "a").join(files("to_subject", "new_key", "b"), ["document_id", "path"], "full")
    sides = sides.groupBy("document_id").agg(F.count("a").alias("n_old"), F.count("b").alias("n_new"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))
    differ = (F.col("n_old") > 0) & (F.col("n_new") > 0) & ((F.col("n_old") != F.col("n_same")) | (F.col("n_new") != F.col("n_same")))
    still = (F.col("to_subject") == F.col("subject")) & F.col("to_folder_id").eqNullSafe(F.col("folder_id"))
    reason = (
        F.when(F.col("subject").isNull(), "unknown document").when(still, "unchanged").when(F.col("known").isNull(), "unknown subject")
        .when(F.col("to_folder_id").isNotNull() & ~F.coalesce((F.col("of_subject") == F.col("to_subject")) & ~away, F.lit(False)), "folder").when(F.col("same"), "content").when(F.col("named"), "name").when(differ, "artifacts")
    )
    judged = written(asked.join(sides, "document_id", "left").withColumn("reason", reason).withColumn("copies", (F.coalesce("n_old", F.lit(0)) > 0) & (F.coalesce("n_new", F.lit(0)) == 0)))
    kept = judged.filter("reason IS NULL")
    arriving = kept.filter(away)
    arrived = _first(_first(arriving, [F.col("to_subject"), F.col("digest")], "document_id"), [F.col("to_subject"), nocase("name")], "document_id")
    kept = kept.filter(~away).unionByName(arrived)
    # Into one empty place only the artifacts of one other place are copied.
    leading = kept.filter("copies").groupBy("to_subject", "new_key").agg(F.min_by(F.struct("subject", "old_key"), "document_id").alias("lead"))
    kept = kept.join(leading, ["to_subject", "new_key"], "left").filter(~F.col("copies") | (F.struct("subject", "old_key") == F.col("lead")))
    kept = written(kept.select("document_id", "subject", "old_key", "to_subject", "to_folder_id", "new_key", "copies"))

    taken = kept.select("document_id", F.lit(True).alias("taken"))
    decided = judged.join(taken, "document_id", "left").select("document_id", F.coalesce("reason", F.when(F.col("taken").isNull(), "excluded by another request")).alias("reason"))
    to = kept.select("document_id", F.col("to_subject").alias("_s"), F.col("to_folder_id").alias("_f"))
    moved = library.documents.join(to, "document_id", "left")
    moved = moved.withColumns({"folder_id": F.when(F.col("_s").isNull(), F.col("folder_id")).otherwise(F.col("_f")), "subject": F.coalesce("_s", "subject")}).drop("_s", "_f")
    copied = kept.filter("copies").select(F.col("subject").alias("_s"), F.col("old_key").alias("_k"), "to_subject", "new_key").distinct()
    copied = library.artifacts.join(copied, (F.col("subject") == F.col("_s")) & (F.col("key") == F.col("_k"))).select(F.col("to_subject").alias("subject"), F.col("new_key").alias("key"), "path", "digest")
    return replace(library, documents=moved.withColumn("stored_path", stored_path()), artifacts=library.artifacts.unionByName(copied)), decided


def _without(library: Library, gone: DataFrame) -> Library:
    """The library without the documents `gone`, their chunks, and artifacts whose last source has gone."""
    left = library.documents.join(gone, "document_id", "left_anti")
    lost = library.documents.join(gone, "document_id", "left_semi").select("subject", _key("document_id", "folder_id").alias("key")).distinct()
    lost = lost.join(left.select("subject", _key("document_id", "folder_id").alias("key")).distinct(), ["subject", "key"], "left_anti")
    return replace(library, documents=left, chunks=library.chunks.join(gone, "document_id", "left_anti"), artifacts=library.artifacts.join(lost, ["subject", "key"], "left_anti"))


def delete_documents(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#83: (document_id): chunks go along; a folder's artifacts go with its last document, those of a document in the root with it."""
    known = library.documents.select("document_id", F.lit(True).alias("known"))
    decided = written(wanted.select("document_id").distinct().join(known, "document_id", "left").select("document_id", F.when(F.col("known").isNull(), "unknown document").alias("reason")))
    return _without(library, decided.filter("reason IS NULL").select("document_id")), decided


def delete_folders(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#83: (folder_id, with_content): a folder that holds documents goes only if these are to go along."""
    n = library.documents.groupBy("folder_id").agg(F.count("*").alias("n"))
    asked = wanted.groupBy("folder_id").agg(F.max("with_content").alias("with_content")).join(library.folders, "folder_id", "left").join(n, "folder_id", "left")
    reason = F.when(F.col("subject").isNull(), "unknown folder").when((F.coalesce("n", F.lit(0)) > 0) & ~F.coalesce("with_content", F.lit(False)), "not empty")
    decided = written(asked.select("folder_id", reason.alias("reason")))
    gone = decided.filter("reason IS NULL").select("folder_id")
    after = _without(library, library.documents.join(gone, "folder_id", "left_semi").select("document_id"))
    return replace(after, folders=library.folders.join(gone, "folder_id", "left_anti"), artifacts=after.artifacts.join(gone.withColumnRenamed("folder_id", "key"), "key", "left_anti")), decided


def delete_subjects(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#83: (subject): everything of the subject goes."""
    known = library.documents.select("subject").union(library.folders.select("subject")).distinct().withColumn("known", F.lit(True))
    decided = written(wanted.select("subject").distinct().join(known, "subject", "left").select("subject", F.when(F.col("known").isNull(), "unknown subject").alias("reason")))
    gone = decided.select("subject")
    after = _without(library, library.documents.join(gone, "subject", "left_semi").select("document_id"))
    return replace(after, folders=library.folders.join(gone, "subject", "left_anti"), artifacts=after.artifacts.join(gone, "subject", "left_anti")), decided


def replace_contents(library: Library, wanted: DataFrame) -> tuple[Library, DataFrame]:
    """#84: (document_id, file_name, text): a new text for a document that keeps its id; its chunks are replaced as a set.

    The ending of the file must be the document's, the text not empty, not the one it has, and not another's of the subject.
    """
    text = F.coalesce("text", F.lit(""))
    asked = wanted.withColumns({"new_digest": F.sha2(text, 256), "new_size": F.octet_length(text).cast("long")}).groupBy("document_id").agg(F.min_by(F.struct("file_name", "text", "new_digest", "new_size"), F.struct("file_name", "new_digest")).alias("n")).select("document_id", "n.*")
    asked = written(asked.join(library.documents, "document_id", "left"))
    there = library.documents.select(F.col("subject").alias("_s"), F.col("digest").alias("_digest"), F.col("document_id").alias("_d"))
    twin = asked.join(there, (F.col("subject") == F.col("_s")) & (F.col("new_digest") == F.col("_digest")) & (F.col("document_id") != F.col("_d"))).select("document_id").distinct().withColumn("twin", F.lit(True))
    reason = F.when(F.col("subject").isNull(), "unknown document").when(suffix(F.col("file_name")) != suffix(F.col("name")), "extension").when(F.col("new_size") == 0, "empty").when(F.col("new_digest") == F.col("digest"), "unchanged").when(F.col("twin"), "duplicate")
    judged = written(asked.join(twin, "document_id", "left").select("document_id", "subject", "new_digest", "new_size", "text", reason.alias("reason")))
    first = _first(judged.filter("reason IS NULL").select("document_id", "subject", "new_digest"), [F.col("subject"), F.col("new_digest")], "document_id").select("document_id", F.lit(True).alias("first"))
    decided = written(judged.join(first, "document_id", "left").select("document_id", "new_digest", "new_size", "text", F.coalesce("reason", F.when(F.col("first").isNull(), "duplicate")).alias("reason")))
    done = decided.filter("reason IS NULL")
    chunks = written(library_chunks(text_sections(done.select("document_id", "text"))))
    indexed = chunks.select("document_id").distinct().withColumn("indexed", F.lit(True))
    new = done.select("document_id", "new_digest", "new_size").join(indexed, "document_id", "left")
    documents = library.documents.join(new, "document_id", "left")
    status = F.when(F.col("new_digest").isNull(), F.col("status")).when(F.col("indexed"), "indexed").otherwise("stored")
    documents = documents.withColumns({"digest": F.coalesce("new_digest", "digest"), "size_bytes": F.coalesce("new_size", "size_bytes"), "status": status}).drop("new_digest", "new_size", "indexed")
    kept = library.chunks.join(done.select("document_id"), "document_id", "left_anti")
    return replace(library, documents=documents, chunks=kept.unionByName(chunks.select(*library.chunks.columns))), decided.select("document_id", "reason")


def from_catalog(docs: DataFrame, folders: DataFrame) -> Library:
    """A library of the catalog's documents and folders, with chunks and some artifacts."""
    folder_id = lambda folder: F.when(F.col(folder).isNotNull(), F.concat_ws("-", "subject", folder))
    documents = docs.select("document_id", "subject", folder_id("folder").alias("folder_id"), "name", F.col("size_bytes").cast("long").alias("size_bytes"), "digest", F.lit("indexed").alias("status")).withColumn("stored_path", stored_path())
    made = documents.filter("document_id % 3 = 0").select("subject", _key("document_id", "folder_id").alias("key"), F.concat(F.lit("part"), (F.col("document_id") % 4).cast("string"), F.lit(".json")).alias("path"), "digest")
    artifacts = made.groupBy("subject", "key", "path").agg(F.min("digest").alias("digest"))
    return Library(documents, folders.select(folder_id("folder").alias("folder_id"), "subject", F.col("folder").alias("name")), library_chunks(text_sections(docs)), artifacts)


def _version(change, table: str, *columns: str):
    """Two versions of the library, before and after a change: a table of the second."""

    def run(docs: DataFrame, folders: DataFrame) -> DataFrame:
        spark: SparkSession = docs.sparkSession
        library = from_catalog(docs, folders)
        store = Snapshots(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
        store.commit({t: getattr(library, t) for t in TABLES})
        act, requests = change
        decided = applied(store, act, requests(opened(store)))
        return (decided if table == "decided" else store.read(table)).select(*columns)

    run.__doc__ = change[0].__doc__
    return query(run, "m_docs", "m_folders")


def _asked_folders(lib: Library) -> DataFrame:
    name = F.expr("CASE document_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'EN' WHEN 2 THEN ' Week   1 ' WHEN 3 THEN 'week 1' WHEN 4 THEN repeat('x', 121) ELSE 'other ' || document_id % 3 END")
    return lib.documents.select(F.when(F.col("document_id") % 13 == 0, "nowhere").otherwise(F.col("subject")).alias("subject"), name.alias("name"))


def _asked_folder_names(lib: Library) -> DataFrame:
    name = F.expr("CASE name WHEN 'de' THEN 'FR' WHEN 'fr' THEN ' Fr ' WHEN 'en' THEN 'texts' WHEN 'es' THEN 'Texts' ELSE '' END")
    rows = lib.folders.select("folder_id", name.alias("new_name"))
    return rows.unionByName(rows.filter("folder_id LIKE '%-en'").select(F.concat(F.lit("no "), "folder_id").alias("folder_id"), "new_name"))


def _asked_moves(lib: Library) -> DataFrame:
    d = F.col("document_id")
    to = F.when(d % 4 == 0, F.concat(F.lit("src"), (d % 23).cast("string")))
    folder = F.when(d % 4 == 1, F.concat_ws("-", "subject", F.lit("de"))).when(d % 4 == 2, F.concat(F.lit("src"), (d % 20).cast("string"), F.lit("-empty")))
    return lib.documents.filter(d % 3 <= 1).select("document_id", to.alias("to_subject"), folder.alias("to_folder_id"))


def _asked_deletions(lib: Library) -> DataFrame:
    return lib.documents.filter("folder_id LIKE '%-es' OR folder_id IS NULL AND document_id % 2 = 0 OR document_id % 5 = 0").select("document_id")


def _asked_contents(lib: Library) -> DataFrame:
    d = F.col("document_id")
    text = F.when(d % 4 == 0, F.lit(None)).when(d % 4 == 1, F.concat(F.lit("A new text. "), d.cast("string"))).when(d % 4 == 2, F.lit(" ")).otherwise(F.concat(F.repeat(F.lit("many words of one text "), 90), F.lit("in "), "subject"))
    return lib.documents.filter(d % 3 == 1).select("document_id", F.when(d % 5 == 0, "a.pdf").otherwise("b.TXT").alias("file_name"), text.alias("text"))


def _gone_folders(lib: Library) -> DataFrame:
    return lib.folders.filter("name IN ('de', 'fr', 'empty')").select("folder_id", (F.col("name") == "de").alias("with_content"))


_CREATE, _RENAME, _MOVE, _DELETE = (create_folders, _asked_folders), (rename_folders, _asked_folder_names), (move_documents, _asked_moves), (delete_documents, _asked_deletions)
_REPLACE, _FOLDERS = (replace_contents, _asked_contents), (delete_folders, _gone_folders)
_NAMES = (rename_documents, lambda lib: lib.documents.filter("document_id % 3 = 1").select("document_id", F.expr("CASE document_id % 4 WHEN 0 THEN 'DOC_' || (document_id + 20) || '.txt' WHEN 1 THEN 'fresh' || document_id % 10 WHEN 2 THEN 'x.pdf' ELSE name END").alias("new_name")))

QUERIES = {
    "library_created_folders": _version(_CREATE, "folders", "subject", "name"),
    "library_folder_creations": _version(_CREATE, "decided", "subject", "name", "reason"),
    "library_renamed_folders": _version(_RENAME, "folders", "folder_id", "name"),
    "library_folder_renames": _version(_RENAME, "decided", "folder_id", "target", "reason"),
    "library_renamed_paths": _version(_NAMES, "documents", "document_id", "name", "stored_path"),
    "library_moves": _version(_MOVE, "decided", "document_id", "reason"),
    "library_moved_paths": _version(_MOVE, "documents", "document_id", "subject", "folder_id", "stored_path"),
    "library_moved_artifacts": _version(_MOVE, "artifacts", "subject", "key", "path", "digest"),
    "library_artifacts_left": _version(_DELETE, "artifacts", "subject", "key", "path"),
    "library_chunks_left": _version(_FOLDERS, "chunks", "document_id", "ordinal"),
    "library_folders_left": _version(_FOLDERS, "folders", "folder_id"),
    "library_replaced_chunks": _version(_REPLACE, "chunks", "document_id", "ordinal", "locator", "content"),
    "library_replaced_documents": _version(_REPLACE, "documents", "document_id", "digest", "size_bytes", "status"),
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE = f"""{cte("m_docs", "m_folders")}, doc AS (SELECT document_id, subject, CASE WHEN folder IS NOT NULL THEN subject || '-' || folder END AS folder_id, name, size_bytes, digest, coalesce(subject || '-' || folder, document_id::VARCHAR) AS key FROM m_docs),
  fo AS (SELECT subject || '-' || folder AS folder_id, subject, folder AS name FROM m_folders),
  ar AS (SELECT subject, key, 'part' || document_id % 4 || '.json' AS path, min(digest) AS digest FROM doc WHERE document_id % 3 = 0 GROUP BY ALL)"""
_PATH = "concat_ws('/', 'subjects', subject, 'files', folder_id, document_id || '_' || name)"
_SQL_CREATE = f"""{_BASE}, w AS (SELECT subject, {_LOW.format("name")} AS key, min(name) AS name FROM (SELECT CASE WHEN document_id % 13 = 0 THEN 'nowhere' ELSE subject END AS subject,
    CASE document_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'EN' WHEN 2 THEN 'Week 1' WHEN 3 THEN 'week 1' WHEN 4 THEN repeat('x', 121) ELSE 'other ' || document_id % 3 END AS name FROM doc) GROUP BY 1, 2),
  de AS (SELECT subject, name, CASE WHEN name = '' THEN 'empty' WHEN length(name) > 120 THEN 'too long' WHEN subject = 'nowhere' THEN 'unknown subject' WHEN EXISTS (FROM fo WHERE fo.subject = w.subject AND {_LOW.format("fo.name")} = w.key) THEN 'taken' END AS reason FROM w)"""
_SQL_RENAME = f"""{_BASE}, w AS (SELECT folder_id, subject, trim(CASE name WHEN 'de' THEN 'FR' WHEN 'fr' THEN 'Fr' WHEN 'en' THEN 'texts' WHEN 'es' THEN 'Texts' ELSE '' END) AS target FROM fo),
  j AS (SELECT *, CASE WHEN target = '' THEN 'empty' WHEN EXISTS (FROM fo o WHERE o.subject = w.subject AND lower(o.name) = lower(target) AND o.folder_id <> w.folder_id) THEN 'taken' END AS r FROM w),
  de AS (SELECT folder_id, target, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY subject, r IS NULL, lower(target) ORDER BY folder_id) > 1 THEN 'taken' END) AS reason FROM j UNION ALL SELECT 'no ' || folder_id, 'texts', 'unknown folder' FROM fo WHERE name = 'en')"""
_SQL_NAMES = f"""{_BASE}, w AS (SELECT *, CASE document_id % 4 WHEN 0 THEN 'DOC_' || (document_id + 20) || '.txt' WHEN 1 THEN 'fresh' || document_id % 10 || '.txt' WHEN 2 THEN 'x.pdf' ELSE name END AS target FROM doc WHERE document_id % 3 = 1),
  j AS (SELECT * FROM w WHERE NOT ends_with(target, '.pdf') AND target <> name AND NOT EXISTS (FROM doc o WHERE o.subject = w.subject AND o.document_id <> w.document_id AND {_LOW.format("o.name")} = {_LOW.format("w.target")})),
  n AS (SELECT document_id, target FROM j QUALIFY row_number() OVER (PARTITION BY subject, {_LOW.format("target")} ORDER BY document_id) = 1)"""
_SQL_MOVE = f"""{_BASE}, w0 AS (SELECT *, CASE WHEN document_id % 4 = 0 THEN 'src' || document_id % 23 ELSE subject END AS to_subject, CASE document_id % 4 WHEN 1 THEN subject || '-de' WHEN 2 THEN 'src' || document_id % 20 || '-empty' END AS to_folder FROM doc WHERE document_id % 3 <= 1),
  w AS (SELECT *, coalesce(to_folder, document_id::VARCHAR) AS new_key, to_subject <> subject AS away FROM w0), fs AS (SELECT subject, key, list(path || digest ORDER BY path) AS files FROM ar GROUP BY ALL),
  j AS (SELECT w.*, a.files AS old_files, b.files AS new_files, CASE WHEN NOT away AND to_folder IS NOT DISTINCT FROM folder_id THEN 'unchanged' WHEN to_subject NOT IN (SELECT subject FROM doc) THEN 'unknown subject'
      WHEN to_folder IS NOT NULL AND (away OR NOT EXISTS (FROM fo WHERE fo.folder_id = to_folder AND fo.subject = to_subject)) THEN 'folder' WHEN away AND EXISTS (FROM doc o WHERE o.subject = to_subject AND o.digest = w.digest) THEN 'content'
      WHEN away AND EXISTS (FROM doc o WHERE o.subject = to_subject AND {_LOW.format("o.name")} = {_LOW.format("w.name")}) THEN 'name' WHEN a.files <> b.files THEN 'artifacts' END AS reason
    FROM w LEFT JOIN fs a ON a.subject = w.subject AND a.key = w.key LEFT JOIN fs b ON b.subject = to_subject AND b.key = new_key),
  k1 AS (SELECT * FROM j WHERE reason IS NULL AND away QUALIFY row_number() OVER (PARTITION BY to_subject, digest ORDER BY document_id) = 1), k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY to_subject, {_LOW.format("name")} ORDER BY document_id) = 1),
  k3 AS (SELECT *, old_files IS NOT NULL AND new_files IS NULL AS copies FROM (FROM k2 UNION ALL FROM j WHERE reason IS NULL AND NOT away)),
  k AS (SELECT * FROM (SELECT *, first_value((subject, key)) OVER (PARTITION BY to_subject, new_key, copies ORDER BY document_id) AS lead FROM k3) WHERE NOT copies OR (subject, key) = lead)"""
_SQL_CONTENT = f"""{cte("m_docs", "m_folders")}, w AS (SELECT document_id, subject, digest, size_bytes, CASE document_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'A new text. ' || document_id WHEN 2 THEN ' ' ELSE repeat('many words of one text ', 90) || 'in ' || subject END AS text FROM m_docs WHERE document_id % 3 = 1 AND document_id % 5 <> 0),
  j AS (SELECT *, sha256(text) AS new_digest FROM w WHERE text <> '' AND sha256(text) <> digest AND NOT EXISTS (FROM m_docs o WHERE o.subject = w.subject AND o.digest = sha256(w.text) AND o.document_id <> w.document_id)),
  n AS (SELECT document_id, text, new_digest, strlen(text) AS new_size FROM j QUALIFY row_number() OVER (PARTITION BY subject, new_digest ORDER BY document_id) = 1)"""

ORACLES = {
    "library_created_folders": f"{_SQL_CREATE} SELECT subject, name FROM fo UNION ALL SELECT subject, name FROM de WHERE reason IS NULL",
    "library_folder_creations": f"{_SQL_CREATE} SELECT * FROM de",
    "library_renamed_folders": f"{_SQL_RENAME} SELECT folder_id, coalesce(target, name) AS name FROM fo LEFT JOIN (SELECT folder_id, target FROM de WHERE reason IS NULL) USING (folder_id)",
    "library_folder_renames": f"{_SQL_RENAME} SELECT * FROM de",
    "library_renamed_paths": f"{_SQL_NAMES} SELECT document_id, name, {_PATH} AS stored_path FROM (SELECT document_id, subject, folder_id, coalesce(target, name) AS name FROM doc LEFT JOIN n USING (document_id))",
    "library_moves": f"{_SQL_MOVE} SELECT document_id, coalesce(reason, CASE WHEN document_id NOT IN (SELECT document_id FROM k) THEN 'excluded by another request' END) AS reason FROM j",
    "library_moved_paths": f"""{_SQL_MOVE} SELECT document_id, subject, folder_id, {_PATH} AS stored_path FROM (SELECT document_id, name, coalesce(k.to_subject, doc.subject) AS subject, CASE WHEN k.to_subject IS NULL THEN doc.folder_id ELSE k.to_folder END AS folder_id
      FROM doc LEFT JOIN (SELECT document_id, to_subject, to_folder FROM k) k USING (document_id))""",
    "library_moved_artifacts": f"{_SQL_MOVE} SELECT subject, key, path, digest FROM ar UNION ALL SELECT to_subject, new_key, path, ar.digest FROM (SELECT DISTINCT subject, key, to_subject, new_key FROM k WHERE copies) c JOIN ar USING (subject, key)",
    "library_chunks_left": f"{_BASE}, src AS (SELECT document_id, {_WS.format('text')} AS t FROM m_docs WHERE folder IS NULL OR folder <> 'de'), {chunk_cte('src', 'document_id', *LIBRARY)} SELECT document_id, piece AS ordinal FROM ck",
    "library_folders_left": f"{_BASE} SELECT folder_id FROM fo WHERE name NOT IN ('de', 'empty') AND (name <> 'fr' OR folder_id IN (SELECT folder_id FROM doc WHERE folder_id IS NOT NULL))",
    "library_replaced_chunks": f"""{_SQL_CONTENT}, src AS (SELECT document_id, {_WS.format('text')} AS t FROM (SELECT document_id, coalesce(n.text, m_docs.text) AS text FROM m_docs LEFT JOIN n USING (document_id))), {chunk_cte('src', 'document_id', *LIBRARY)}
      SELECT document_id, piece AS ordinal, 'Text' || CASE WHEN pieces > 1 THEN ' · part ' || piece ELSE '' END AS locator, content FROM ck""",
    "library_replaced_documents": f"""{_SQL_CONTENT} SELECT document_id, coalesce(new_digest, digest) AS digest, coalesce(new_size, size_bytes)::BIGINT AS size_bytes, CASE WHEN trim(n.text) = '' THEN 'stored' ELSE 'indexed' END AS status FROM m_docs LEFT JOIN n USING (document_id)""",
    "library_artifacts_left": f"""{_BASE}, le AS (SELECT * FROM doc WHERE NOT (coalesce(folder_id LIKE '%-es', false) OR (folder_id IS NULL AND document_id % 2 = 0) OR document_id % 5 = 0))
      SELECT subject, key, path FROM ar WHERE EXISTS (FROM le WHERE le.subject = ar.subject AND le.key = ar.key) OR NOT EXISTS (FROM doc WHERE doc.subject = ar.subject AND doc.key = ar.key)""",
}
