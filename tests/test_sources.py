"""Files, artifacts and versioned tables."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import library
from lectern.sources import artifacts
from lectern.sources.model import frame
from lectern.sources.snapshot import Conflict, Snapshots
from tests.conftest import SF


def test_text_corpus(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "a.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "c" / "d" / "b.md").write_text(" \n\t\n")
    (tmp_path / "c" / "d" / "x.bin").write_text("no")
    got = artifacts.text_corpus(spark, str(tmp_path / "c")).collect()
    assert [(r.name, r.text) for r in got] == [("a.TXT", "caf\ufffd")]


def test_artifacts_on_disk(spark, tmp_path):
    at = tmp_path / "art" / "maths 1" / "week1"
    at.mkdir(parents=True)
    (at / "slides.json").write_text('{"slides": [{"slide": 1, "title": "A", "images": ["p"], "visual_text": ["x"]}, 5, {"slide": "x"}, {"slide": "02", "title": null}]}')
    (at / "slide_summaries.json").write_text('[{"slide": 1, "summary": "s", "sources": {"slide": true}}, {"slide": 2, "summary": "t", "sources": "none"}]')
    (at / "alignment.json").write_text('{"slides": [{"slide": 1, "paragraphs": [{"text": "a", "start_time": "00:01", "alignment": {"method": "semantic", "confidence": 0.5}}, 7, {"text": "b"}]}]}')
    (at / "transcript.json").write_text('{"segments": [{"id": 4, "start": 0, "end": 1.5, "text": "hi"}, {"text": " "}], "paragraphs": [{"text": "hi all"}]}')
    (tmp_path / "art" / "maths 1" / "bad").mkdir()
    (tmp_path / "art" / "maths 1" / "bad" / "slides.json").write_text("[{")
    files = lambda kind: artifacts.artifact_files(spark, str(tmp_path / "art"), kind)
    slides = artifacts.read_slides(files("slides"))
    assert sorted((r.subject, r.lecture, r.slide, r.title, r.visual_text) for r in slides.collect()) == [("maths 1", "week1", 1, "A", ["x"]), ("maths 1", "week1", 2, "", [])]
    summaries = artifacts.read_summaries(files("summaries"))
    assert sorted((r.slide, r.summary, r.slide_source, r.audio_source) for r in summaries.collect()) == [(1, "s", True, None), (2, "t", None, None)]
    alignment = artifacts.read_alignment(files("alignment"))
    assert sorted((r.slide, r.place, r.text, r.method, r.confidence) for r in alignment.collect()) == [(1, 0, "a", "semantic", 0.5), (1, 2, "b", "unknown", 0.0)]
    transcript = artifacts.read_transcript(files("transcript"))
    assert [(r.id, r.start, r.end, r.text) for r in transcript.collect()] == [(4, 0.0, 1.5, "hi")]
    assert [(r.id, r.text) for r in artifacts.read_transcript(files("paragraphs"), "paragraphs").collect()] == [(1, "hi all")]
    assert sorted((r.lecture, r.item, r.reason) for r in artifacts.rejected_items(files("slides"), "slides").collect() if r.item is not None) == [("week1", 1, "no object"), ("week1", 2, "no slide number")]
    assert [(r.lecture, r.reason) for r in artifacts.rejected_items(files("slides"), "slides").filter("item IS NULL").collect()] == [("bad", "not JSON")]
    assert [(r.item, r.reason) for r in artifacts.rejected_items(files("transcript"), "transcript").collect()] == [(1, "no text")]

    for kind, rows, read in (("slides", slides, artifacts.read_slides), ("summaries", summaries, artifacts.read_summaries), ("alignment", alignment, artifacts.read_alignment), ("transcript", transcript, artifacts.read_transcript)):
        artifacts.export_artifacts(rows, kind, str(tmp_path / "export"))
        again = read(artifacts.exported_files(spark, str(tmp_path / "export"), kind))
        gone = {"slides": ["images", "preview_image"], "alignment": ["place"]}.get(kind, [])
        assert sorted(map(str, again.drop(*gone).collect())) == sorted(map(str, rows.drop(*gone).collect()))


def test_lines_are_written_in_order(spark, tmp_path):
    lines = spark.range(1, 1001).select(F.col("id").alias("n"), F.concat(F.lit("line "), "id").alias("line")).repartition(7)
    artifacts.write_lines(lines, "n", "line", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == [f"line {i}" for i in range(1, 1001)]


def test_readers_stay_on_their_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "id long, t string")
    assert store.latest() == 0
    assert store.commit({"x": one, "y": one}) == 1
    old = store.read("x")
    assert store.commit({"x": one.withColumn("id", F.col("id") + 1)}, note={"n": 5}) == 2
    assert [r.id for r in old.collect()] == [1]
    assert [r.id for r in store.read("x").collect()] == [2]
    assert [r.id for r in store.read("x", 1).collect()] == [1]
    assert store.state()["note"] == {"n": 5} and store.state(1)["note"] == {}
    assert [r.id for r in store.read("y").collect()] == [1]
    with pytest.raises(Conflict):
        store.commit({"x": one}, based_on=1)
    with pytest.raises(KeyError):
        store.read("z")


def test_of_two_writers_one_fails_and_its_data_are_swept(spark, tmp_path, monkeypatch):
    store, other = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "id long, t string")
    store.commit({"x": one})
    publish = other._publish

    def late(state):
        store.commit({"x": one.withColumn("id", F.lit(7).cast("long"))})
        publish(state)

    monkeypatch.setattr(other, "_publish", late)
    with pytest.raises(Conflict):
        other.commit({"x": one})
    assert [r.id for r in store.read("x").collect()] == [7]
    assert store.vacuum() == 2
    assert store.versions() == [2]
    assert [r.id for r in store.read("x").collect()] == [7]


def test_a_failed_change_leaves_the_library_as_it_was(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    lib = library.from_catalog(frame(spark, SF, "m_docs").filter("document_id < 40"), frame(spark, SF, "m_folders"))
    store.commit({t: getattr(lib, t) for t in library.TABLES})
    before = store.read("documents").count()

    def broken(now, wanted):
        after, decided = library.delete_documents(now, wanted)
        after.chunks = after.chunks.withColumn("content", F.raise_error(F.lit("no")))
        return after, decided

    wanted = store.read("documents").select("document_id")
    with pytest.raises(Exception, match="no"):
        library.applied(store, broken, wanted)
    assert (store.latest(), store.read("documents").count()) == (1, before)
    library.applied(store, library.delete_documents, wanted)
    assert store.latest() == 2
    assert store.read("documents").count() == store.read("chunks").count() == 0
    assert store.read("documents", 1).count() == before


def test_unknown_ids_are_refused(spark, tmp_path):
    lib = library.from_catalog(frame(spark, SF, "m_docs").filter("document_id < 20"), frame(spark, SF, "m_folders"))
    wanted = spark.createDataFrame([(-5, None, None)], "document_id long, to_subject string, to_folder_id string")
    assert [r.reason for r in library.move_documents(lib, wanted)[1].collect()] == ["unknown document"]
    assert [r.reason for r in library.delete_documents(lib, wanted)[1].collect()] == ["unknown document"]
    named = wanted.select("document_id", F.lit("x").alias("new_name"))
    assert [r.reason for r in library.rename_documents(lib, named)[1].collect()] == ["unknown document"]
    texts = wanted.select("document_id", F.lit("a.txt").alias("file_name"), F.lit("x").alias("text"))
    assert [r.reason for r in library.replace_contents(lib, texts)[1].collect()] == ["unknown document"]
    gone = spark.createDataFrame([("nowhere", True)], "subject string, with_content boolean")
    assert [r.reason for r in library.delete_subjects(lib, gone)[1].collect()] == ["unknown subject"]
    assert [r.reason for r in library.delete_folders(lib, gone.withColumnRenamed("subject", "folder_id"))[1].collect()] == ["unknown folder"]
