"""Literal cases: boundaries, odd characters, ties and empty inputs."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.rules import byte_size, clean_text, clock, cosine, nocase, words_within
from lectern.operators import align, catalog, chunking, jobs, models, notes, search, textjobs, transcript
from lectern.sources.model import frame
from tests.compare import same
from tests.conftest import SF


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(("seconds", "text"), [(-3.0, "00:00:00"), (0.5, "00:00:00"), (1.5, "00:00:02"), (3661.0, "01:01:01"), (360000.0, "100:00:00")])
def test_clock(spark, seconds, text):
    assert one(spark, clock(F.col("s")), s=seconds) == text


def test_column_rules(spark):
    assert one(spark, clean_text("t"), t=" a \x1c\tb　") == "a b"
    assert one(spark, nocase("t"), t="ÀBc") == "Àbc"
    assert one(spark, byte_size(F.col("n")), n=1023) == "1023 B"
    assert one(spark, byte_size(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, words_within(F.col("t"), 2), t="a b, c") == "a b…"
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0.0


def test_chunks_stay_within_their_size_and_overlap(spark):
    text = " ".join(f"word{i}" for i in range(500))
    rows = chunking.chunked(spark.createDataFrame([(1, text), (2, " "), (3, "x" * 950), (4, None), (5, "y" * 300)], "id int, text string"), 300, 50).orderBy("id", "piece").collect()
    first = [r.content for r in rows if r.id == 1]
    assert len(first) > 3
    assert all(1 <= len(c) <= 300 for c in first)
    assert {r.id for r in rows} == {1, 3, 5}
    assert [len(r.content) for r in rows if r.id == 3] == [300, 300, 300, 200]
    assert [r.pieces for r in rows if r.id == 5] == [1]


def test_packing_boundaries(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 60), (1, 2, "b" * 60), (1, 3, "c" * 60), (1, 4, "d" * 200)], "lecture long, segment long, text string")
    got = {(r.segment, r.batch) for r in chunking.block_batches(rows, 125).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, -1)}


def test_media_plan_of_two_hours(spark):
    plan = transcript.media_plan(spark.createDataFrame([(1, 7_200_000), (2, 0)], "lecture long, duration_ms long"), 1_800_000, 15_000).orderBy("chunk").collect()
    assert len(plan) == 4
    assert (plan[1].extract_start, plan[1].extract_end) == (1_785_000, 3_615_000)


def test_paragraph_gap_is_strict(spark):
    rows = [(1, 1, 0, 1000, "a"), (1, 2, 3750, 4000, "b"), (1, 3, 6751, 7000, "c")]
    got = transcript.paragraphs(spark.createDataFrame(rows, "lecture long, segment long, start_ms long, end_ms long, text string")).orderBy("paragraph").collect()
    assert [r.text for r in got] == ["a b", "c"]


def test_cues_fall_back_to_the_latest(spark):
    cues = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 2000, 70_000)], "lecture long, segment long, start_ms long, end_ms long")
    times = spark.createDataFrame([(1, 400), (1, 900), (1, 65_000), (1, 99_000)], "lecture long, t_ms long")
    assert {(r.t_ms, r.segment) for r in transcript.cues_at(times, cues).collect()} == {(400, 1), (900, 1), (65_000, 2), (99_000, 2)}


def test_alignment_never_jumps_back_without_reference(spark):
    deck = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "lecture long, slide int, vector array<double>")
    p = [(1, 0, [1.0, 0.0], 0.0, 5.0, ""), (1, 1, [0.0, 1.0], 10.0, 15.0, ""), (1, 2, [1.0, 0.0], 20.0, 25.0, ""), (1, 3, [0.0, 1.0], 30.0, 35.0, "")]
    shape = "lecture long, paragraph long, vector array<double>, start_s double, end_s double, text string"
    got = [r.slide for r in align.aligned(spark.createDataFrame(p, shape), deck).orderBy("paragraph").collect()]
    assert got == sorted(got)
    named = [(1, 0, [1.0, 0.0], 0.0, 5.0, "see slide 2"), (1, 1, [0.0, 1.0], 10.0, 15.0, "back on slide number 1")]
    got = align.aligned(spark.createDataFrame(named, shape), deck).orderBy("paragraph").collect()
    assert [(r.slide, r.method, r.confidence) for r in got] == [(2, "spoken_reference", 1.0), (1, "spoken_reference", 1.0)]


def test_internal_names(spark):
    names = ["a_transcript.json", "talk.txt", "x alignment.pdf", "notes.fr.md", "slide_2.de.pdf", "q_notes.md", "notes.txt"]
    got = spark.createDataFrame([(n,) for n in names], ["name"]).select("name", catalog.is_internal(F.col("name")).alias("x")).collect()
    assert {r.name for r in got if r.x} == {"a_transcript.json", "x alignment.pdf", "notes.fr.md", "slide_2.de.pdf", "q_notes.md"}


def test_search_ranks_and_finds_by_name(spark):
    docs = spark.createDataFrame([(1, "maths", "graphs.txt"), (2, "law", "empty_graphs.bin"), (3, "law", "other.txt")], "document_id long, subject string, name string")
    chunks = spark.createDataFrame([(1, 1, "Text", "Graphs and graphs"), (3, 1, "Text", "nothing")], "document_id long, ordinal int, locator string, content string")
    q = spark.createDataFrame([(1, "what are graphs"), (2, "the what")], "question_id long, question string")
    got = search.ranked_search(q, search.indexed(chunks, docs)).orderBy("question_id", "place").collect()
    assert [(r.question_id, r.document_id, r.locator) for r in got][:2] == [(1, 1, "Text"), (1, 2, "Stored file")]
    assert got[0].score == 4.5


def test_chat_terms_of_chinese(spark):
    q = spark.createDataFrame([(1, "What is 线性代数 for x1")], "question_id long, question string")
    assert search.chat_terms(q).first().terms == ["x1", "线性代数", "线性", "性代", "代数"]


def test_failing_items_become_rows(spark):
    seen = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ok", "has 7", "fine"])], "lecture long, segment long, text string")
    got = {r.id: (r.text, r.error) for r in models.transformed(models.item_batches(seen, 3), models._lower_unless_marked).collect()}
    assert got == {0: ("ok", None), 1: (None, "ValueError: marked"), 2: ("fine", None)}


def test_overview_covers_the_lecture(spark):
    rows = [(1, i, f"alpha beta topic{i} and more words") for i in range(6)] + [(2, 1, "Slide 3."), (2, 2, "short")]
    titles = spark.createDataFrame([(1, " Lecture\tone"), (2, "Lecture two")], "lecture long, lecture_title string")
    got = {r.lecture: r.overview for r in notes.extractive_overview(spark.createDataFrame(rows, "lecture long, slide long, note string"), titles).collect()}
    assert got[1].startswith(f"# Lecture one — General Summary\n\n{notes.INTRODUCTION}\n\n")
    assert got[1].count("topic") == 4 and got[2] is None


def test_overview_equals_a_count_of_all_choices(spark):
    random = np.random.default_rng(5)
    names = [f"term{k}" for k in range(60)]
    rows = [(k, i, " ".join(" ".join(random.choice(names, random.integers(2, 9))) + " said." for _ in range(random.integers(1, 4)))) for k in range(1, 75, 6) for i in range(k)]
    noted = spark.createDataFrame(rows, "lecture long, slide long, note string")
    titles = noted.select("lecture", F.lit("t").alias("lecture_title")).distinct()
    got = {r.lecture: r.overview for r in notes.extractive_overview(noted, titles).collect()}
    for lecture, text in got.items():
        own = [(i, j, s) for k, i, note in rows if k == lecture for j, s in enumerate(re.split(r"(?<=\.) ", note))]
        stretches, total = min(4, lecture), min(12, max(5, -(-lecture // 8)))
        used, chosen = set(), []
        for stretch in range(stretches):
            inside = [x for x in own if stretch * lecture // stretches <= x[0] < (stretch + 1) * lecture // stretches]
            for _ in range(total // stretches + (stretch < total % stretches)):
                if inside:
                    best = min(inside, key=lambda x: (len(x[2]) - 1000 * len(set(re.findall(r"\w{3,}", x[2])) - used), x[0], x[1]))
                    inside.remove(best)
                    chosen.append(best)
                    used |= set(re.findall(r"\w{3,}", best[2]))
        said = [x[2] for x in sorted(chosen, key=lambda x: x[0])]
        size = max(2, -(-len(said) // 4))
        assert text.rstrip("\n").split("\n\n")[2:] == [" ".join(said[at : at + size]) for at in range(0, len(said), size)]


def test_digest_that_does_not_shrink_is_an_error(spark):
    rows = spark.createDataFrame([(1, i, "word " * 200) for i in range(30)], "lecture long, slide long, note string")
    kept, slow = lambda text, most: text, lambda text, most: text[:-1]
    assert tuple(notes.digest_rounds(rows, 12_000, 9_000, 4_000, reduce=kept).first())[1:] == (None, "not reduced")
    assert tuple(notes.digest_rounds(rows, 12_000, 9_000, 4_000, reduce=slow).first())[1:] == (None, "too long after the last round")


def test_digest_shrinks(spark):
    rows = spark.createDataFrame([(1, i, "word " * 200) for i in range(30)], "lecture long, slide long, note string")
    assert len(notes.digest_rounds(rows, 12_000, 9_000, 4_000).first().digest) <= 12_000


def test_digest_reads_all_of_each_pack(spark):
    filler = "The same words come again and again. " * 600
    long = filler + "Eigenvalues decide stability. "
    rows = spark.createDataFrame([(1, 0, long), (1, 1, filler + "Zebras graze."), (2, 0, "short")], "lecture long, slide long, note string")
    got = {r.lecture: r.digest for r in notes.digest_rounds(rows, 12_000, 9_000, 4_000).collect()}
    assert "Eigenvalues decide stability." in got[1] and "Zebras graze." in got[1]
    assert len(got[1]) <= 12_000 and got[2] == "short"
    assert notes._telling("x" * 5000 + " last", 4_000).endswith(" last")
    assert len(notes._telling(" ".join(f"word{i}" for i in range(5000)), 4_000)) <= 4_000


@pytest.mark.parametrize("name", ["overview_sentences", "extractive_overview", "evidence_reduction", "hierarchical_digest"])
def test_lectures_do_not_grow_with_the_table(spark, tmp_path, name):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'A sentence about topic ' || id || '.' AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = notes.QUERIES[name](spark, str(tmp_path)).select("lecture").distinct().count()
    assert got == 2000 // notes.DOCS_PER_LECTURE


def test_lineage_of_long_chains_cycles_and_unknown_sources(spark):
    chain = [(i, i - 1 if i else None, None if i else "root") for i in range(3000)]
    odd = [(5000, 5001, None), (5001, 5000, None), (5002, 5002, None), (5003, 9999, None), (5004, 5000, "own"), (5005, 5004, None), (5006, None, None), (5007, 5001, None)]
    got = {r.job_id: (r.subject, r.steps) for r in jobs.lineage(spark.createDataFrame(chain + odd, "job_id long, source_job_id long, subject string")).collect()}
    assert len(got) == 3008
    assert all(got[i] == ("root", i) for i in range(3000))
    assert got[5004] == ("own", 0)
    assert got[5005] == ("own", 1)
    assert all(got[i] == (None, None) for i in (5000, 5001, 5002, 5003, 5006, 5007))
    assert jobs.lineage(spark.createDataFrame([], "job_id long, source_job_id long, subject string")).count() == 0


def test_requests_and_plans(spark):
    asked = {"please  move it": True, "LIST": True, "listing": False, "show my files": True, "create subject": True, "Change the file name": True, "Please tell me": False, "how to rename": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in asked], "t string").select("t", catalog.is_change_request(F.col("t")).alias("is_change")).collect()
    assert {r.t: r.is_change for r in rows} == asked
    docs = spark.createDataFrame([(1, "a")], "document_id long, subject string")
    plans = [
        (1, "rename_document", 1, "x", None, None, None),
        (2, "rename_document", 1, " ", None, None, "no new name"),
        (3, "rename_document", 2, " ", None, None, "unknown document"),
        (4, "move_document", 1, None, "b", None, "unknown subject"),
        (5, "move_document", 1, None, " a ", None, None),
        (6, "list_documents", None, None, "", None, None),
        (7, "list_documents", None, None, "b", None, "unknown subject"),
        (8, "create_subject", None, None, None, None, "no subject name"),
        (9, "create_subject", None, None, None, "n", None),
        (10, None, None, None, None, None, "unknown action"),
        (11, "answer", None, None, None, None, None),
    ]
    table = spark.createDataFrame([p[:6] for p in plans], "plan_id long, action string, document_id long, new_name string, target_subject string, subject_name string")
    assert {r.plan_id: r.reason for r in catalog.checked_plans(table, docs, docs).collect()} == {p[0]: p[6] for p in plans}


def test_translation_of_whole_documents(spark):
    def model(items):
        if any("fail" in t for _, t in items):
            raise ValueError("no answer")
        return {i: "" if "void" in t else t.replace("#", "") if "flat" in t else t * 4 if "long" in t else t.upper() for i, t in items}

    texts = {1: "# one\n\n" + "b" * 40 + "\n\n- c", 2: "a fail", 3: "ok\n\n# flat " + "x" * 40, 4: "void", 5: " \n ", 6: None, 7: "long", 8: "# void " + "y" * 40 + "\n\n fail"}
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    got = {r.document_id: (r.text, r.reason) for r in textjobs.translated_documents(docs, model, 50).collect()}
    assert got[1] == ("# ONE\n\n" + "B" * 40 + "\n\n- C\n", None)
    assert {k: r for k, (t, r) in got.items() if k > 1 and t is None} == {2: "model", 3: "structure", 4: "empty", 5: "nothing to translate", 6: "nothing to translate", 7: "length", 8: "empty"}


def test_translated_sections_keep_headings_and_repeats_void(spark):
    texts = {1: "x\n##  Slide 1: A\nbody\n\n## Slide 2\n\n## other\nz\n## 第3页\nc", 2: "## Slide 1\na\n## Slide 1\n", 3: "## Slide 1\n## Slide 1\nb", 4: "## Slide 1\na\n## Slide 2\nb\n## Slide 1\nc", 5: "", 6: None}
    got = textjobs.translated_sections(spark.createDataFrame(list(texts.items()), "document_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "##  Slide 1: A\nbody"), (1, 3, "## 第3页\nc"), (3, 1, "## Slide 1\nb")]


def plain_reduction(text, most):
    """The sentences that add most new words, found by looking at all of them again for each choice."""
    if len(text) <= most:
        return text
    parts = []
    for line in text.split("\n"):
        sentence = ""
        for token in re.split(r"\s+", line.strip()):
            sentence = f"{sentence} {token}".strip()
            if token[-1:] in ".!?":
                parts.append(sentence)
                sentence = ""
        if sentence:
            parts.append(sentence)
    used, left, chosen, room = set(), list(range(len(parts))), [], most
    while left:
        best = max(left, key=lambda k: (1000 * len(set(re.findall(r"\w{3,}", parts[k].casefold())) - used) - len(parts[k]), -k))
        left.remove(best)
        new = set(re.findall(r"\w{3,}", parts[best].casefold())) - used
        if len(parts[best]) <= room and (new or not chosen):
            chosen.append(best)
            used |= new
            room -= len(parts[best]) + 1
    return " ".join(parts[k] for k in sorted(chosen))


def plain_digest(notes, total, pack, most, rounds=4):
    parts = list(notes)
    for _ in range(rounds):
        if len("\n\n".join(parts)) <= total:
            break
        packs, size = [[]], 0
        for n in parts:
            if packs[-1] and size + len(n) > pack:
                packs.append([])
                size = 0
            packs[-1].append(n)
            size += len(n)
        smaller = [plain_reduction("\n\n".join(p), most) for p in packs]
        if len("\n\n".join(smaller)) >= len("\n\n".join(parts)):
            return None
        parts = smaller
    text = "\n\n".join(parts)
    return text if len(text) <= total else None


@pytest.mark.parametrize(("total", "pack", "most"), [(12_000, 9_000, 4_000), (24_000, 18_000, 4_000), (3_000, 2_000, 700)])
def test_digests_equal_a_plain_reduction(spark, total, pack, most):
    """#53, #54: whole lectures of many rounds against a version that looks at all sentences again for each choice."""
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(700)]
    say = lambda: " ".join(r.choice(words, r.integers(3, 14))) + str(r.choice([".", "!", "?"]))
    note = lambda: "\n".join(" ".join(say() for _ in range(r.integers(1, 6))) for _ in range(r.integers(1, 5)))
    lectures = {k: [note() for _ in range(n)] for k, n in ((1, 120), (2, 30), (3, 1), (4, 400))}
    rows = [(k, i, t) for k, own in lectures.items() for i, t in enumerate(own)]
    got = {x.lecture: x.digest for x in notes.digest_rounds(spark.createDataFrame(rows, "lecture long, slide long, note string").repartition(5), total, pack, most).collect()}
    assert got == {k: plain_digest(own, total, pack, most) for k, own in lectures.items()}
    assert any(len("\n\n".join(own)) > total for own in lectures.values())


def test_paths_of_equal_cost_are_decided_as_in_sql(spark, tmp_path):
    """With two paragraphs whose slides come in the other order, both paths cost the same but for the last bits."""
    rows = frame(spark, SF, "embeddings").withColumn("k", F.row_number().over(Window.orderBy("vec_id")) - 1)
    rows.selectExpr("CAST(k div 2 * 50 + k % 2 AS BIGINT) AS vec_id", "embedding", "label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("alignment", "slide_rollup"):
        same(align.QUERIES[name](spark, str(tmp_path)), con, align.ORACLES[name])


def test_cosine_of_very_short_and_very_long_vectors(spark):
    for x in (1e-120, 1e120):
        df = spark.createDataFrame([([x, 0.0], [x, x])], "a array<double>, b array<double>")
        assert abs(df.select(cosine(F.col("a"), F.col("b"))).first()[0] - 0.5**0.5) < 1e-12


def test_summaries_name_sizes_beyond_a_terabyte_in_gb(spark):
    docs = spark.createDataFrame([(1, "s", "a", 2**41)], "document_id long, subject string, name string, size_bytes long")
    files = docs.selectExpr("name AS path", "size_bytes", "'library' AS origin", "true AS tracked")
    assert {r.label for r in catalog.sharing_summary(files).collect()} == {"2048.0 GB"}
    assert catalog.storage_summary(docs, 1, 2).first().label == catalog.largest_files(docs).first().label == "2048.0 GB"
    assert one(spark, byte_size(F.col("n")), n=2**41) == "2.0 TB"


def test_files_of_more_than_half_a_megabyte_are_shared(spark):
    docs = spark.createDataFrame([(1, 600_000)], "document_id long, size_bytes int")
    assert catalog._shared_files(docs).first().size_bytes == 2_400_000_000


def test_alike_requests_meet_one_job(spark):
    """Jobs of the same fields are one row before requests meet them."""
    fields = [f"CAST(NULL AS STRING) AS {c}" for c in jobs.REQUEST_FIELDS]
    ids = spark.range(50)
    done = ids.selectExpr("id AS job_id", "'translation' AS kind", "IF(id = 49, 'failed', 'completed') AS status", "id % 7 AS created", *fields)
    df = jobs.reusable_requests(ids.selectExpr("id AS request_id", *fields), done)
    assert sorted(tuple(r) for r in df.collect()) == [(i, 48) for i in range(50)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Join ") < plan.index("Aggregate ")


def _cut_by_copies(text, limit, sentences):
    """The cuts as the SQL writes them: what is left of the text is a text."""
    out, rest, ends = [], text, " \t\n\x0b\f\r"
    while rest:
        if len(rest) <= limit:
            return [*out, rest]
        piece = rest[:limit]
        first = max(piece.rfind(m) for m in (".!?。！？" if sentences else "\n")) + sentences
        at = piece.rfind(" ") if first < limit // 2 else first
        at = limit if (at <= 0 if sentences else at < limit // 2) else at
        out, rest = [*out, rest[:at].strip(ends)], rest[at:].strip(ends)
    return out


@pytest.mark.parametrize("sentences", [True, False])
def test_cuts_of_odd_texts(spark, sentences):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ab。é𝄞 .!\n\t \x0b\u2003"), size=n, p=[0.3, 0.2, 0.03, 0.1, 0.05, 0.1, 0.03, 0.02, 0.05, 0.02, 0.05, 0.02, 0.03])) for n in r.integers(0, 300, 300)]
    texts += [None, "", " ", " " * 50, " " * 50 + "a", "a" + "\n" * 50, "x" * 45 + " " * 45 + "y" * 45, "a " + "x" * 41]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.cut_points(F.col("t"), 20, sentences).alias("p"))
    for row in df.collect():
        assert row.p == (None if texts[row.i] is None else _cut_by_copies(texts[row.i], 20, sentences))


def test_a_text_of_megabytes_is_cut_in_time_by_its_length(spark):
    import time

    docs = spark.range(1).select(F.col("id").alias("document_id"), F.repeat(F.lit("Some words stand here and end. "), 100_000).alias("text"))
    begin = time.time()
    assert chunking.narration_chunks(docs).agg(F.sum(F.length("text"))).first()[0] > 3_000_000
    assert time.time() - begin < 20


def test_digests_group_without_python(spark):
    rows = [(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (1, None, "last"), (1, 3, None), (2, 1, None), (3, 1, "x" * 7), (3, 2, "y" * 7), (4, 1, "é" * 5), (4, 2, "w" * 3), (None, 1, "n")]
    made = notes.digest_rounds(spark.createDataFrame(rows, "lecture long, slide long, note string"), 14, 20, 9, reduce=lambda text, most: text[:most])
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {(1, "a\n\nz\n\nb\n\nlast", None), (2, "", None), (3, "xxxxxxx\n\n", None), (4, "ééééé\n\nwww", None), (None, "n", None)}
