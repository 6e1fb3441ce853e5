"""The stored search index against plain counts, and how much of it a question reads."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import search, search_index


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(4)
    words = ["graph", "graphs", "subgraph", "matrix", "it's", "well-known", "été", "線性代數", "an", "banana", "x", "tree", "trees"]
    docs = [(i, ["maths", "law", None][i % 3], None if i % 4 else "f", r.choice(["graph notes.txt", "b.txt", "tree_notes.md", "c.txt"])) for i in range(60)]
    chunks = [(i, o, r.choice(["Page 1", "Page 2"]) + f" {o}", " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(50) for o in range(1, 1 + i % 4)]
    d = spark.createDataFrame(docs, "document_id long, subject string, folder string, name string")
    return docs, chunks, d, spark.createDataFrame(chunks, "document_id long, ordinal int, locator string, content string")


QUESTIONS = [(1, "the graph and the matrix"), (2, "banana tree"), (3, "été"), (4, "nothing of this kind"), (5, "it's well-known"), (6, "maths"), (7, "tree tree graphs"), (8, "x"), (9, None), (10, "an")]


def brute(docs, chunks, asked, k):
    out = set()
    for q, phrase, terms in asked:
        found = []
        for d, subject, _, name in docs:
            own = [(o, loc, c) for i, o, loc, c in chunks if i == d] or [(-1, "Stored file", "")]
            for o, loc, c in own:
                low, subject_low = c.lower(), (subject or "").lower()
                score = sum(low.count(t) + 2 * (t in name) + (t in subject_low) for t in terms) + 6 * (len(phrase) > 3 and phrase in low)
                score += 0.5 * len({t for t in terms if t in low or t in name})
                if score > 0:
                    found.append((-score, name, loc, d, o))
        out |= {(q, p + 1, x[3], x[2], -x[0]) for p, x in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize(("bits", "at_once", "k"), [(1, 3, 4), (8, 8192, 10)])
def test_ranked_search_equals_plain_counts(spark, library, monkeypatch, bits, at_once, k):
    docs, chunks, d, c = library
    monkeypatch.setattr(search_index, "BLOCK_BITS", bits)
    monkeypatch.setattr(search_index, "BLOCK", 1 << bits)
    monkeypatch.setattr(search_index, "QUESTION_TERMS", at_once)
    q = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    index = search.indexed(c, d)
    assert index.count() >= (40 if bits == 1 else 1)
    asked = [tuple(r) for r in search.question_terms(q).collect()]
    got = {tuple(r) for r in search.ranked_search(q, index, k).collect()}
    assert got == brute(docs, chunks, asked, k)


def test_literal_search_of_signs_and_words(spark, library):
    docs, chunks, d, c = library
    internal = {d for d, _, _, name in docs if name.endswith("_notes.md")}
    q = spark.createDataFrame([(1, "Graph M"), (2, "- "), (3, " "), (4, None), (5, "été É"), (6, "y" * 501)], "question_id long, question string")
    got = {}
    for r in search.literal_search(q, search.indexed(c, d), c, 30).collect():
        got.setdefault(r.question_id, []).append((r.place, r.document_id, r.locator))
    for i, needle in ((1, "graph m"), (3, " "), (5, "été É")):
        found = sorted((d, o, loc) for d, o, loc, t in chunks if needle in t.encode().lower().decode())[:120]
        assert [x[1:] for x in sorted(got.get(i, []))] == [(d, loc) for d, _, loc in found if d not in internal][:30]
    assert set(got) <= {1, 3}


def test_blocks_below_the_best_scores_are_not_read(spark):
    """Blocks whose maxima cannot reach the best scores so far are passed over."""
    docs = spark.createDataFrame([(i, "s", f"{i:05d}.txt") for i in range(4000)], "document_id long, subject string, name string")
    text = F.when(F.col("document_id") < 40, F.lit("alpha " * 9)).when(F.col("document_id") % 5 == 0, F.lit("alpha beta")).otherwise(F.lit("gamma"))
    chunks = docs.select("document_id", F.lit(1).alias("ordinal"), F.lit("Text").alias("locator"), text.alias("content"))
    index = search.indexed(chunks, docs).coalesce(1).sortWithinPartitions("block")
    q = spark.createDataFrame([(1, "alpha")], "question_id long, question string")
    rows, read = search.question_terms(q).collect(), spark.sparkContext.accumulator(0)

    class Counting(search_index.Ranked):
        def scores(self, block, hits, question):
            read.add(1)
            return super().scores(block, hits, question)

    got = index.mapInArrow(search_index._answers(rows, Counting(), 10), search_index._FOUND).collect()
    assert len(got) == 10 and {r.score for r in got} == {15.5}
    assert 1 <= read.value < index.count() / 2


def test_a_reader_of_the_index_decodes_few_blocks_at_once(spark, library, monkeypatch):
    """What is decoded at once is a row group at most, however many blocks a file holds."""
    monkeypatch.setattr(search_index, "BLOCK_BITS", 1)
    monkeypatch.setattr(search_index, "BLOCK", 2)
    _, _, d, c = library
    index = search.indexed(c, d.coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(f.num_rows for f in files) > search_index.GROUP_BLOCKS
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= search_index.GROUP_BLOCKS


def test_empty_library(spark):
    d = spark.createDataFrame([], "document_id long, subject string, name string")
    c = spark.createDataFrame([], "document_id long, ordinal int, locator string, content string")
    q = spark.createDataFrame([(1, "graph")], "question_id long, question string")
    assert search.ranked_search(q, search.indexed(c, d)).count() == 0
    assert search.ranked_search(q.limit(0), search.indexed(c, d)).count() == 0


def test_runs_are_cut_after_the_sort_by_blocks(spark, library):
    _, _, d, c = library
    plans = []
    search_index.build(c, d, keep=lambda df, *rows: plans.append(df._jdf.queryExecution().sparkPlan().toString() if rows else "") or df)
    [plan] = filter(None, plans)
    assert plan.index("regexp_extract_all") < plan.index("Sort [block")


def test_passages_read_no_texts_of_the_index(spark, library):
    _, _, d, c = library
    q = spark.createDataFrame(QUESTIONS[:2], "question_id long, question string")
    index = search.indexed(c, d)
    found = search_index.candidates(index, search.chat_terms(q).withColumn("phrase", F.lit("")), search_index.Contained(), 5)
    assert "texts#" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() > 0


def test_words_met_before_give_the_same_pairs(monkeypatch):
    monkeypatch.setattr(search_index, "WORDS_MET", 2)
    finder = search_index.Finder(["an", "na", "tree"])
    for words in (["banana", "x", "trees"], [], ["trees", "an", "banana"]):
        got = sorted(zip(*map(list, finder.pairs(words)), strict=True))
        assert got == sorted((w, t, word.count(term)) for w, word in enumerate(words) for t, term in enumerate(finder.terms) if term in word)


def test_postings_are_flat_arrays(spark, library, monkeypatch):
    """Numbers of all words in one array each: a nested struct for each posting takes several times as much of the engine's memory."""
    monkeypatch.setattr(search_index, "BLOCK_BITS", 3)
    monkeypatch.setattr(search_index, "BLOCK", 8)
    _, chunks, d, c = library
    index = search.indexed(c, d)
    for name in ("words", "most", "places", "at", "n"):
        assert not isinstance(index.schema[name].dataType.elementType, (T.StructType, T.ArrayType))
    got = {}
    for r in index.collect():
        assert len(r["words"]) == len(r["most"]) == len(r["places"]) and sum(r["places"]) == len(r["at"]) == len(r["n"])
        postings = iter(zip(r["at"], r["n"], strict=True))
        for word, most, places in zip(r["words"], r["most"], r["places"], strict=True):
            own = [next(postings) for _ in range(places)]
            assert most == max(n for _, n in own)
            for at, n in own:
                got[r["chunks"][at]["document_id"], r["chunks"][at]["ordinal"], word] = n
    assert got == {(i, o, w): n for i, o, _, text in chunks for w, n in Counter(re.findall(r"[\w'’-]{2,}", text.lower())).items()}


@pytest.mark.parametrize("way", [search_index.Ranked, search_index.Contained, search_index.Literal])
def test_python_gets_few_blocks_at_once(spark, library, monkeypatch, way):
    """However many blocks a task reads, at most a row group of them is a batch; nothing is read that a way does not need."""
    monkeypatch.setattr(search_index, "BLOCK_BITS", 1)
    monkeypatch.setattr(search_index, "BLOCK", 2)
    _, _, d, c = library
    index, answers = search.indexed(c, d).coalesce(1), search_index._answers
    assert index.count() > 2 * search_index.GROUP_BLOCKS
    most, needed = search_index.GROUP_BLOCKS, {"words", "places", "at"} | ({"most", "n"} if way is search_index.Ranked else set())

    def watched(rows, way, k):
        def few(batches):
            for b in batches:
                assert b.num_rows <= most
                assert {x for x in b.schema.names if x not in ("chunks", "texts")} == needed
                yield b

        return lambda batches: answers(rows, way, k)(few(batches))

    monkeypatch.setattr(search_index, "_answers", watched)
    name, q = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame(QUESTIONS[:2], "question_id long, question string")
    before = spark.conf.get(name)
    assert search_index.candidates(index, search.question_terms(q), way(), 5).count() > 0
    assert spark.conf.get(name) == before


def test_few_passages_do_not_shuffle_the_chunks(spark, library, monkeypatch):
    """What is shown goes to the chunks, whatever the size of the index and of the chunks."""
    monkeypatch.setattr(search_index, "BLOCK_BITS", 1)
    monkeypatch.setattr(search_index, "BLOCK", 2)
    _, _, d, c = library
    q, index = spark.createDataFrame(QUESTIONS, "question_id long, question string"), search.indexed(c, d)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        for found in (search.passages(q, index, c), search.literal_search(q, index, c)):
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(name, before)
