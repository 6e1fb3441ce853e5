"""A stored inverted index over chunks, in blocks with maxima, for #73, #74 and #20.

A block holds at most BLOCK chunks that lie next to each other by folder, subject and document: for
each distinct word the greatest count in one chunk, and the chunks with their counts; and
the names, places and texts of the chunks. The chunks and counts of all words stand one after
another in two arrays of numbers; as nested structs they would take several times the memory. Words are whole runs of word characters, so each term of
a question lies within words.

Questions are answered in groups of at most about QUESTION_TERMS terms. A task reads its
blocks one after another and keeps the best `k` chunks of each question. From the maxima of
a block's words follows a bound for every question; a question whose bound is below
its k-th best score so far skips the block, and where all do, no posting is read. What
leaves a task is at most `k` rows for each question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.durable import arrow_rows, written

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
#: Blocks that a reader of the index decodes at once, and that go to Python at once; one may take a megabyte.
GROUP_BLOCKS = 8
QUESTION_TERMS = 8192
#: Words whose terms a task remembers from block to block.
WORDS_MET = 1 << 16
#: Runs of the characters that the terms of all searches consist of.
RUN = r"((?U)[\w'’-]{2,}|[\x{3400}-\x{9fff}]{2,})"
BONUS = 6


def build(chunks: DataFrame, docs: DataFrame, internal: F.Column | None = None, keep: Callable[..., DataFrame] = written) -> DataFrame:
    """The index of all chunks, and of all documents without any: block, chunks, _POSTINGS, texts.

    `internal` is a condition on documents whose chunks some searches leave out. `keep`
    stores a table; for the index it also gets the number of rows that may be decoded at once.
    """
    near = ["folder"] if "folder" in docs.columns else []
    named = docs.select("document_id", *near, F.coalesce(F.lower("name"), F.lit("")).alias("name"), F.coalesce(F.lower("subject"), F.lit("")).alias("subject"), (F.lit(False) if internal is None else internal).alias("internal"))
    own = chunks.select("document_id", "ordinal", "locator", "content")
    rows = named.join(own, "document_id", "left").withColumns({"ordinal": F.coalesce("ordinal", F.lit(-1)).cast("long"), "locator": F.coalesce("locator", F.lit("Stored file")), "content": F.coalesce("content", F.lit(""))})
    order = [*near, "subject", "document_id", "ordinal"]
    # Partitions begin at multiples of 2**33, so blocks do not cross them.
    slot = F.monotonically_increasing_id()
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", slot).withColumns({"block": F.shiftright("slot", BLOCK_BITS), "at": F.col("slot").bitwiseAND(F.lit(BLOCK - 1)).cast("int")}))
    # All of a block's rows meet once, and are sorted before runs, many times their size, are cut where they are counted.
    cut = placed.repartition("block").sortWithinPartitions("block").withColumn("runs", F.regexp_extract_all(F.lower("content"), F.lit(RUN), 1))
    return keep(cut.select("block", "at", *_FIELDS, "content", "runs").groupBy("block").applyInArrow(_block, _ROW), GROUP_BLOCKS)


_FIELDS = ("document_id", "ordinal", "name", "subject", "locator", "internal")
_ROW = (
    "block long, chunks array<struct<document_id:long,ordinal:long,name:string,subject:string,locator:string,internal:boolean>>, "
    "words array<string>, most array<int>, places array<int>, at array<short>, n array<int>, texts array<string>"
)
#: Distinct words, the greatest count of each, in how many chunks each is; then, word by word, these chunks and the counts there.
_POSTINGS = ("words", "most", "places", "at", "n")
_PRESENCE = ("words", "places", "at")


def _block(rows: pa.Table) -> pa.Table:
    """The chunks of one block as one row: each distinct word with its greatest count and its places."""
    rows = rows.sort_by("at").combine_chunks()
    runs, at = rows.column("runs").combine_chunks(), rows.column("at").to_numpy().astype(np.int64)
    every = runs.flatten().dictionary_encode()
    where = np.repeat(at, runs.value_lengths().to_numpy(zero_copy_only=False))
    key, n = np.unique(every.indices.to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK + where, return_counts=True)
    code = key // BLOCK
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
    most = np.maximum.reduceat(n, first) if len(code) else n
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    words, places = every.dictionary.take(pa.array(code[first])).cast(pa.string()), np.diff(np.append(first, len(code)))
    postings = [words, pa.array(most, pa.int32()), pa.array(places, pa.int32()), pa.array(key % BLOCK, pa.int16()), pa.array(n, pa.int32())]
    chunks = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in _FIELDS], list(_FIELDS))
    return pa.Table.from_arrays([rows.column("block").slice(0, 1), *map(one, (chunks, *postings, rows.column("content").combine_chunks()))], ["block", "chunks", *_POSTINGS, "texts"])


class Block:
    """One row of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        part = lambda name: batch.column(name).slice(i, 1).flatten()
        numbers = lambda name: part(name).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = part("chunks")
        self.size = len(chunks)
        self._chunks, self._texts, self._fields = chunks, batch.column("texts").slice(i, 1) if "texts" in batch.schema.names else None, {}
        self.words = part("words").to_pylist()
        self.cut = np.cumsum(np.append(0, numbers("places")))
        self.at = numbers("at")
        # Where only presence counts, the counts are not read.
        self.most, self.n = (numbers(c) if c in batch.schema.names else np.ones(n, np.int64) for c, n in (("most", len(self.words)), ("n", len(self.at))))

    def field(self, name: str) -> list:
        if name not in self._fields:
            self._fields[name] = self._texts.flatten().to_pylist() if name == "text" else self._chunks.field(name).to_pylist()
        return self._fields[name]


class Question:
    def __init__(self, row, place: dict[str, int]):
        self.id, self.phrase = row["question_id"], row["phrase"]
        times: dict[int, int] = {}
        for t in row["terms"]:
            times[place[t]] = times.get(place[t], 0) + 1
        self.terms = np.array(sorted(times), dtype=np.int64)
        self.times = np.array([times[t] for t in sorted(times)], dtype=np.float64)
        self.best: list[tuple] = []


class Finder:
    """The terms of a group of questions, to be found in words."""

    def __init__(self, terms: list[str]):
        self.terms, self.tree, self._met = terms, ahocorasick.Automaton(), {}
        for i, t in enumerate(terms):
            self.tree.add_word(t, i)
        if terms:
            self.tree.make_automaton()

    def within(self, word: str) -> set[int]:
        return {i for _, i in self.tree.iter(word)} if self.terms else set()

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, how often it occurs there without overlap) for all words that contain a term."""
        found = [self._of(word) for word in words]
        term, times = (np.fromiter(chain.from_iterable(f[i] for f in found), np.int64) for i in (0, 1))
        return np.repeat(np.arange(len(words)), np.array([len(f[0]) for f in found], dtype=np.int64)), term, times

    def _of(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        if word not in self._met:
            if len(self._met) >= WORDS_MET:
                self._met.clear()
            terms = tuple(self.within(word))
            self._met[word] = terms, tuple(word.count(self.terms[t]) for t in terms)
        return self._met[word]

    def present(self, texts: list[str]) -> np.ndarray:
        """Which text contains which term."""
        out = np.zeros((len(texts), len(self.terms)), dtype=bool)
        for text in set(texts):
            found = list(self.within(text))
            if found:
                same = np.array([x == text for x in texts])
                out[np.ix_(same, found)] = True
        return out


def _hits(block: Block, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n_terms: int) -> np.ndarray:
    """How often each term occurs in each chunk of a block."""
    word, term, times = pairs
    n = block.cut[word + 1] - block.cut[word]
    each = np.repeat(np.arange(len(word)), n)
    posting = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + block.cut[word][each]
    key = block.at[posting] * n_terms + term[each]
    return np.bincount(key, weights=block.n[posting] * times[each], minlength=block.size * n_terms).reshape(block.size, n_terms)


def _bounds(block: Block, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n_terms: int) -> np.ndarray:
    """For each term a number that no chunk of the block exceeds."""
    word, term, times = pairs
    return np.bincount(term, weights=block.most[word] * times, minlength=n_terms)


class Ranked:
    """#73: occurrences, names, subjects, the whole phrase, and how many terms occur at all."""

    order, reads = ("name", "locator", "document_id", "ordinal"), ("chunks", *_POSTINGS, "texts")

    def bound(self, block: Block, pairs, finder: Finder, questions: list[Question]) -> np.ndarray:
        most = _bounds(block, pairs, len(finder.terms))
        self.named, self.under = finder.present(block.field("name")), finder.present(block.field("subject"))
        any_name = self.named.any(0)
        most_sum, most_any = most + 2 * any_name + self.under.any(0), (most > 0) | any_name
        out = np.zeros(len(questions))
        for i, q in enumerate(questions):
            whole = len(q.phrase) > 3 and bool((most[q.terms] > 0).all())
            out[i] = most_sum[q.terms] @ q.times + 0.5 * most_any[q.terms].sum() + BONUS * whole
        return out

    def scores(self, block: Block, hits: np.ndarray, q: Question) -> np.ndarray:
        own, named = hits[:, q.terms], self.named[:, q.terms]
        out = (own + 2 * named + self.under[:, q.terms]) @ q.times + 0.5 * ((own > 0) | named).sum(1)
        if len(q.phrase) > 3:
            for c in np.flatnonzero((own > 0).all(1)).tolist():
                out[c] += BONUS * (q.phrase in block.field("text")[c].lower())
        return out


class Contained:
    """#74: how many terms a chunk contains."""

    order, reads = ("name", "ordinal", "document_id", "locator"), ("chunks", *_PRESENCE)

    def bound(self, block: Block, pairs, finder: Finder, questions: list[Question]) -> np.ndarray:
        there = _bounds(block, pairs, len(finder.terms)) > 0
        return np.array([float(there[q.terms].sum()) for q in questions])

    def scores(self, block: Block, hits: np.ndarray, q: Question) -> np.ndarray:
        return (hits[:, q.terms] > 0).sum(1).astype(np.float64)


class Literal:
    """#20: chunks that contain the phrase but for the case of A-Z; all score 1. A question without a term meets every chunk."""

    order, reads = ("document_id", "ordinal", "name", "locator"), ("chunks", *_PRESENCE, "texts")

    def bound(self, block: Block, pairs, finder: Finder, questions: list[Question]) -> np.ndarray:
        there = _bounds(block, pairs, len(finder.terms)) > 0
        return np.array([float(there[q.terms].all()) for q in questions])

    def scores(self, block: Block, hits: np.ndarray, q: Question) -> np.ndarray:
        out, needle = np.zeros(block.size), q.phrase.encode().lower()
        for c in np.flatnonzero((hits[:, q.terms] > 0).all(1)).tolist():
            out[c] = needle in block.field("text")[c].encode().lower()
        return out


_FOUND = "question_id long, document_id long, ordinal long, name string, locator string, internal boolean, score double"


def _answers(rows: list, way: Ranked | Contained | Literal, k: int):
    terms = sorted({t for r in rows for t in r["terms"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, place = Finder(terms), {t: i for i, t in enumerate(terms)}
        questions = [Question(r, place) for r in rows]
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b, i)
                pairs = finder.pairs(block.words)
                bound = way.bound(block, pairs, finder, questions)
                reached = np.array([-q.best[-1][0] if len(q.best) == k else 0.0 for q in questions])
                left = np.flatnonzero((bound > 0) & (bound >= reached))
                if not len(left):
                    continue
                hits = _hits(block, pairs, len(terms))
                for j in left.tolist():
                    q, score = questions[j], way.scores(block, hits, questions[j])
                    at = np.flatnonzero((score > 0) & (score >= reached[j]))
                    if len(at) > k:
                        at = at[score[at] >= np.partition(score[at], -k)[-k]]
                    if len(at):
                        fields = [block.field(f) for f in (*way.order, "internal")]
                        q.best = sorted([*q.best, *((-score[c], *(f[c] for f in fields)) for c in at.tolist())])[:k]
        out = [dict(zip(("score", *way.order, "internal"), x, strict=True)) | {"question_id": q.id, "score": -x[0]} for q in questions for x in q.best]
        shape = pa.schema([("question_id", pa.int64()), ("document_id", pa.int64()), ("ordinal", pa.int64()), ("name", pa.string()), ("locator", pa.string()), ("internal", pa.bool_()), ("score", pa.float64())])
        yield pa.RecordBatch.from_pylist(out, shape)

    return run


def candidates(index: DataFrame, questions: DataFrame, way: Ranked | Contained | Literal, k: int, at_once: int | None = None) -> DataFrame:
    """For each question (question_id, phrase, terms) a set of chunks that holds its best `k`, in the order of `way`.

    The set is stored, so that the blocks are read while the size of batches is bounded.
    """
    asked = written(questions.select(F.col("question_id").cast("long").alias("question_id"), "phrase", "terms"))
    total = asked.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    groups, found = max(1, -(-total // (at_once or QUESTION_TERMS))), []
    for g in range(groups):
        # A group of questions is bounded by its terms, so every task can take it whole.
        rows = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g).collect()
        if rows:
            found.append(index.select(*way.reads).mapInArrow(_answers(rows, way, k), _FOUND))
    if not found:
        return index.sparkSession.createDataFrame([], _FOUND)
    with arrow_rows(index.sparkSession, GROUP_BLOCKS):
        return written(reduce(DataFrame.unionByName, found))
