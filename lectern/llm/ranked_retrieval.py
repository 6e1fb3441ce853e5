"""Ranked lexical search: accumulator-limited term-at-a-time evaluation over shards of documents.

A first pass over all documents counts them, their terms, and in how many of them each
term of the items occurs. A second pass cuts every task's documents into shards of
at most SHARD documents or POSTINGS postings and evaluates all items on each of them.
The terms of an item are visited rarest first. Every term has a bound, its greatest
contribution within the shard. As soon as the bounds of the terms still to come sum up to less
than the k-th best partial score (of this shard or of those that the task has finished),
no document that has no accumulator yet can enter the result: from there on only
existing accumulators are updated, exactly, and those that can no longer reach the k-th
score are given up. A task keeps k documents per item; the best k of these are the result.

Items are taken in blocks of about ITEM_TERMS terms, one pair of passes each, so what a
task receives is bounded however many items there are. A term is found by its hash and
then compared byte by byte.

Edge cases: null, empty and wordless texts have no terms; such documents are not counted and
such items have no rows; item rows that repeat an item_id form one item with the terms
of all of them, null item_ids too; rows that repeat a doc_id, or have none, are documents
of their own, and rank after all others of their score where the id is null; texts are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm._spark import Scratch, table, texts
from lectern.llm._text import ALNUM, Slice, slices

K = 10
SHARD, POSTINGS = 8192, 2_000_000
ITEM_TERMS = 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of all items."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), 0))).alias("term")).distinct()


class Vocabulary:
    """The terms of a block of items: sorted hashes, and the bytes to compare."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        s = next(slices(pa.array([b"".join(raw)], pa.binary()), 1 << 62))
        cut = np.cumsum([0, *map(len, raw)])
        found = s.hashes(cut[:-1], cut[1:], lower=False)
        order = np.argsort(found, kind="stable")
        self.hashes, self.terms = found[order], [terms[i] for i in order.tolist()]
        size = np.diff(cut)[order]
        self.data = np.frombuffer(b"".join(t.encode() for t in self.terms), dtype=np.uint8)
        self.starts = np.cumsum(np.append(0, size))[:-1]
        self.sizes = size

    def occurrences(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and term of every word of a slice that is a term, and the number of words of each row."""
        starts, ends, row = s.words(ALNUM)
        h = s.hashes(starts, ends, lower=True)
        first = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        rows, terms, data = [], [], s.lowered()
        for step in range(2):  # two terms of one hash lie side by side
            at = first + step
            hit = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h))
            hit = hit[self._equal(data, starts[hit], ends[hit], at[hit])]
            rows.append(row[hit])
            terms.append(at[hit])
        return np.concatenate(rows), np.concatenate(terms), np.bincount(row, minlength=s.rows)

    def _equal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, term: np.ndarray) -> np.ndarray:
        same = ends - starts == self.sizes[term]
        todo, step = np.flatnonzero(same), 0
        while len(todo := todo[ends[todo] - starts[todo] > step]):
            differ = data[starts[todo] + step] != self.data[self.starts[term[todo]] + step]
            same[todo[differ]] = False
            todo, step = todo[~differ], step + 1
        return same


def _postings(s: Slice, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and counts of all postings of a slice, and the number of words of each row."""
    row, term, n = vocabulary.occurrences(s)
    key, tf = np.unique(row * len(vocabulary.terms) + term, return_counts=True)
    return key // len(vocabulary.terms), key % len(vocabulary.terms), tf, n


#: Where the counts of documents and of all their terms stand among the counts of terms.
DOCUMENTS, TERMS = -1, -2


def statistics(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each term of the vocabulary occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(vocabulary.terms), dtype=np.int64), 0, 0
        for b in batches:
            for s in slices(b.column("text")):
                _, term, _, n = _postings(s, vocabulary)
                df += np.bincount(term, minlength=len(df))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS, TERMS, *at.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[at].tolist()], pa.int64())], ["place", "n"])

    df, rest = np.zeros(len(vocabulary.terms), dtype=np.int64), {DOCUMENTS: 0, TERMS: 0}
    for r in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if r["place"] < 0:
            rest[r["place"]] = r["n"]
        else:
            df[r["place"]] = r["n"]
    return rest[DOCUMENTS], rest[TERMS], df


class Best:
    """The k best documents of one item that a task has met."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.append(self.score, score), np.append(self.doc, doc), np.append(self.none, none)
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


class Shard:
    """Postings of some documents by term, with what each adds to a score."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.none, self.row, self.impact = doc, none, row[order], impact[order]
        self.cut = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.bound = np.zeros(n_terms, dtype=np.int64)
        full = np.flatnonzero(np.diff(self.cut))
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.impact, self.cut[full])

    def answer(self, terms: np.ndarray, best: Best) -> int:
        """Adds the shard's best documents for these terms, rarest first; how many accumulators it took."""
        left = np.append(np.cumsum(self.bound[terms][::-1])[::-1], 0)
        score, alive, created = np.zeros(len(self.doc), dtype=np.int64), None, 0
        for i, t in enumerate(terms.tolist()):
            row, impact = self.row[self.cut[t] : self.cut[t + 1]], self.impact[self.cut[t] : self.cut[t + 1]]
            if alive is None:
                kth = best.threshold()
                if i and left[i] < max(kth, int(score.max(initial=0))):
                    have = score[score > 0]
                    kth = max(kth, int(np.partition(have, -best.k)[-best.k]) if len(have) >= best.k else 0)
                if left[i] < kth:
                    created = int((score > 0).sum())
                    alive = (score > 0) & (score + left[i] >= kth)
            if alive is None:
                score[row] += impact
            else:
                on = alive[row]
                score[row[on]] += impact[on]
        if alive is None:
            alive, created = score > 0, int((score > 0).sum())
        at = np.flatnonzero(alive & (score > 0) & (score >= best.threshold()))
        if len(at) > best.k:
            at = at[score[at] >= np.partition(score[at], -best.k)[-best.k]]
        best.add(score[at], self.doc[at], self.none[at])
        return created


def _search(vocabulary: Vocabulary, items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size, postings = [Best(k) for _ in items], [], 0, 0

        def finish() -> None:
            first = np.cumsum([0, *(len(h[0]) for h in held)])[:-1]
            doc, none, term, impact = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4))
            row = np.concatenate([h[2] + f for h, f in zip(held, first, strict=True)])
            part = Shard(doc, none, row, term, impact, len(vocabulary.terms))
            for (_, terms), b in zip(items, best, strict=True):
                part.answer(terms, b)

        for b in batches:
            ids = b.column("doc_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for s in slices(b.column("text")):
                row, term, tf, n = _postings(s, vocabulary)
                m = 100 - 90 + (90 * n.astype(np.int64) * n_docs) // max(n_terms, 1)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                held.append((ids[s.first : s.first + s.rows], none[s.first : s.first + s.rows], row, term, impact))
                size, postings = size + s.rows, postings + len(row)
                if size >= shard or postings >= POSTINGS:
                    finish()
                    held, size, postings = [], 0, 0
        if held:
            finish()
        for (item, _), b in zip(items, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.doc, mask=b.none), pa.array(b.score)], ["item_id", "doc_id", "score"])

    return run


def ranked(items: DataFrame, docs: DataFrame, k: int = K, shard: int = SHARD, item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs, terms = texts(docs), scratch.keep(item_terms(items), "terms")
    blocks = max(1, -(-terms.count() // item_terms_at_once))
    found = [spark.createDataFrame([], "item_id long, doc_id long, score long")]
    for block in range(blocks):
        # An item's terms stay together; what comes to the driver is bounded by the size of a block.
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        vocabulary = Vocabulary(sorted({r["term"] for r in rows}))
        place = {t: i for i, t in enumerate(vocabulary.terms)}
        n_docs, n_terms, df = statistics(docs, vocabulary)
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        by_item: dict[int | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(place[r["term"]])
        asked = [(item, np.array(sorted((p for p in own if df[p]), key=lambda p: (df[p], vocabulary.terms[p])), dtype=np.int64)) for item, own in by_item.items()]
        found.append(docs.mapInArrow(_search(vocabulary, [a for a in asked if len(a[1])], weight, n_docs, n_terms, k, shard), "item_id long, doc_id long, score long"))
    best = scratch.keep(reduce(DataFrame.unionByName, found), "best")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), t0 AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
st AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM t0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t0) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
p AS (SELECT term, doc_id, r, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS part FROM tf JOIN df USING (term) JOIN (SELECT r, doc_id, n FROM t0) USING (r), st),
s AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= {K}
"""
