"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of its adjacent word pairs
and of its pairs with one word skipped. Training visits a bounded, balanced sample
of labelled texts (of each class at most about TRAIN_PER_CLASS texts and at most
SAMPLE_BYTES together, none of them longer than LONGEST); every coordinate
has its own learning rate, and L1 keeps only the weights that matter, so the model
that tasks receive is a short list of (index, weight).

Edge cases: null and empty texts have no features and get the bias alone; texts are
read whole; a document with several labels counts as toxic if any says so; without
any label all scores are 0.5; rows without doc_id are scored, never held out, and have no label; repeated rows are scored one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm._spark import split_by, table, texts
from lectern.llm._text import U, Slice, mix, slices

BITS = 20
TRAIN_PER_CLASS = 4000
SAMPLE_BYTES, LONGEST = 24 << 20, 1 << 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.05
THRESHOLD = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature indices, not yet distinct."""
    starts, ends, row = s.words(_WORD)
    h = s.hashes(starts, ends, lower=True)
    rows, found = [row], [h]
    for gap, salt in ((1, 0x51), (2, 0xA3)):
        ok = np.flatnonzero(row[:-gap] == row[gap:]) if len(row) > gap else np.zeros(0, dtype=np.int64)
        rows.append(row[ok])
        found.append(mix(h[ok] * U(0x9E3779B97F4A7C15) + h[ok + gap] + U(salt)))
    return np.concatenate(rows), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            row, f = features(s)
            key = np.unique((row << BITS) | f)
            cut = np.searchsorted(key, np.arange(s.rows + 1) << BITS)
            low = (key & ((1 << BITS) - 1)).astype("<i4")
            out = [low[cut[i] : cut[i + 1]].tobytes() for i in range(s.rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.rows) for c in ("doc_id", "toxic")), pa.array(out, pa.binary())], ["doc_id", "toxic", "features"])


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss; the last coordinate is the bias."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        small = (np.abs(z) <= L1) & (i != 1 << BITS)
        return np.where(small, 0.0, -(z - np.sign(z) * L1 * (i != 1 << BITS)) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.at(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        rate = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - rate * w
        self.n[i] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.at(np.arange((1 << BITS) + 1))
        i = np.flatnonzero(w[:-1])
        return i, w[i].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights and bias learned from (doc_id, toxic) rows of `labels`."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: min(1.0, TRAIN_PER_CLASS / r["count"]) for r in known.groupBy("toxic").count().collect()}
    model = Ftrl()
    if not share:
        return model.sparse()
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    # The share bounds the sample, so this side of the join is small at any size, and so is what is ranked.
    chosen = texts(docs).join(F.broadcast(known.filter(pick)), "doc_id").select("doc_id", "text", "toxic").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    size = chosen.groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    drawn = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = size.withColumn("drawn", drawn).filter(F.col("drawn") <= SAMPLE_BYTES).select("doc_id")
    chosen = chosen.join(F.broadcast(fits), "doc_id", "left_semi")
    rows = chosen.mapInArrow(_vectors, "doc_id long, toxic int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    vectors = [(np.append(np.frombuffer(r["features"], dtype="<i4"), 1 << BITS).astype(np.int64), r["toxic"]) for r in rows]
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(vectors)):
            model.learn(*vectors[k])
    return model.sparse()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    index, weight, bias = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[index] = weight
        for b in batches:
            for s in slices(b.column("text")):
                row, f = features(s)
                hit = np.flatnonzero(dense[f])
                key = np.unique((row[hit] << BITS) | f[hit])
                total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=s.rows) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), pa.array(p)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = split_by("doc_id", 3, 1)
    scored = score(docs, train(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
