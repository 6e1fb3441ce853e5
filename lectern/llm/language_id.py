"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of WINDOW bytes,
each filter's maximum over the window feeds a softmax. The network is trained in
numpy on windows spread evenly over a bounded sample of labelled texts (at most
about SAMPLE_PER_LANG documents of a language, WINDOWS_PER_DOC windows of each);
prediction covers all windows of every whole text and averages their
probabilities by the bytes that a window holds.

Edge cases: texts that are null or have no letter are `und` with score 0, as is
everything when there is nothing to learn from; rows without a label are not
learned from; rows without doc_id are not held out; repeated rows are predicted one by one; an empty table gives an empty
result; other columns are kept or ignored but never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._spark import split_by, table
from lectern.llm._text import Slice, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
DIM = 8
PAD = 256
SAMPLE_PER_LANG = 1200
WINDOWS_PER_DOC = 3
EPOCHS = 3
MIN_SCORE = 0.3


def windows(s: Slice, per_row: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte windows padded with PAD, their rows, bytes in each); all of them, or up to per_row spread evenly."""
    size = np.diff(s.offs)
    n = -(-size // WINDOW)
    take = n if per_row is None else np.minimum(n, per_row)
    row = np.repeat(np.arange(s.rows), take)
    k = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    start = s.offs[row] + k * n[row] // np.maximum(take[row], 1) * WINDOW
    held = np.minimum(s.offs[row + 1] - start, WINDOW)
    return start, row, held


def gather(s: Slice, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    # The padding does not fit a byte.
    return np.where(inside, s.data[np.minimum(at, len(s.data) - 1)].astype(np.int32), PAD)


class ByteCnn:
    """Parameters, forward pass and training steps."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, wide = labels, max(WIDTHS)
        width = np.repeat(WIDTHS, FILTERS)
        self.open = (np.arange(wide * DIM)[:, None] < width[None, :] * DIM).astype(np.float32)
        f = len(width)
        self.p = {
            "emb": rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (wide * DIM, f)) * self.open).astype(np.float32),
            "bias": np.zeros(f, dtype=np.float32),
            "out": rng.normal(0, 0.2, (f, len(labels))).astype(np.float32),
            "base": np.zeros(len(labels), dtype=np.float32),
        }
        self.p["emb"][PAD] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        places = WINDOW - max(WIDTHS) + 1
        return np.concatenate([e[:, i : i + places] for i in range(max(WIDTHS))], axis=2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (self.columns(x) @ self.p["conv"]).max(axis=1)
        return self._softmax(np.maximum(z + self.p["bias"], 0))

    def _softmax(self, a: np.ndarray) -> np.ndarray:
        o = a @ self.p["out"] + self.p["base"]
        o = np.exp(o - o.max(axis=1, keepdims=True))
        return o / o.sum(axis=1, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        cols = self.columns(x)
        z = cols @ self.p["conv"]
        where = z.argmax(axis=1)
        n = np.arange(len(x))
        top = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0] + self.p["bias"]
        a = np.maximum(top, 0)
        d = self._softmax(a)
        d[n, y] -= 1
        d /= len(x)
        g = {"out": a.T @ d, "base": d.sum(axis=0)}
        da = (d @ self.p["out"].T) * (top > 0)
        picked = cols[n[:, None], where]
        g["conv"] = np.einsum("nf,nfk->kf", da, picked) * self.open
        g["bias"] = da.sum(axis=0)
        g["emb"] = np.zeros_like(self.p["emb"])
        for i in range(max(WIDTHS)):
            back = da[:, :, None] * self.p["conv"][i * DIM : (i + 1) * DIM].T[None]
            np.add.at(g["emb"], x[n[:, None], where + i], back)
        g["emb"][PAD] = 0
        self.t += 1
        for k, w in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] ** 2 - self.v[k])
            w -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                part = order[at : at + 64]
                self.step(x[part], y[part], 0.01 / (1 + epoch))

    def weights(self) -> dict[str, np.ndarray]:
        return self.p


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            start, row, held = windows(s, WINDOWS_PER_DOC)
            out = [s.data[a : a + n].tobytes() for a, n in zip(start, held, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row + s.first)), pa.array(out, pa.binary())], ["lang", "data"])


def train(labelled: DataFrame) -> ByteCnn | None:
    """A network for the values of `lang` in a frame of (doc_id, text, lang); None if there are none."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, SAMPLE_PER_LANG / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return None
    # Rows are drawn by id and text and taken once, so neither a repeated id nor a repeated row brings more than its share.
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]
    got = rows.filter(pick).dropDuplicates(["doc_id", "lang", "text"]).mapInArrow(_samples, "lang string, data binary").collect()
    model = ByteCnn(sorted(share))
    if got:
        got.sort(key=lambda r: (r["lang"], bytes(r["data"])))
        x = np.full((len(got), WINDOW), PAD, dtype=np.int32)
        for i, r in enumerate(got):
            x[i, : len(r["data"])] = np.frombuffer(r["data"], dtype=np.uint8)
        model.fit(x, np.array([model.labels.index(r["lang"]) for r in got]))
    return model


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(column: pa.Array, model: ByteCnn | None) -> tuple[list[str], list[float]]:
    names, scores = [], []
    letters = [has_letter(t) for t in column.to_pylist()]
    for s in slices(column):
        total = np.zeros((s.rows, len(model.labels) if model else 1))
        start, row, held = windows(s)
        for at in range(0, len(start) if model else 0, 64):
            part = slice(at, at + 64)
            p = model.probabilities(gather(s, start[part], held[part]))
            np.add.at(total, row[part], p * held[part][:, None])
        best, size = total.argmax(axis=1), np.maximum(np.diff(s.offs), 1)
        for i in range(s.rows):
            known = model is not None and letters[s.first + i]
            names.append(model.labels[best[i]] if known else "und")
            scores.append(min(1.0, float(total[i, best[i]] / size[i])) if known else 0.0)
    return names, scores


def predictor(model: ByteCnn | None):
    """A column function: text to (lang_pred, score)."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, scores = [], []
            # A few rows at a time: a batch of whole texts is large.
            for at in range(0, len(column), 256):
                found = _predict(column.slice(at, 256), model)
                names += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs`."""
    return docs.select("doc_id", predictor(model)("text").alias("_p")).select("doc_id", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, model: ByteCnn | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs` whose language is recognised with at least this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, scores = _predict(part.column(place), model)
                yield part.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    place = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~split_by("doc_id", 4, 2))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(training_rows(docs)))
    return found.select("doc_id", split_by("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
