"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words with A-Z lower-cased; a term weighs its occurrences
times the square of its length in bytes, as long words say more about a text. For each of
SAMPLES samples every term draws r and c from Gamma(2, 1) and b from the unit interval, all
of them determined by term and sample. With t = floor(ln(weight) / r + b), the term
whose c * exp(-r * (t - b) - r) is least is the sample, told apart by term and t. Two texts
share a sample with a chance equal to their generalised Jaccard similarity, the sum of the
smaller over the sum of the greater weights. A fingerprint holds 16 bits per sample
(four hex digits), so unequal samples look equal with a chance of 2**-16.

To meet the text that comes next, rows are range-partitioned and sorted by descending
doc_id and read in that order; only the first and last row of each partition meet again.

Edge cases: null counts as the empty text; a text without words has itself as its only
term, so equal texts always have equal fingerprints and empty ones are like each other; rows without
doc_id come after all others, rows that repeat a doc_id stand next to each other in the
order of a hash of their texts; a single row is followed by itself; texts are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._spark import TEXT_ROWS, Scratch, table, texts
from lectern.llm._text import ALNUM, U, mix, slices

SAMPLES = 128
#: Bytes of text, pairs of text and term, and terms that are worked on at once.
TOGETHER, PAIRS, TERMS = 1 << 20, 1 << 16, 1 << 11

_SALT = mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_LOW = U(0xFFFF)
_NONE = U((1 << 64) - 1)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """24 bits to the middle of one of as many parts of the unit interval."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _draws(term: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """For each term and sample 64 bits: what is to be least above, what tells the sample apart below."""
    field = lambda x, shift: _uniform((x >> U(shift)) & U(0xFFFFFF))
    one = mix(term[:, None] ^ _SALT[None, :])
    two = mix(one ^ U(0xD1B54A32D192ED03))
    r = -np.log(field(one, 40) * field(one, 16))
    log_c = np.log(-np.log(field(two, 40) * field(two, 16)))
    b = _uniform(((one & _LOW) << U(8)) | (two & U(0xFF)))
    t = np.floor(log_weight[:, None] / r + b)
    least = (log_c - r * (t - b) - r).view(np.uint32)
    # The order of these integers is that of the floats.
    least = np.where(least >> 31, ~least, least | np.uint32(1 << 31)).astype(U)
    apart = (two ^ (t.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15))) & U(0xFFFFFFFF)
    return (least << U(32)) | apart


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and weights of the distinct terms of every row, ordered by row."""
    out, limit = [], 1 << 62
    for s in slices(column, limit):
        starts, ends, row = s.words(ALNUM)
        bare = np.setdiff1d(np.arange(s.rows), row)
        starts, ends, row = np.append(starts, s.offs[bare]), np.append(ends, s.offs[bare + 1]), np.append(row, bare)
        h = s.hashes(starts, ends, lower=True)
        _, first, n = np.unique(mix(h + row.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        order = np.argsort(row[first], kind="stable")
        first, n = first[order], n[order]
        out.append((row[first] + s.first, h[first], n * np.maximum(ends[first] - starts[first], 1) ** 2))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketches(column: pa.Array) -> np.ndarray:
    """16 bits per sample for each text."""
    row, term, weight = _terms(column)
    best = np.full((len(column), SAMPLES), _NONE)
    for at in range(0, len(row), PAIRS):
        part = slice(at, at + PAIRS)
        _, first, back = np.unique(mix(term[part] + weight[part].astype(U) * U(0xBF58476D1CE4E5B9)), return_index=True, return_inverse=True)
        h, log_weight = term[part][first], np.log(weight[part][first]).astype(np.float32)
        drawn = np.concatenate([_draws(h[k : k + TERMS], log_weight[k : k + TERMS]) for k in range(0, len(h), TERMS)])
        rows = row[part]
        cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
            r = rows[a]
            best[r] = np.minimum(best[r], drawn[back[a:e]].min(axis=0))
    return (best & _LOW).astype(np.uint16)


def _hex(sketch: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in sketch.astype(">u2")]


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal samples of two fingerprints."""
    at = F.sequence(F.lit(1), F.lit(4 * SAMPLES - 3), F.lit(4))
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(4)) == F.substring(b, i, F.lit(4)))) / F.lit(float(SAMPLES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").fill_null("")
            for s in slices(column, TOGETHER):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), pa.array(_hex(sketches(column.slice(s.first, s.rows))))], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(ids: list, own: list[str], after: list[str]) -> list[pa.Array]:
    """The columns of the result for texts and those that come after them."""
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(own, after, strict=True)]
    # `after` repeats all of `own` but the first when rows are consecutive: the last text is the only one to add.
    chain = after[:-1] == own[1:]
    sketch = sketches(pa.array([*own, *(after[-1:] if chain else after), *edited], pa.large_string()))
    n = len(own)
    one, two, last = sketch[:n], sketch[1 : n + 1] if chain else sketch[n : 2 * n], sketch[len(sketch) - n :]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    share = lambda x: pa.array((one == x).mean(axis=1))
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(digests), pa.array(_hex(one)), pa.array(_hex(last)), share(last), share(two)]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but its last; then its first and its last row with their texts."""
    ids, own, size, first, part = [], [], 0, None, None

    def done(n: int) -> pa.RecordBatch:
        columns = _compared(ids[:n], own[:n], own[1 : n + 1])
        return pa.RecordBatch.from_arrays([*columns, pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.string())], [*_NAMES, "part", "edge", "text"])

    for b in batches:
        for doc, text, p in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("part").to_pylist(), strict=True):
            text, part = text or "", p
            if first is None:
                first = (doc, text)
            if size >= TOGETHER and len(own) > 1:
                yield done(len(own) - 1)
                ids, own, size = ids[-1:], own[-1:], 0
            ids.append(doc)
            own.append(text)
            size += len(text)
    if len(own) > 1:
        yield done(len(own) - 1)
    if own:
        nothing = [pa.nulls(2, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        edges = [pa.array([first[0], ids[-1]], pa.int64()), *nothing, pa.array([part, part], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([first[1], own[-1]])]
        yield pa.RecordBatch.from_arrays(edges, [*_NAMES, "part", "edge", "text"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays(_compared(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after"))), _NAMES)


def against_next(docs: DataFrame) -> DataFrame:
    """Every row of `docs` with its fingerprint, that of its edited text, and its likeness to that and to the row of the next smaller doc_id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    order = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("origin")]
    # The last key spreads equal rows; it follows from the table's splits, so a repeated task deals them out alike.
    rows = texts(docs).withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    found = scratch.keep(rows.mapInArrow(_in_order, f"{_RESULT}, part int, edge int, text string"), "in_order", TEXT_ROWS)
    edges = found.filter("edge IS NOT NULL")
    parts = sorted(r["part"] for r in edges.filter("edge = 0").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    heads = edges.filter("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("after"))
    met = edges.filter("edge = 1").select("part", "doc_id", "text").join(after, "part").join(heads, "next")
    return found.filter("edge IS NULL").select(*_NAMES).unionByName(met.select("doc_id", "text", "after").mapInArrow(_across, _RESULT))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
