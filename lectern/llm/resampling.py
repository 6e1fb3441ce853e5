"""Importance resampling towards a target distribution, with an exact draw of the highest scores.

Features of a text are its words and its pairs of adjacent words, hashed into a fixed
number of buckets by the CRC-32 of their bytes. All documents and all target texts
are counted, each bucket has a gain (the logarithm of how much likelier the target
makes it), and a document's weight is the mean gain of its features. Gumbel noise
from a digest of its id turns weights into scores, so the highest scores are a sample
without replacement.

The draw is a weighted median of medians selection. Every block of at most BLOCK keys
reports the median of the keys that remain on either side of the last pivot, and how
many these are; the median of these medians, weighted by those counts, is the next
pivot, which discards a quarter of the remaining keys at least. What remains is written
again once it has become small against the table that is read. Once it fits into one
block, its exact place is taken there. Winners are then ordered by range partitions.

Edge cases: null, empty and wordless texts have no features, weight 0 and are never
drawn; rows without doc_id count as documents in the statistics, but have neither score
nor rank; rows that repeat a doc_id are drawn one by one, fewer features first; texts
are read whole; without target texts all target counts are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.order import numbered
from lectern.llm._spark import Scratch, table, texts
from lectern.llm._text import ALNUM, Slice, slices

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK = 1 << 16
#: Words beyond this length are hashed one by one instead of in step with all others.
SHORT = 64

Key = tuple[int, int, int, int]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc_extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after these byte ranges, byte by byte for all of them at once."""
    state, left = state.copy(), ends - starts
    long = np.flatnonzero(left > SHORT)
    todo = np.flatnonzero((left > 0) & (left <= SHORT))
    step = 0
    while len(todo):
        now = state[todo]
        state[todo] = _CRC[(now ^ data[starts[todo] + step]) & 255] ^ (now >> 8)
        step += 1
        todo = todo[left[todo] > step]
    for i in long.tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(s: Slice, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all features of a slice, and the number of words of each row."""
    starts, ends, row = s.words(ALNUM)
    data = s.lowered()
    one = crc_extended(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), data, starts, ends)
    at = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.zeros(0, dtype=np.int64)
    joined = _CRC[(one[at] ^ 0x20) & 255] ^ (one[at] >> 8)
    two = crc_extended(joined, data, starts[at + 1], ends[at + 1])
    found = ~np.concatenate([one, two]) % np.uint32(buckets)
    return np.concatenate([row, row[at]]), found.astype(np.int64), np.bincount(row, minlength=s.rows)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for s in slices(b.column("text")):
                total += np.bincount(features(s, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    counted = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of a bucket's smoothed share of the target over its share of the source, floored."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratio = ((target + 1.0) * (s_all + n)) / ((source + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                row, bucket, words = features(s, buckets)
                n = np.bincount(row, minlength=s.rows)
                total = np.bincount(row, weights=gain[bucket], minlength=s.rows).astype(np.int64)
                mean = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), pa.array(words), pa.array(n), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int):
    """1000 times a Gumbel variate from the digest of an id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


#: Keys in ascending order are scores in descending order; the rest makes them unique.
KEY = ("down", "doc_id", "n_features", "row")


def _below(keys: np.ndarray, key: Key) -> np.ndarray:
    """Which keys come before `key`."""
    out, tied = np.zeros(keys.shape[1], dtype=bool), np.ones(keys.shape[1], dtype=bool)
    for have, limit in zip(keys, key, strict=True):
        out |= tied & (have < limit)
        tied &= have == limit
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in batches:
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in KEY])
        for at in range(0, keys.shape[1], size):
            part = keys[:, at : at + size]
            if n + part.shape[1] > size:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
            held.append(part)
            n += part.shape[1]
    if n:
        yield np.concatenate(held, axis=1)


def _ordered(keys: np.ndarray) -> np.ndarray:
    return keys[:, np.lexsort(keys[::-1])]


def _reports(pivot: Key | None, size: int):
    """For each block: how many keys lie before, at and after the pivot, and the medians of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for keys in _blocks(batches, size):
            before = _below(keys, pivot) if pivot else np.zeros(keys.shape[1], dtype=bool)
            same = np.all(keys == np.array(pivot)[:, None], axis=0) if pivot else before
            for side, chosen in ((0, before), (1, same), (2, ~before & ~same)):
                if n := int(chosen.sum()):
                    rows.append((side, n, *map(int, _ordered(keys[:, chosen])[:, (n - 1) // 2])))
        shape = pa.schema([("side", pa.int32()), *((c, pa.int64()) for c in ("n", *KEY))])
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    return run


def _pick(place: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _blocks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _ordered(keys)[:, place - 1]], list(KEY))

    return run


_KEYS = ", ".join(f"{c} long" for c in KEY)


def _struct(key: Key):
    return F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(KEY, key, strict=True)))


def cutoff(keys: DataFrame, place: int, scratch: Scratch, block: int = BLOCK) -> Key:
    """The key that stands at `place`, from 1 on, among all rows of (down, doc_id, n_features, row), which are unique and written."""
    low = high = pivot = None
    written = remaining = None
    step, name, own = F.struct(*KEY), None, 0
    while True:
        left = keys
        if low is not None:
            left = left.filter(step > _struct(low))
        if high is not None:
            left = left.filter(step < _struct(high))
        if remaining is not None and remaining <= block:
            return tuple(left.coalesce(1).mapInArrow(_pick(place, block), _KEYS).first())
        if remaining is not None and remaining * 4 <= written:
            own += 1
            keys = left = scratch.keep(left, f"remaining{own}")
            if name:
                scratch.forget(name)
            name, written, low, high = f"remaining{own}", remaining, None, None
        rows = left.mapInArrow(_reports(pivot, block), f"side int, n long, {_KEYS}").collect()
        count = [sum(r["n"] for r in rows if r["side"] == side) for side in range(3)]
        if written is None:
            written = sum(count)
        if pivot is None or place > count[0] + count[1]:
            if pivot is not None:
                low, place = pivot, place - count[0] - count[1]
            side = 2
        elif place > count[0]:
            return pivot
        else:
            high, side = pivot, 0
        remaining, seen = count[side], 0
        for r in sorted((tuple(r[c] for c in KEY), r["n"]) for r in rows if r["side"] == side):
            seen += r[1]
            if 2 * seen >= remaining:
                pivot = r[0]
                break


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`; rank is null where a document is not drawn."""
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumns({"score": F.col("weight") + gumbel("doc_id", seed), "row": F.monotonically_increasing_id()})
    scored = scratch.keep(scored.withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)), "scored")
    keyed = scored.withColumn("down", -F.col("score"))
    drawn = percent * scored.filter("eligible").count() // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    last = cutoff(keyed.filter("eligible").select(*KEY), drawn, scratch, block)
    wins = F.col("eligible") & (F.struct(*KEY) <= _struct(last))
    winners = numbered(keyed.filter(wins).select(*KEY, *shown[2:]), list(KEY), "rank", lambda df: scratch.keep(df, "winners"))
    return winners.select(*shown, "rank").unionByName(keyed.filter(~wins).select(*shown, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the draw takes, as they are; a repeated doc_id stays with all of its rows if one is drawn."""
    ids = resample(docs, target, **options).filter("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}')"
_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
OP11_SQL = f"""
WITH crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT range::BIGINT AS i FROM range(256))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
fd AS (SELECT r, unnest({_GRAMS}) AS f FROM d), fb AS (SELECT unnest({_GRAMS}) AS f FROM b),
v AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
bu AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
         lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM v, crc),
sd AS (SELECT bucket, count(*) AS s FROM fd JOIN bu USING (f) GROUP BY bucket), sb AS (SELECT bucket, count(*) AS t FROM fb JOIN bu USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fd) + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fb) + {BUCKETS}))))::BIGINT AS gain FROM sd FULL JOIN sb USING (bucket)),
n AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM fd JOIN bu USING (f) JOIN g USING (bucket) GROUP BY r),
s AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN n USING (r)),
k AS (SELECT *, words >= {MIN_WORDS} AS able, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * (SELECT count(*) FROM k WHERE able) // 100 THEN place END AS rank FROM k
"""
