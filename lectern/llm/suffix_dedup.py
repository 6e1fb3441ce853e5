"""Removal of repeated passages with a range-partitioned suffix array.

Every byte covered by a SPAN-byte string that also starts in a document with a
smaller id goes. A suffix array of all positions would be many times the size of the
texts, so a filter first finds the places that can matter: in each window of SPAN
bytes the KEY-byte string of smallest hash is an anchor, so two documents that share
SPAN bytes share an anchor at the same place in them. Anchors that one text alone
has drop out, and with them most positions.

1. The starts that belong to one shared anchor form a run with its context (all bytes
   that its strings cover). Of equal contexts, told apart by a 128-bit digest, only
   one goes on, with the smallest document that has it: all others lose the whole run.
2. Contexts are range-partitioned by their leading token, the KEY bytes at the
   anchor, with splitters that Spark samples. A token is never split, so strings that
   are equal lie in one bucket and no comparison has to cross a border.
3. Each bucket sorts the suffixes of its contexts, one at each start, by multikey
   quicksort on their bytes. Neighbours that agree in SPAN bytes are equal strings, and
   all but those of the smallest document are lost.

A token with more than HOT contexts would make a bucket too large. Its strings are
dealt by their bytes instead, with the smallest document of each taken on the map side.
Exact copies of a text are covered by its smallest document and take no part. Texts
are told apart by a 64-bit hash in the filter; all later comparisons are of bytes or digests.

Edge cases: null text is empty; texts shorter than SPAN lose nothing and texts of
any length are read whole; rows that repeat a doc_id never remove each other; rows
without a doc_id are left as they are; an empty table gives an empty result; other
columns, whatever their names, are ignored, or kept as they are by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.llm._spark import TEXT_ROWS, Scratch, fresh, table
from lectern.llm._text import U, Slice, mix, signed, slices

SPAN = 50
KEY = 24
WINDOW = SPAN - KEY + 1
#: Contexts of one token that a bucket takes.
HOT = 40_000
#: Suffixes that are sorted at once, those of one token aside, and those that no longer need to be divided.
SUFFIXES = 1_000_000
SMALL = 8192
#: Where the eight-byte characters of a suffix lie; the last one overlaps.
PLACES = (*range(0, SPAN - 7, 8), SPAN - 8)
#: One text in so many gives the splitters.
SAMPLE = 64
CELLS = 1024
ANCHORS = "token long, version long"


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w neighbours."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1]) if size < w else m


class Runs:
    """The starts of a slice's SPAN-byte strings in runs with one anchor."""

    def __init__(self, s: Slice):
        self.slice, n = s, len(s.data)
        empty = np.zeros(0, dtype=np.int64)
        self.start = self.stop = self.row = empty
        self.token = np.zeros(0, dtype=U)
        if n < SPAN:
            return
        h = self.hashes = s.sliding(KEY)
        least = _window_min(h, WINDOW)
        valid = np.zeros(n + 1, dtype=np.int8)
        long = np.flatnonzero(np.diff(s.offs) >= SPAN)
        np.add.at(valid, s.offs[long], 1)
        np.add.at(valid, s.offs[long + 1] - SPAN + 1, -1)
        valid = np.cumsum(valid[: len(least)]) > 0
        # A start that is an anchor itself is the last one of that anchor.
        new = np.append(True, (least[1:] != least[:-1]) | ~valid[:-1] | (h[: len(least) - 1] == least[:-1]))
        doc_start = s.offs[:-1][s.offs[:-1] < len(least)]
        new[doc_start] = True
        first = np.flatnonzero(new & valid)
        end = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
        self.start, self.stop, self.token = first, end, least[first]
        self.row = np.searchsorted(s.offs, first, side="right") - 1

    def anchors(self, runs: np.ndarray) -> np.ndarray:
        """Where the token of each of these runs stands: the first place from the run's last start on."""
        h, last = self.hashes, self.stop[runs] - 1
        out = np.full(len(runs), -1)
        for shift in range(WINDOW):
            spot = np.minimum(last + shift, len(h) - 1)
            out = np.where((out < 0) & (h[spot] == self.token[runs]), spot, out)
        return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, version) of the sampled suffixes."""
    seen: set[int] = set()
    for b in batches:
        versions = b.column("version").to_numpy()
        for s in slices(b.column("text")):
            own = versions[s.first : s.first + s.rows]
            new = np.zeros(s.rows, dtype=bool)
            for i, v in enumerate(own.tolist()):  # a text speaks once per task for all its copies
                new[i] = v not in seen
                seen.add(v)
            r = Runs(s)
            ok = np.flatnonzero(new[r.row])
            _, once = np.unique(mix(r.token[ok] + r.row[ok].astype(U)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(r.token[ok][once])), pa.array(own[r.row[ok][once]])], ["token", "version"])


def _bucket(keyed: DataFrame, buckets: int):
    """A column: which of the equally filled ranges of tokens a token lies in.

    Splitters are quantiles of the tokens of a sample of texts, rounded to CELLS cells
    of the range of tokens, so a row finds its bucket in a table by its leading bits.
    """
    sample = keyed.filter(F.pmod("version", F.lit(SAMPLE)) == 0).mapInArrow(_anchors, ANCHORS)
    found = sample.select(F.percentile_approx("token", [i / buckets for i in range(1, buckets)], 10_000).alias("p")).first()["p"] if buckets > 1 else []
    starts = (np.arange(CELLS, dtype=np.int64) - CELLS // 2) * ((1 << 64) // CELLS)
    table = np.searchsorted(np.sort(np.array(found or [], dtype=np.int64)), starts, side="right")
    cell = F.shiftright("token", 64 - (CELLS.bit_length() - 1)) + CELLS // 2
    return F.element_at(F.array(*[F.lit(int(x)) for x in table]), (cell + 1).cast("int"))


def _neighbours(columns: list[str], emit):
    """Streams rows sorted by (first column, doc); `emit` sees arrays with the row before and after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        smallest = None
        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}
            if held is not None:
                x = {c: np.append(held[c], x[c]) for c in columns}
            out, smallest, held = emit(x, smallest, last=False)
            yield out
        if held is not None:
            yield emit(held, smallest, last=True)[0]

    return run


def _shared(x: dict[str, np.ndarray], before, last: bool):
    """Rows whose token also occurs in another text, once each. `before`: whether the row held back is known to be one."""
    equal = x["token"][1:] == x["token"][:-1]
    same = equal & (x["version"][1:] == x["version"][:-1])
    hit = np.zeros(len(x["token"]), dtype=bool)
    hit[1:] |= equal & ~same
    hit[:-1] |= equal & ~same
    hit[0] |= bool(before)
    # Of equal rows the last one speaks, and knows what the first one saw.
    for i in np.flatnonzero(same):
        hit[i + 1] |= hit[i]
    n = len(hit) if last else len(hit) - 1
    keep = np.flatnonzero(hit[:n] & ~np.append(same, False)[:n])
    out = pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in ("token", "version")], ["token", "version"])
    return out, hit[-1], {c: v[-1:] for c, v in x.items()}


def _runs_of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = b.column("tokens")
        size = np.diff(hits.offsets.to_numpy())
        values = hits.flatten().to_numpy(zero_copy_only=False).view(U)
        bounds = np.append(0, np.cumsum(size))
        doc, version = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
        for s in slices(b.column("text")):
            r = Runs(s)
            rows = np.arange(s.first, s.first + s.rows)
            wanted = mix(values[bounds[s.first] : bounds[s.first + s.rows]] + np.repeat(rows - s.first, size[rows]).astype(U))
            ok = np.flatnonzero(np.isin(mix(r.token + r.row.astype(U)), wanted))
            row, start, stop = r.row[ok], r.start[ok], r.stop[ok]
            raw = s.data.tobytes()
            digest = [hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), (stop + SPAN - 1).tolist(), strict=True)]
            arrays = [signed(r.token[ok]), doc[s.first + row], version[s.first + row], (start - s.offs[row]).astype(np.int32), (stop - start).astype(np.int32), (r.anchors(ok) - start).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(digest, pa.binary())], ["token", "doc", "version", "start", "n", "anchor", "context"])


RUNS = "token long, doc long, version long, start int, n int, anchor int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each text's open contexts and their leading tokens, each context once."""
    names = ["context", "least", "k", "lead", "data"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows = []
            for r in b.slice(at, 256).to_pylist():
                raw = r["text"].encode()
                for x in {x["context"]: x for x in r["runs"]}.values():
                    data, a = raw[x["start"] : x["start"] + x["n"] + SPAN - 1], x["anchor"]
                    rows.append((x["context"], r["doc"], x["k"], data[a : a + KEY], data))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)


def multikey_quicksort(chunks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the SPAN-byte strings at these places, and where in it a string differs from the one before.

    `chunks` has the eight bytes from each place on. A part is divided by one character
    of its strings into the smaller, the equal and the larger ones; the equal ones go on
    with the next character. Small parts are sorted by all characters that are left.
    """
    order, new = np.arange(len(at)), np.zeros(len(at), dtype=bool)
    new[:1] = True
    parts = [(0, len(at), 0)]
    while parts:
        low, high, depth = parts.pop()
        if high - low < 2 or depth == len(PLACES):
            continue
        own = order[low:high]
        if high - low <= SMALL:
            keys = [chunks[at[own] + place].byteswap() for place in PLACES[depth:]]
            found = np.lexsort(keys[::-1])
            order[low:high] = own[found]
            for k in keys:
                new[low + 1 : high] |= k[found[1:]] != k[found[:-1]]
            continue
        key = chunks[at[own] + PLACES[depth]].byteswap()
        pivot = np.sort(key[:: (high - low) // 31])[16]
        smaller, larger = key < pivot, key > pivot
        order[low:high] = np.concatenate([own[smaller], own[~(smaller | larger)], own[larger]])
        a, b = low + int(smaller.sum()), high - int(larger.sum())
        new[a] = True
        new[min(b, high - 1)] |= b < high
        parts += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order, new


def _starts(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The row, and the number in it, of every SPAN-byte string of these contexts."""
    n = np.maximum(np.diff(s.offs) - SPAN + 1, 0)
    row = np.repeat(np.arange(s.rows), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _lost_of(rows: pa.Table) -> pa.RecordBatch:
    """context and the numbers of its strings that a smaller document has, of contexts whose tokens are all here."""
    doc, out = rows.column("least").to_numpy(), []
    contexts = rows.column("context").to_pylist()
    for s in slices(rows.column("data"), 1 << 40):
        row, k = _starts(s)
        order, new = multikey_quicksort(s.chunks(False), s.offs[row] + k)
        own = doc[row[order]]
        first = np.flatnonzero(new)
        lost = np.zeros(len(order), dtype=bool)
        if len(order):
            lost[order] = own > np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(order))))
        hit = np.flatnonzero(lost)
        cut = np.flatnonzero(np.append(True, row[hit][1:] != row[hit][:-1])) if len(hit) else []
        out += [(contexts[row[hit[a]]], k[hit[a:z]]) for a, z in zip(cut, np.append(cut, len(hit))[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([x.astype(np.int32) for _, x in out], pa.list_(pa.int32()))], ["context", "lost"])


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_lost_of` for a bucket that comes in the order of its leading tokens, some whole tokens at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column("data").nbytes
        if n < SUFFIXES * 5:  # a context has as many bytes as five of its suffixes on average, about
            continue
        rows = pa.Table.from_batches(held)
        leads = rows.column("lead").to_pylist()
        cut = len(leads)
        while cut and leads[cut - 1] == leads[-1]:
            cut -= 1
        if cut:
            yield _lost_of(rows.slice(0, cut).combine_chunks())
        held, n = rows.slice(cut).to_batches(), rows.slice(cut).nbytes
    if held:
        yield _lost_of(pa.Table.from_batches(held).combine_chunks())


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        contexts, least = b.column("context").to_pylist(), b.column("least").to_numpy()
        for s in slices(b.column("data")):
            row, k = _starts(s)
            raw = s.data.tobytes()
            data = [raw[a : a + SPAN] for a in (s.offs[row] + k).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array([contexts[s.first + r] for r in row], pa.binary()), pa.array(least[s.first + row]), pa.array(k.astype(np.int32))], ["string", "context", "least", "k"])


def lost_strings(contexts: DataFrame, hot: int = HOT) -> DataFrame:
    """context and lost: the strings of each context (context, least, k, lead, data) that a smaller document has; k contexts have its token."""
    n, shared = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), contexts
    buckets = shared.filter(f"k <= {hot}").select("context", "least", "data", "lead").repartitionByRange(n, "lead").sortWithinPartitions("lead")
    sorted_ones = buckets.mapInArrow(_lost, "context binary, lost array<int>")
    strings = shared.filter(f"k > {hot}").select("context", "least", "data").mapInArrow(_strings, "string binary, context binary, least long, k int")
    first = strings.groupBy("string").agg(F.min("least").alias("first"))
    dealt = strings.join(first, "string").filter("least > first").groupBy("context").agg(F.collect_list("k").alias("lost"))
    return sorted_ones.unionByName(dealt)


def _removed(size: int, spans) -> np.ndarray:
    """Which bytes of a text of this size go."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for start, n in spans or ():
        edge[start] += 1
        edge[min(size, start + n + SPAN - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, its text, and a hash of the text that tells rows with one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, version and spans (start and number of SPAN-byte strings, in bytes) of the documents that lose something."""
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs).filter("doc IS NOT NULL")
    digests = keyed.select("doc", "version", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest")).filter(f"size >= {SPAN}")
    digests = scratch.keep(digests, "digests")
    originals = digests.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("digest", "least")
    copies = scratch.keep(digests.join(originals, "digest").filter("doc > least").select("doc", "version", "size").distinct(), "copies")

    source, n = keyed.select("version", "text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = source.mapInArrow(_anchors, ANCHORS).repartitionById(n, _bucket(source, n)).sortWithinPartitions("token", "version")
    hits = scratch.keep(buckets.mapInArrow(_neighbours(["token", "version"], _shared), "token long, version long"), "hits")
    scratch.sweep()

    per_text = hits.groupBy("version").agg(F.collect_list("token").alias("tokens"))
    fresh = keyed.join(per_text, "version").join(copies.select("doc", "version"), ["doc", "version"], "left_anti").select("doc", "version", "text", "tokens")
    runs = scratch.keep(fresh.mapInArrow(_runs_of_hits, RUNS), "runs", TEXT_ROWS)
    scratch.forget("hits")
    scratch.sweep()

    contexts = scratch.keep(runs.groupBy("token", "context").agg(F.min("doc").alias("least"), F.max("doc").alias("most")), "contexts")
    scratch.sweep()
    several = contexts.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    judged = contexts.join(several, "token", "left").filter("most > least OR k > 1").select("context", "least", "k")
    settled = runs.select("context", "doc", "version", "start", "n", "anchor").join(judged, "context").filter("doc > least OR k > 1")
    gone = F.col("doc") > F.col("least")
    # What is settled needs only its place.
    settled = scratch.keep(settled.select(F.when(~gone, F.col("context")).alias("context"), "doc", "version", "start", "n", F.when(~gone, F.col("anchor")).alias("anchor"), F.when(~gone, F.col("k")).alias("k")), "settled")
    scratch.forget("runs", "contexts")
    scratch.sweep()

    left = settled.filter("context IS NOT NULL")
    per_text = left.groupBy("doc", "version").agg(F.collect_list(F.struct("context", "start", "n", "anchor", "k")).alias("runs"))
    cut = keyed.join(per_text, ["doc", "version"]).select("doc", "text", "runs").mapInArrow(_contexts, "context binary, least long, k long, lead binary, data binary")
    cut = scratch.keep(cut, "cut", TEXT_ROWS)
    scratch.sweep()
    lost = scratch.keep(lost_strings(cut), "lost")
    scratch.forget("cut")
    scratch.sweep()
    shifted = F.transform("lost", lambda k: (F.col("start") + k).cast("long"))
    later = left.join(lost, "context").select("doc", "version", F.explode(shifted).alias("start"), F.lit(1).cast("long").alias("n"))
    plain = settled.filter("context IS NULL").select("doc", "version", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))

    whole = copies.select("doc", "version", F.lit(0).cast("long").alias("start"), (F.col("size") - SPAN + 1).cast("long").alias("n"))
    spans = plain.unionByName(later).unionByName(whole)
    out = scratch.keep(spans.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    scratch.forget("settled", "lost", "digests", "copies")
    scratch.sweep()
    return out


def remaining(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, gone, n in _cut(batches):
            arrays = [doc, pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _keyed(docs).join(repeated_spans(docs), ["doc", "version"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _cut(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            data, gone, n = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                g = _removed(len(raw), [(x["start"], x["n"]) for x in spans or ()])
                data.append(raw[~g].tobytes())
                gone.append(g)
                n.append(int(np.sum(g & ~np.append(False, g[:-1]))) if len(g) else 0)
            yield part.column(0), data, gone, n


def digests_of_kept(docs: DataFrame) -> DataFrame:
    """As `remaining`, with the SHA-256 of the kept bytes in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, gone, n in _cut(batches):
            arrays = [doc, pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _keyed(docs).join(repeated_spans(docs), ["doc", "version"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@F.arrow_udf(StringType())
def _kept_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or not found:
            out.append(text)
            continue
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        out.append(raw[~_removed(len(raw), [(x["start"], x["n"]) for x in found])].tobytes().decode(errors="ignore"))
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the text that remains, cut down to whole characters, and n_chars to match if there is such a column."""
    doc, version, spans = (fresh(docs, x) for x in ("spans_doc", "spans_version", "spans"))
    found = repeated_spans(docs).select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("spans").alias(spans))
    same = (docs["doc_id"] == found[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[version])
    out = docs.join(found, same, "left").withColumn("text", _kept_text("text", spans))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of_kept(table(spark, sf_dir, "documents"))
