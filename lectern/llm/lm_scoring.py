"""Language-model scoring with a gated recurrent network over words.

Words of the whole corpus are counted first. The most frequent words are outputs of
their own, the others share classes by their last two bytes; `sizes` says how both
grow with the vocabulary.
The output softmax is factored: a class given the state, then a word given class
and state for head words, or given the class alone, by its count, for the others.
Output biases start from the counts, so training only adds what context tells.

Texts are cut into words once, block by block: a block's documents become numbers
of the block's own dictionary. Its words meet those of other blocks in a shuffle, so counts
of rare words are never broadcast, and come back to the block, where documents become
symbols of the network. Training and scoring read symbols only.

Training is truncated backpropagation in numpy, one pass over all training documents
in rounds. Documents are dealt into shards by their id. In each round every shard of
the round is trained on from the same parameters, and the changes are averaged by
tokens, so the result does not depend on how rows lie in files or tasks. Documents
run one after the other in streams side by side; the state starts anew with each.
Scoring carries the state of each document across windows, so the log-likelihood
covers complete documents.

Edge cases: null and empty texts consist of the end token; texts of any length are
scored whole; rows without doc_id are not held out: they are counted, learned from and
scored; repeated rows are scored one by one; without training rows the base
is uniform over the one unseen word; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm._spark import TEXT_ROWS, Scratch, split_by, table, texts
from lectern.llm._text import Slice, slices

HIDDEN = 16
LEAST_HEAD = 1024
#: Steps of a window: of truncated backpropagation, and in scoring.
STEPS = 24
SCORE_STEPS = 32
ABREAST = 512
SCORE_ABREAST = 1024
#: Windows that a shard should have at least, so that it takes some steps however small it is.
TRAIN_WINDOWS = 160
#: Rows of states that the softmax takes at once.
SOFTMAX_ROWS = 1024
#: Bytes of text of a block, long single texts aside.
BLOCK_BYTES = 32 << 20
#: Bytes of text that are cut into words at once, long single texts aside.
PART_BYTES = 12 << 20
#: Tokens of a training shard, and that a scoring task holds at once, long single texts aside.
SHARD_TOKENS = 2_000_000
#: Floats of one row of parameter changes.
SLICE = 1 << 18
ROUNDS = 3
RATE = 0.1
SMOOTH = 0.1
#: No weight of an output leaves this range, so that no exponential overflows.
LIMIT = 4.0
#: The end of a document; no word contains white space.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def sizes(distinct: int) -> tuple[int, int, int]:
    """Head words, head words of a class, and tail classes for a vocabulary: they grow with its square root, or the root of that."""
    head = max(LEAST_HEAD, 2 * math.isqrt(distinct))
    group = 1 << round(math.log2(head) / 2)
    return head, group, group


def tail_class(ends, tail: int):
    """One of the `tail` classes of words outside the head, from the last byte and 256 times the one before it (0 where there is none)."""
    return ((ends & 255) + 31 * (ends >> 8)) % tail


class Vocabulary:
    """Head words and the classes: `group` head words to a class, then the tail classes."""

    def __init__(self, head: list[tuple[str, int]], tail_mass: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.group, self.tail = sizes(distinct)[1], len(tail_mass)
        self.count = np.array([c for _, c in head], dtype=np.float64)
        self.groups = max(1, -(-len(head) // self.group))
        self.classes = self.groups + self.tail
        #: Symbols: head words, tail classes, the start of a document.
        self.head = self.groups * self.group
        self.start = self.head + self.tail
        self.symbol = "<u2" if self.start < 1 << 16 else "<u4"
        mass = np.zeros(self.head)
        mass[: len(head)] = self.count + SMOOTH
        self.word_bias = np.full(self.head, -30.0)
        self.word_bias[: len(head)] = np.log(mass[: len(head)])
        # An unseen word belongs to a tail class, so each keeps the share of one unseen word.
        self.tail_mass = tail_mass + SMOOTH
        self.class_bias = np.log(np.append(np.maximum(mass.reshape(self.groups, self.group).sum(axis=1), 1e-9), self.tail_mass))
        self.class_bias -= self.class_bias.max()
        word = self.word_bias.reshape(self.groups, self.group)
        self.word_bias = word - word.max(axis=1, keepdims=True)

    def base(self, count):
        return np.log10((np.asarray(count) + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))


class Gru:
    """Parameters and passes of the network; symbols are head words and tail classes."""

    def __init__(self, v: Vocabulary, params: dict[str, np.ndarray] | None = None):
        self.v = v
        rng, h = np.random.default_rng(5), HIDDEN
        self.p = params or {
            "emb": rng.normal(0, 0.1, (v.start + 1, 3 * h)).astype(np.float32),
            "rec": rng.normal(0, 0.2, (h, 3 * h)).astype(np.float32),
            # The last row of an output is its bias: states end with a one.
            "cls": np.zeros((h + 1, v.classes), dtype=np.float32),
            "word": np.zeros((v.groups, h + 1, v.group), dtype=np.float32),
        }
        if params is None:
            self.p["cls"][h], self.p["word"][:, h] = v.class_bias, v.word_bias

    def run(self, x: np.ndarray, first: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, units, rows) after each of the symbols x (steps, rows) from state h (units, rows); where `first`, a document begins.

        Units come before rows, so that every gate is one stretch of memory.
        """
        n, rec = HIDDEN, np.ascontiguousarray(self.p["rec"].T)
        inputs, starts = np.ascontiguousarray(self.p["emb"][x].transpose(0, 2, 1)), first.any(axis=1)
        out = np.empty((len(x), n, x.shape[1]), dtype=np.float32)
        for t in range(len(x)):
            if starts[t]:
                h = h * ~first[t]
            r = rec @ h
            gate, c = inputs[t, : 2 * n], inputs[t, 2 * n :]
            gate += r[: 2 * n]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            c += gate[n:] * r[2 * n :]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((h, gate[:n], gate[n:], c, r[2 * n :]))
            new = out[t]
            np.subtract(c, h, out=new)
            new *= gate[:n]
            new += h
            h = new
        return out

    @staticmethod
    def rows(states: np.ndarray, use: np.ndarray) -> np.ndarray:
        """The states at these places of (steps, rows), one after the other."""
        flat = states.transpose(0, 2, 1).reshape(-1, HIDDEN)
        return flat if len(use) == len(flat) else flat[use]

    def losses(self, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of symbols y from states h (both flat). With `grads`, adds the gradients of minus their sum there and returns that of h."""
        v, p, n = self.v, self.p, HIDDEN
        states = np.ones((len(h), n + 1), dtype=np.float32)
        states[:, :n] = h
        tail = y >= v.head
        cls = np.where(tail, v.groups + y - v.head, y // v.group)
        out, dh = np.empty(len(y), dtype=np.float32), None if grads is None else np.empty_like(h)
        for i in range(0, len(y), SOFTMAX_ROWS):
            part = slice(i, i + SOFTMAX_ROWS)
            out[part], back = self._softmax(states[part], p["cls"], cls[part], None if grads is None else grads["cls"])
            if grads is not None:
                dh[part] = back
        order = np.flatnonzero(~tail)
        order = order[np.argsort(cls[order].astype(np.int16), kind="stable")]
        states, own, at = states[order], cls[order], y[order] % v.group
        ln, back = np.empty(len(order), dtype=np.float32), None if grads is None else np.empty((len(order), n), dtype=np.float32)
        bounds = np.flatnonzero(np.diff(own, prepend=-1, append=-1)).tolist() if len(order) else []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            g = own[i]
            ln[i:j], found = self._softmax(states[i:j], p["word"][g], at[i:j], None if grads is None else grads["word"][g])
            if grads is not None:
                back[i:j] = found
        out[order] += ln
        if grads is not None:
            dh[order] += back
        return out, dh

    def _softmax(self, states: np.ndarray, w: np.ndarray, y: np.ndarray, grad: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of columns y; adds the gradient of minus their sum to `grad` and returns that of the states."""
        a = states @ w
        at = np.arange(len(y)), y
        ln = a[at]
        np.exp(a, out=a)
        total = a @ np.ones(a.shape[1], dtype=np.float32)
        ln -= np.log(total)
        if grad is None:
            return ln, None
        # The wide array is left as it is; what is narrow is divided by the totals.
        a[at] -= total
        total = np.reciprocal(total)[:, None]
        grad += (states * total).T @ a
        back = a @ w[:HIDDEN].T
        back *= total
        return ln, back

    def train(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, live: np.ndarray, h: np.ndarray, rate: float, memory: dict[str, np.ndarray]) -> np.ndarray:
        """One truncated window: forward, backward, an Adagrad step. Returns the state to go on with."""
        n, p, trace = HIDDEN, self.p, []
        states = self.run(x, first, h, trace)
        use = np.flatnonzero(live.ravel())
        grads = {k: np.zeros_like(p[k]) for k in ("rec", "cls", "word")}
        dh = np.zeros((x.size, n), dtype=np.float32)
        dh[use] = self.losses(self.rows(states, use), y.ravel()[use], grads)[1]
        dh = np.ascontiguousarray(dh.reshape(*x.shape, n).transpose(0, 2, 1))
        de, back = np.empty((len(x), 3 * n, x.shape[1]), dtype=np.float32), np.zeros_like(h)
        for t in reversed(range(len(x))):
            prev, z, s, c, rc = trace[t]
            dn, d = dh[t], de[t]
            dn += back
            dz, ds, dc = d[:n], d[n : 2 * n], d[2 * n :]
            keep = 1 - z
            np.multiply(dn, z, out=dc)
            np.subtract(c, prev, out=dz)
            dz *= dc
            dz *= keep
            dc *= 1 - c * c
            np.multiply(dc, s, out=ds)
            dr = np.concatenate([d[:n], ds, ds])
            dr_s = dr[n : 2 * n]
            dr_s *= rc
            dr_s *= 1 - s
            ds[:] = dr_s
            grads["rec"] += prev @ dr.T
            back = p["rec"] @ dr
            dn *= keep
            back += dn
            if first[t].any():
                back *= ~first[t]
        scale = np.float32(1 / max(1, len(use)))

        def step(k: str, at, g: np.ndarray) -> None:
            """An Adagrad step of the rows `at` of a parameter."""
            g *= scale
            seen = memory[k][at] + g * g
            memory[k][at] = seen
            np.sqrt(seen, out=seen)
            seen += 1e-4
            g /= seen
            g *= rate
            p[k][at] -= g
            if k != "emb":
                np.minimum(p[k], LIMIT, out=p[k])
                weights = p[k][..., :n, :]  # all rows but the biases
                np.maximum(weights, -LIMIT, out=weights)

        # Only symbols of this window have a gradient in the embeddings.
        order = np.argsort(x.ravel().astype(np.uint16) if self.v.start < 1 << 16 else x.ravel(), kind="stable")
        symbols, begin = np.unique(x.ravel()[order], return_index=True)
        step("emb", symbols, np.add.reduceat(de.transpose(0, 2, 1).reshape(-1, 3 * n)[order], begin, axis=0))
        for k, g in grads.items():
            step(k, slice(None), g)
        return states[-1]


class Streams:
    """Documents one after the other in streams of about the same length, side by side."""

    def __init__(self, docs: list[np.ndarray], width: int, start: int):
        length = np.array([len(d) for d in docs])
        loads = [(0, k) for k in range(min(width, len(docs)))]
        rows: list[list[int]] = [[] for _ in loads]
        for i in np.argsort(-length, kind="stable").tolist():
            load, k = loads[0]
            rows[k].append(i)
            heapq.heapreplace(loads, (load + int(length[i]), k))
        rows.sort(key=lambda r: -sum(int(length[i]) for i in r))
        rng = np.random.default_rng(23)
        for r in rows:  # long documents would come first, and short ones have the last word in training
            rng.shuffle(r)
        self.order = [i for r in rows for i in r]
        self.y = np.concatenate([docs[i] for i in self.order]).astype(np.int32)
        self.at = np.append(0, np.cumsum(length[self.order]))[:-1]
        self.first = np.zeros(len(self.y), dtype=bool)
        self.first[self.at] = True
        self.x = np.append(start, self.y[:-1]).astype(np.int32)
        self.x[self.at] = start
        self.size = np.array([sum(int(length[i]) for i in r) for r in rows])
        self.begin = np.append(0, np.cumsum(self.size))[:-1]

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (steps, streams) in x and y, and which of them are live; streams that have ended drop out at the end of the row."""
        for t in range(0, int(self.size[0]), steps):
            open_ones = int(np.count_nonzero(self.size > t))
            k = np.arange(t, min(t + steps, int(self.size[0])))[:, None]
            live = k < self.size[:open_ones]
            yield np.where(live, self.begin[:open_ones] + k, 0), live


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their block's dictionary, and the dictionary with counts in training rows."""
    task, block, held, n_bytes, find = TaskContext.get().partitionId(), 0, [], 0, {END: 0}
    for b in batches:
        for s in slices(b.column("text"), PART_BYTES):
            held += zip(*(b.column(c).slice(s.first, s.rows).to_pylist() for c in ("doc_id", "held_out")), _numbered(s, find), strict=True)
            n_bytes += len(s.data)
            if n_bytes >= BLOCK_BYTES:
                yield from _block_rows((task << 20) + block, held, find)
                block, held, n_bytes, find = block + 1, [], 0, {END: 0}
    if held:
        yield from _block_rows((task << 20) + block, held, find)


def _numbered(s: Slice, find: dict[bytes, int]) -> list[np.ndarray]:
    """Each text's words and the end as numbers of the dictionary `find`, which grows with them."""
    starts, ends, row = s.words()
    edges, n = np.empty(2 * len(starts) + 1, dtype=np.int64), len(starts)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if n else 0
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(edges), pa.py_buffer(s.lowered())])
    coded = every.take(pa.array(np.arange(0, 2 * n, 2))).dictionary_encode()
    _, places, raw = coded.dictionary.buffers()
    cuts, raw = np.frombuffer(places, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), (raw or pa.py_buffer(b"")).to_pybytes()
    known = np.array([find.setdefault(raw[a:z], len(find)) for a, z in zip(cuts, cuts[1:], strict=False)], dtype=np.int32)
    numbers = known[coded.indices.to_numpy()] if n else np.zeros(0, dtype=np.int32)
    cut = np.searchsorted(row, np.arange(s.rows + 1))
    return [np.append(numbers[a:z], np.int32(0)) for a, z in zip(cut[:-1], cut[1:], strict=True)]


BLOCK_ROWS = "block long, doc_id long, held_out boolean, ids binary, word string, ends int, local int, n long"


def _block_rows(block: int, held: list[tuple], find: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.string(), "ends": pa.int32(), "local": pa.int32(), "n": pa.int64()}

    def batch(size: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[k], kind) if k in columns else pa.nulls(size, kind) for k, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    count = np.zeros(len(find), dtype=np.int64)
    learned = [ids for _, apart, ids in held if not apart]
    if learned:
        count += np.bincount(np.concatenate(learned), minlength=len(find))
    for at in range(0, len(held), 500):
        part = held[at : at + 500]
        yield batch(len(part), block=[block] * len(part), doc_id=[d for d, _, _ in part], held_out=[a for _, a, _ in part], ids=[i.astype("<i4").tobytes() for _, _, i in part])
    words = list(find)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        ends = [w[-1] + (256 * w[-2] if len(w) > 1 else 0) for w in part]
        yield batch(len(part), block=[block] * len(part), word=part, ends=ends, local=range(at, at + len(part)), n=count[at : at + len(part)])


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary"


def _code_block(v: Vocabulary):
    """Documents of a block and its dictionary with corpus counts, to symbols and what counts alone decide."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        local = words.column("local").to_numpy()
        total, symbol = np.zeros(len(local)), np.zeros(len(local), dtype=np.int64)
        total[local], symbol[local] = words.column("total").to_numpy(), words.column("symbol").to_numpy()
        found = [np.frombuffer(x, dtype="<i4") for x in docs.column("ids").to_pylist()]
        if not found:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())], ["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols"])
        length = np.array([len(x) for x in found])
        ids, at = np.concatenate(found), np.append(0, np.cumsum(length))[:-1]
        tail = symbol >= v.head
        inner = np.where(tail, np.log10((total + SMOOTH) / v.tail_mass[np.where(tail, symbol - v.head, 0)]), 0.0)
        sums = lambda x: np.add.reduceat(x[ids], at)
        raw, width = symbol.astype(v.symbol)[ids].tobytes(), np.dtype(v.symbol).itemsize
        codes = [raw[a * width : (a + n) * width] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        arrays = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(length, pa.int64()), pa.array(sums((total > 0).astype(np.int64)), pa.int64())]
        arrays += [pa.array(sums(v.base(total))), pa.array(sums(inner)), pa.array(codes, pa.binary())]
        return pa.Table.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols"])

    return run


def _train_shard(v: Vocabulary, params: dict[str, np.ndarray], rate: float):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = sorted(zip(docs.column("doc_id").to_pylist(), docs.column("symbols").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0], r[1]))
        texts = [np.frombuffer(s, dtype=v.symbol) for _, s in found]
        width = min(ABREAST, max(32, sum(map(len, texts)) // (STEPS * TRAIN_WINDOWS)))
        model, streams = Gru(v, {k: w.copy() for k, w in params.items()}), Streams(texts, width, v.start)
        memory = {k: np.full_like(w, 1e-5) for k, w in params.items()}
        h = np.zeros((HIDDEN, len(streams.size)), dtype=np.float32)
        for at, live in streams.windows(STEPS):
            h = model.train(streams.x[at], streams.y[at], streams.first[at] & live, live, h[:, : at.shape[1]], rate, memory)
        rows: list[tuple] = []
        for k, w in model.p.items():
            change = ((w - params[k]) * len(streams.y)).astype("<f4").ravel()
            rows += [(k, i, key[0].as_py(), len(streams.y), change[a : a + SLICE].tobytes()) for i, a in enumerate(range(0, len(change), SLICE))]
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["name", "slice", "shard", "n", "change"])

    return run


def _sum_changes(found: pd.DataFrame) -> pd.DataFrame:
    found = found.sort_values("shard")
    total = np.zeros(len(found["change"].iloc[0]) // 4)
    for c in found["change"]:
        total += np.frombuffer(c, dtype="<f4")
    one = found.iloc[:1]
    return pd.DataFrame({"name": one["name"], "slice": one["slice"], "shard": one["shard"], "n": [int(found["n"].sum())], "change": [total.astype("<f4").tobytes()]})


def training_rounds(coded: DataFrame) -> list[DataFrame]:
    """The training documents of each round with their shard: every one of them is in just one shard."""
    learned = coded.filter(~F.col("held_out"))
    n = learned.agg(F.sum("n_tokens")).first()[0] or 0
    shards = ROUNDS * max(1, -(-int(n) // (ROUNDS * SHARD_TOKENS)))
    dealt = learned.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)))
    return [dealt.filter(F.pmod("shard", F.lit(ROUNDS)) == i) for i in range(ROUNDS)]


def train(rounds: list[DataFrame], v: Vocabulary) -> dict[str, np.ndarray]:
    """Rounds of local training and averaging over the rows (doc_id, symbols, shard) of each."""
    params = Gru(v).p
    shape = "name string, slice long, shard long, n long, change binary"
    for turn, rows in enumerate(rounds):
        changes = rows.select("doc_id", "symbols", "shard").groupBy("shard").applyInArrow(_train_shard(v, params, RATE / (1 + turn)), shape)
        # Two levels, so that no task adds up more than a share of the changes.
        first = changes.withColumn("part", F.pmod("shard", F.lit(16 * ROUNDS))).groupBy("name", "slice", "part").applyInPandas(_sum_changes, shape)
        for r in first.groupBy("name", "slice").applyInPandas(_sum_changes, shape).collect():
            mean = np.frombuffer(r["change"], dtype="<f4") / max(1, r["n"])
            at = r["slice"] * SLICE
            params[r["name"]].reshape(-1)[at : at + len(mean)] += mean.astype(np.float32)
    return params


def log_likelihoods(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbols of each whole document."""
    streams = Streams(docs, SCORE_ABREAST, model.v.start)
    ln, h = np.zeros(len(streams.y)), np.zeros((HIDDEN, len(streams.size)), dtype=np.float32)
    for at, live in streams.windows(SCORE_STEPS):
        states = model.run(streams.x[at], streams.first[at] & live, h[:, : at.shape[1]])
        h, use = states[-1], np.flatnonzero(live.ravel())
        places = at.ravel()[use]
        ln[places] = model.losses(model.rows(states, use), streams.y[places])[0]
    out = np.empty(len(docs))
    out[streams.order] = np.add.reduceat(ln, streams.at) / np.log(10)
    return out


def _score(v: Vocabulary, params: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(v, params)
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += sum(b.column("n_tokens").to_pylist())
            if n >= SHARD_TOKENS:
                yield scored(model, held)
                held, n = [], 0
        if held:
            yield scored(model, held)

    def scored(model: Gru, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        take = lambda name: rows.column(name).combine_chunks()
        docs = [np.frombuffer(s, dtype=v.symbol) for s in rows.column("symbols").to_pylist()]
        score = rows.column("inner").to_numpy() + (log_likelihoods(model, docs) if docs else 0)
        arrays = [take("doc_id"), take("held_out"), take("n_tokens"), take("n_known"), pa.array([v.total] * len(docs), pa.int64()), take("base"), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """One row of counts and scores for each row of `docs`; rows where `held_out` is true are not learned from."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = texts(docs).withColumn("held_out", held_out)
    blocks = scratch.keep(docs.mapInArrow(_read_blocks, BLOCK_ROWS), "blocks", TEXT_ROWS)
    # A word has one row in each block at most, so no partition of this window is as large as a word is frequent.
    same = Window.partitionBy("word")
    words = blocks.filter("word IS NOT NULL").select("word", "block", "local", "ends", F.sum("n").over(same).alias("total"), (F.row_number().over(same.orderBy("block")) == 1).alias("speaks"))
    words = scratch.keep(words, "words")
    scratch.sweep()
    counts = words.filter("speaks")
    facts = counts.agg(F.sum("total").alias("n"), F.count_if(F.col("total") > 0).alias("v")).first()
    size, _, classes = sizes(int(facts["v"] or 0))
    head = counts.filter("total > 0").orderBy(F.desc("total"), "word").limit(size).collect()
    # The head grows with the square root of the vocabulary, so this side stays small.
    names = F.broadcast(spark.createDataFrame([(r["word"], i) for i, r in enumerate(head)], "word string, place int"))
    tail = np.zeros(classes)
    known = words.join(names, "word", "left")
    for r in known.filter("speaks AND place IS NULL AND total > 0").groupBy("ends").agg(F.sum(F.col("total") + F.lit(SMOOTH)).alias("mass")).collect():
        tail[tail_class(r["ends"], classes)] += r["mass"]
    v = Vocabulary([(r["word"], r["total"]) for r in head], tail, int(facts["n"] or 0), int(facts["v"] or 0))

    low, high = F.col("ends").bitwiseAND(255), F.shiftright("ends", 8)
    # Each block's words with the corpus counts: its dictionary.
    dictionary = known.select(F.col("block").alias("of"), "local", "total", F.coalesce("place", F.lit(v.head) + (low + 31 * high) % classes).alias("symbol"))
    coded = blocks.filter("ids IS NOT NULL").select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(dictionary.groupBy("of")).applyInArrow(_code_block(v), CODED)
    coded = scratch.keep(coded, "coded")
    scratch.forget("blocks", "words")
    scratch.sweep()
    params = train(training_rounds(coded), v)
    scratch.sweep()
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.mapInArrow(_score(v, params), shape)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), split_by("doc_id", 10, 0))
