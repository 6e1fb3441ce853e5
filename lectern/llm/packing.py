"""Bounded-space online packing of tokenised documents into fixed windows.

Every task keeps at most `open_windows` unfinished windows. A document's tokens
first fill whole windows of their own; what remains goes to the open window that
it fits best. Where none fits, a new window is opened while the bound allows it;
else the fullest window is topped up with the front of the remainder and emitted.
The windows left over at the end of the tasks are merged in groups of MERGE_TASKS
tasks, so no step gathers more than MERGE_TASKS * open_windows windows. The last
window of a group is cut into windows whose lengths are powers of two, which need
no padding.

Edge cases: null and empty texts consist of the end id alone; texts of any length
are cut freely and each id lies in exactly one piece; repeated rows are packed one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm._spark import Scratch, table, texts

WINDOW = 4096
OPEN_WINDOWS = 8
MERGE_TASKS = 32
END_ID = 2
#: Bytes that a task's caches of words and pieces take together, about.
CACHE_BYTES = 256 << 20
#: Of one entry besides its contents: two objects and a place in a table.
ENTRY_BYTES = 180
VOCABULARY = "word_bpe_49k.json"
_BELOW_MARKS = bytes(range(0xCA))
# Fixed value: the vocabulary's own pattern, used on words of code points below U+0280.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts from caches of white-space-free words and of their pieces.

    The vocabulary drops white space and its pattern never spans any, so a text's
    ids are those of its words one after the other, and a word's are those of the
    pattern's matches in it. Unknown pieces are encoded many at a time; the id that
    ends a match tells where each one ends.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit integers."""
        data = text.encode()
        # Without combining marks (none below U+0300) lower-casing may come first.
        words = (data if data.translate(None, _BELOW_MARKS) else data.lower()).split()
        new = {w for w in words if w not in self.known}
        if new:
            if self.held > CACHE_BYTES:
                self.forget()
                new = set(words)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def forget(self) -> None:
        """Empty the caches."""
        self.known.clear()
        self.pieces.clear()
        self.held = 0

    def _learn(self, words: set[bytes]) -> None:
        cut, whole = {}, []
        for w in words:
            if w.isalpha():  # ASCII letters only: one match
                cut[w] = (w.decode().lower(),)
            elif w.translate(None, _BELOW_MARKS) or b"<|" in w:
                whole.append(w)
            else:
                cut[w] = _PIECE(w.decode().lower())
        for w, found in zip(whole, self.tokenizer.encode_batch([w.decode() for w in whole], add_special_tokens=False), strict=True):
            self.known[w] = _packed(found.ids)
        new = list({p for found in cut.values() for p in found if p not in self.pieces})
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part):
                raw, begin = ids.tobytes(), 0
                for piece, end in zip(part, (4 * stop).tolist(), strict=True):
                    self.pieces[piece], begin = raw[begin:end], end
            else:
                for piece in part:
                    self.pieces[piece] = _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        for w, found in cut.items():
            self.known[w] = b"".join(map(self.pieces.__getitem__, found))
        self.held += sum(len(w) + len(self.known[w]) + ENTRY_BYTES for w in words) + sum(len(p) + len(self.pieces[p]) + ENTRY_BYTES for p in new)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


class Window:
    def __init__(self):
        self.used, self.pieces = 0, []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total, self.used))
        self.used += len(ids) // 4


class Packer:
    """Best-fit placement with at most `bound` open windows; finished ones go to `emit`."""

    def __init__(self, emit: Callable[[Window], None], size: int, bound: int):
        self.emit, self.size, self.bound, self.open = emit, size, bound, []

    def place(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            whole = Window()
            whole.add(doc, at, ids[4 * at : 4 * (at + self.size)], total)
            self.emit(whole)
            at += self.size
        while at < total:
            rest = total - at
            fits = [w for w in self.open if self.size - w.used >= rest]
            if fits:
                target = max(fits, key=lambda w: w.used)
            elif len(self.open) < self.bound:
                self.open.append(target := Window())
            else:
                target = max(self.open, key=lambda w: w.used)
            take = min(rest, self.size - target.used)
            target.add(doc, at, ids[4 * at : 4 * (at + take)], total)
            at += take
            if target.used == self.size:
                self.open.remove(target)
                self.emit(target)


def _rows(window: Window, sequence: int) -> list[tuple]:
    return [(doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids) for doc, start, ids, total, offset in window.pieces]


def _batch(rows: list[tuple], keep_ids: bool, group: int | None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    ids = columns[7] if keep_ids else [None] * len(rows)
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(ids, pa.binary()), pa.array([group] * len(rows), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "merge_group"])


def _merge_windows(size: int, keep_ids: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["sequence_id", "offset"])
        left = int(found["length"].sum())
        lengths = [size] * (left // size) + [1 << i for i in reversed(range(size.bit_length())) if (left % size) >> i & 1]
        rows: list[tuple] = []
        window, made = Window(), 0
        for doc, start, ids, total in zip(found["doc_id"], found["start"], found["ids"], found["doc_tokens"], strict=True):
            while ids:
                take = min(len(ids) // 4, lengths[made] - window.used)
                window.add(doc, start, ids[: 4 * take], total)
                ids, start = ids[4 * take :], start + take
                if window.used == lengths[made]:
                    rows += _rows(window, (1 << 62) + (int(key[0]) << 32) + made)
                    window, made = Window(), made + 1
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        return out if keep_ids else out.assign(ids=None)

    return merge


def pack(docs: DataFrame, path: str, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents and where each lies; with `keep_ids` also their ids (4 bytes each)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = load(path), TaskContext.get().partitionId()
        done: list[Window] = []
        packer, made = Packer(done.append, size, open_windows), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.place(doc, words.encode(text or "") + end)
                rows = [r for i, w in enumerate(done) for r in _rows(w, (task << 32) + made + i)]
                made += len(done)
                done.clear()
                yield _batch(rows, keep_ids, None)
        words.forget()  # the worker process outlives its task
        yield _batch([r for i, w in enumerate(packer.open) for r in _rows(w, (task << 32) + made + i)], True, task // MERGE_TASKS)

    full = f"{PIECES}, ids binary"
    placed = Scratch(docs.sparkSession).keep(texts(docs).mapInArrow(run, f"{full}, merge_group long"), "placed")
    merged = placed.filter("merge_group IS NOT NULL").groupBy("merge_group").applyInPandas(_merge_windows(size, keep_ids), full)
    out = placed.filter("merge_group IS NULL").drop("merge_group").unionByName(merged)
    return out if keep_ids else out.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids (binary, 4 bytes each) from pieces that were packed with `keep_ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return pieces.groupBy("sequence_id").agg(whole.alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
