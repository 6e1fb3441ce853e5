"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encodings of byte strings form a monoid under `join`: the encoding of a piece is
the join of the encodings of its halves, down to single bytes. A join re-encodes a
window around the seam and widens it until both of its outer borders
are stable. Two adjacent tokens are stable if their bytes together encode to just
these two tokens; merges take the lowest rank first, so a sequence whose adjacent
pairs are all stable is the encoding of its bytes (the first merge across any
border would also happen with only the two neighbours present). Decoding
concatenates neighbours level by level up the same kind of tree.

Text is first cut by the pattern of the vocabulary, every match on its own. A match
that is a token of the vocabulary is that token; all others go through the tree,
unless the task has met them before.

Edge cases: null and empty texts have no tokens; texts and matches of any length
are encoded whole; bytes that are no token of their own cannot occur in the given
vocabularies; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm._spark import table, texts

#: Windows of more bytes are merged with a heap.
SHORT = 48
#: Entries of each cache of a task, and of the one of whole matches; longer matches are not kept.
CACHE = 300_000
PIECES = 600_000
LONGEST = 64
#: Bytes of the halves whose encodings a task keeps.
KEPT = 6
#: Bytes of the windows whose merges a task keeps.
KEPT_WINDOW = 10
#: The rank of two neighbours that form no token.
NONE = 1 << 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Unicode white space only: some engines also take U+001C..U+001F for \s.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}
        self.names = [str(i) for i in range(len(self.bytes_of))]

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a byte string by its definition: the neighbours of lowest rank, the first ones of equals, become one token."""
        if len(data) > SHORT:
            return self._merge_long(data)
        known = self.windows.get(data)
        if known is not None:
            return known
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            at = pairs.index(least)
            del pairs[at], cuts[at + 1]
            if at:
                pairs[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], NONE)
            if at < len(pairs):
                pairs[at] = rank(data[cuts[at] : cuts[at + 2]], NONE)
        known = [self.ranks[data[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]
        if len(data) <= KEPT_WINDOW:
            if len(self.windows) > CACHE:
                self.windows.clear()
            self.windows[data] = known
        return known

    def _merge_long(self, data: bytes) -> list[int]:
        """As `merge`, with candidates in a heap: n log n steps."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:  # one of the two has been merged meanwhile
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def is_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > CACHE:
                self.stable.clear()
            known = self.stable[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two byte strings put together."""
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(self.decode(left[len(left) - i :]) + self.decode(right[:j]))
            left_ok = i == len(left) or self.is_stable(left[-i - 1], window[0])
            right_ok = j == len(right) or self.is_stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def tree(self, data: bytes) -> list[int]:
        """The encoding of a byte string from those of its halves."""
        if len(data) == 1:
            return [self.byte[data[0]]]
        known = self.halves.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= KEPT:
                if len(self.halves) > CACHE:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def piece(self, match: str) -> tuple[int, ...]:
        """A match of the pattern: one token if it is in the vocabulary, else its tree."""
        data = match.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.tree(data))

    def encode(self, text: str) -> list[int]:
        pieces, out = self.pieces, []
        if len(pieces) > PIECES:
            pieces.clear()
        for match in self.split(text):
            ids = pieces.get(match)
            if ids is None:
                ids = self.piece(match)
                if len(match) <= LONGEST:
                    pieces[match] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        """Neighbours are concatenated level by level."""
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            rest = parts[-1:] if len(parts) % 2 else []
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + rest
        return parts[0] if parts else b""

    def forget(self) -> None:
        """Empty the caches: a worker process outlives its task."""
        self.pieces.clear()
        self.stable.clear()
        self.halves.clear()
        self.windows.clear()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.array(bpe.encode(t or ""), dtype=np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of `encoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            out = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and of the bytes decoded from them, with nothing but digests leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = bpe.encode(text or "")
                listed = ",".join([bpe.names[i] for i in ids]).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )
        bpe.forget()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
