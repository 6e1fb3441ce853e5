"""Exact deduplication with a cuckoo-filter index over live digests.

Texts are equal when they are identical after lower-casing A-Z. Each task of the
first pass keeps a cuckoo index of the digests that it has seen, so a group of
copies leaves a task as one row however large it is; the rows then meet by digest
in a second index of the same kind. A hit of the short fingerprint is verified
against the whole SHA-256 digest kept in the bucket. When a copy with a larger id
appears, the live entry is deleted and the new one inserted.

Edge cases: null text counts as the empty text (all of these form one group);
rows that repeat a doc_id are members of the group in their own right, and of equal
ones all are kept or all dropped; an empty table gives an empty result; further columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._spark import Scratch, fresh, table, texts

SLOTS = 4
MAX_KICKS = 400
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints whose slots point to whole digests.

    `insert` adds an absent digest, `find` verifies a fingerprint hit against the
    stored digest, `delete` removes a live one. A chain of more than MAX_KICKS
    displacements doubles the table and refills it from the stored digests.
    """

    def __init__(self, buckets: int = 1024):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.unused: list[int] = []
        self.live = 0
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * buckets * SLOTS))
        self.slots = array("q", bytes(8 * buckets * SLOTS))

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        word = int.from_bytes(digest[:10], "little")
        mark = (word & 0xFFFF) or 1
        one = (word >> 16) & self.mask
        return mark, one, one ^ ((mark * 0x5BD1E995) & self.mask)

    def _where(self, digest: bytes) -> int:
        mark, one, two = self._place(digest)
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.keys[self.slots[at]] == digest:
                    return at
        return -1

    def find(self, digest: bytes):
        """The value of a live digest, or None."""
        at = self._where(digest)
        return None if at < 0 else self.values[self.slots[at]]

    def insert(self, digest: bytes, value) -> None:
        if self.unused:
            slot = self.unused.pop()
            self.keys[slot], self.values[slot] = digest, value
        else:
            slot = len(self.keys)
            self.keys.append(digest)
            self.values.append(value)
        self.live += 1
        if not self._put(digest, slot):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        at = self._where(digest)
        if at < 0:
            return False
        slot = self.slots[at]
        self.prints[at] = 0
        self.keys[slot] = self.values[slot] = None
        self.unused.append(slot)
        self.live -= 1
        return True

    def _put(self, digest: bytes, slot: int) -> bool:
        mark, bucket, other = self._place(digest)
        for turn in range(MAX_KICKS):
            for b in (bucket, other):
                for at in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[at]:
                        self.prints[at], self.slots[at] = mark, slot
                        return True
            at = other * SLOTS + (turn * 7 + mark) % SLOTS
            mark, self.prints[at] = self.prints[at], mark
            slot, self.slots[at] = self.slots[at], slot
            bucket = other
            other ^= (mark * 0x5BD1E995) & self.mask
        return False

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._allocate(buckets)
            if all(self._put(k, i) for i, k in enumerate(self.keys) if k is not None):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [hashlib.sha256((t or "").encode().lower()).digest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "digest"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (digest, largest id, size) to one row per digest of this partition."""
    index = CuckooIndex()
    for b in batches:
        for digest, doc, size in zip(*(b.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")), strict=True):
            seen = index.find(digest)
            if seen is None:
                index.insert(digest, (doc, size))
            elif doc is not None and (seen[0] is None or doc > seen[0]):
                index.delete(digest)
                index.insert(digest, (doc, seen[1] + size))
            else:
                index.delete(digest)
                index.insert(digest, (seen[0], seen[1] + size))
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
            ["digest", "keep_id", "group_size"],
        )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs`."""
    spark = docs.sparkSession
    digests = Scratch(spark).keep(texts(docs).mapInArrow(_digests, "doc_id long, digest binary"), "digests")
    shape = "digest binary, keep_id long, group_size long"
    rows = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    groups = rows.mapInArrow(_merge, shape).repartition("digest").mapInArrow(_merge, shape)
    return digests.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_latest(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of equal texts, the one with the largest doc_id."""
    gone = exact_groups(docs).filter("NOT kept").select(F.col("doc_id").alias(one := fresh(docs, "gone_id")), F.col("text_sha256").alias(two := fresh(docs, "gone_digest"))).distinct()
    digest = F.sha2(F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), UPPER, UPPER.lower()).cast("binary"), 256)
    return docs.join(gone, (docs["doc_id"] == gone[one]) & (digest == gone[two]), "left_anti")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
