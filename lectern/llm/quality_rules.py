"""Line-first cleaning: rules judge lines, then documents that lose too much go.

Lines are the \\n-separated parts of a text that hold a word. A line fails

* the punctuation rule, if symbols of `#*$%&|<>{}~^=_` and backslash make up more than
  SYMBOL_PERCENT of its word characters, or words that end in `!!` are at least
  three and at least half of its words;
* the navigation rule, if at least three of its words are the separators `|` or `>`
  and at most three other words stand between two of them on average;
* the boilerplate rule, if it has at most BOILERPLATE_WORDS words and one of the
  fixed phrases.

A document is kept if the failed lines hold at most LOSS_PERCENT of its word
characters and it passes the base rules (50 words; at most half of the words in
repeated three-word windows).

Edge cases: null and empty texts, and texts of white space, have no words and fail
the base rules; texts of any length are read whole; repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm._spark import table, texts
from lectern.llm._text import U, Slice, grams, mix, slices

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
LOSS_PERCENT = 50
BOILERPLATE_WORDS = 20
# Phrases of boilerplate lines, compared after lower-casing A-Z.
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "enable javascript", "javascript is disabled", "sign up for our newsletter", "skip to content", "click here", "lorem ipsum",
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAVY = _SYMBOL.copy()
_HEAVY[list(b"{}~^=_\\")] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", lost_chars long, base_failed boolean, kept boolean"


def _runs(key: np.ndarray) -> np.ndarray:
    """For each key, how many keys are equal to it."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[back]


class Lines:
    """The lines of a slice: starts, ends, rows, word counts and failed rules."""

    def __init__(self, s: Slice, starts: np.ndarray, ends: np.ndarray):
        breaks = np.flatnonzero(s.data == 10)
        self.starts = np.union1d(s.offs[:-1], breaks + 1)
        self.starts = self.starts[self.starts < len(s.data)]
        self.ends = np.append(self.starts[1:], len(s.data)) if len(self.starts) else self.starts
        self.row = np.searchsorted(s.offs, self.starts, side="right") - 1
        edges = np.append(self.starts, len(s.data))
        self.words = np.diff(np.searchsorted(starts, edges))
        lead = np.cumsum(np.append(0, _SOLID[s.data] & ((s.data & 0xC0) != 0x80)))
        heavy = np.cumsum(np.append(0, _HEAVY[s.data]))
        self.chars, symbols = np.diff(lead[edges]), np.diff(heavy[edges])
        last, before = s.data[ends - 1], s.data[np.maximum(ends - 2, 0)]
        bang = starts[(last == 33) & (before == 33) & (ends - starts >= 2)]
        bar = starts[(ends - starts == 1) & ((last == 124) | (last == 62))]
        bangs, bars = np.diff(np.searchsorted(bang, edges)), np.diff(np.searchsorted(bar, edges))
        boiler = np.zeros(len(self.starts), dtype=bool)
        if len(self.starts):
            low = s.lowered().tobytes()
            for phrase in PHRASES:
                for m in re.finditer(re.escape(phrase.encode()), low):
                    i = np.searchsorted(self.starts, m.start(), side="right") - 1
                    boiler[i] |= m.end() <= self.ends[i]
        self.punctuation = (100 * symbols > SYMBOL_PERCENT * self.chars) | ((bangs >= 3) & (2 * bangs >= self.words))
        self.navigation = (bars >= 3) & (self.words - bars <= 3 * (bars + 1))
        self.boilerplate = boiler & (self.words <= BOILERPLATE_WORDS)
        self.failed = (self.words > 0) & (self.punctuation | self.navigation | self.boilerplate)


def _stats(s: Slice) -> dict[str, np.ndarray]:
    starts, ends, row = s.words()
    lines = Lines(s, starts, ends)
    count = lambda rows, w=None: np.bincount(rows, weights=w, minlength=s.rows).astype(np.int64)
    out = {"n_words": count(row), "word_chars": s.per_row(_SOLID[s.data] & ((s.data & 0xC0) != 0x80)), "n_symbols": s.per_row(_SYMBOL[s.data])}
    full = np.flatnonzero(lines.words > 0)
    stop = lines.ends[full] - (s.data[lines.ends[full] - 1] == 10)
    raw, seen, again = s.data.tobytes(), set(), []
    for r, a, e in zip(lines.row[full].tolist(), lines.starts[full].tolist(), stop.tolist(), strict=True):
        line = (r, raw[a:e])
        if line in seen:
            again.append(r)
        seen.add(line)
    out["n_dup_lines"] = count(np.array(again, dtype=np.int64))
    at, tri = grams(s.hashes(starts, ends, lower=False), row, 3)
    twice = at[_runs(mix(tri + row[at].astype(U))) > 1] if len(at) else at
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = count(row[np.flatnonzero(covered[: len(starts)])])
    out["lost_chars"] = count(lines.row[lines.failed], lines.chars[lines.failed])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["lost_chars"] <= LOSS_PERCENT * out["word_chars"])
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            out = _stats(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), *map(pa.array, out.values())], ["doc_id", *out])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column("text")):
            starts, ends, _ = s.words()
            lines, kept = Lines(s, starts, ends), [[] for _ in range(s.rows)]
            for a, e, r, bad in zip(lines.starts, lines.ends, lines.row, lines.failed, strict=True):
                if not bad:
                    kept[r].append(s.data[a:e].tobytes())
            out = [b"".join(x).decode() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.rows), pa.array(out, pa.string())], ["doc_id", "clean_text"])


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row of statistics and verdicts for each row of `docs`."""
    return texts(docs).mapInArrow(_judge, SHAPE)


def clean_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its failed lines."""
    return texts(docs).mapInArrow(_clean, "doc_id long, clean_text string")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, line, regexp_extract_all(line, '{_W}') AS w FROM l0),
f AS (
  SELECT doc_id, line, len(w) AS n, length(list_aggregate(w, 'string_agg', '')) AS chars,
         len(regexp_extract_all(line, '[#*$%&|<>{{}}~^=_\\]')) AS symbols,
         len(list_filter(w, lambda x: ends_with(x, '!!'))) AS bangs, len(list_filter(w, lambda x: x = '|' OR x = '>')) AS bars,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM l WHERE len(w) > 0),
g AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN 100 * symbols > {SYMBOL_PERCENT} * chars OR (bangs >= 3 AND 2 * bangs >= n) OR (bars >= 3 AND n - bars <= 3 * (bars + 1))
                    OR (n <= {BOILERPLATE_WORDS} AND ({" OR ".join(f"contains(low, '{p}')" for p in PHRASES)})) THEN chars ELSE 0 END) AS lost
  FROM f GROUP BY doc_id),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
k AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k) GROUP BY doc_id),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {LOSS_PERCENT} * word_chars AS kept
FROM b
"""
