"""Importance resampling, fingerprints and ranked retrieval on odd rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions.order import numbered
from lectern.llm import fingerprints, ranked_retrieval, resampling
from lectern.llm._spark import Scratch
from tests.llm.data import SHAPE, documents, sentence, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score int"


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, extra=True).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# Importance resampling


def brute_resampling(rows, target):
    def grams(text):
        w = WORD.findall(low(text))
        return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))]], len(w)

    own = [(d, *grams(t)) for d, t in rows]
    s = Counter(b for _, g, _ in own for b in g)
    t = Counter(b for x in target for b in grams(x)[0])
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10000)) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for d, g, n in own:
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(g), weight, score, n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0], x[1]))
    rank = {x[:4]: [] for x in able}
    for i, x in enumerate(able[: 25 * len(able) // 100]):
        rank[x[:4]].append(i + 1)
    return Counter((*x[:4], rank[x[:4]].pop(0) if x[4] >= 20 and rank[x[:4]] else None) for x in out)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_resampling(spark, docs, block):
    target = [sentence(2), None, "", "One two three", sentence(5)]
    items = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(target)], ITEMS)
    many = docs.unionByName(documents(spark, [(100 + i, sentence(200 + i, 15 + i)) for i in range(90)], extra=True))
    got = Counter(map(tuple, resampling.resample(many, items, block=block).collect()))
    assert got == brute_resampling(rows_of(many), target)


def test_resampling_without_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, sentence(2), "x", 0)], ITEMS)
    assert resampling.resample(empty, items).count() == 0
    assert resampling.resample(docs, items.limit(0)).count() == docs.count()
    nobody = spark.createDataFrame([(None, sentence(3, 60)), (1, sentence(4, 60))], "doc_id long, text string")
    assert {(r.doc_id, r.score is None, r["rank"]) for r in resampling.resample(nobody, items, percent=100).collect()} == {(None, True, None), (1, False, 1)}


def test_drawn_documents_keep_their_columns(docs):
    got = resampling.drawn_documents(docs, docs.select("text"), percent=50)
    assert got.columns == docs.columns
    assert 0 < got.count() < docs.count()


@pytest.mark.parametrize("place", [1, 2, 500, 1999, 2000])
def test_cutoff_of_ties(spark, place):
    r = random.Random(3)
    rows = [(r.randint(0, 3), r.randint(0, 5), 0, i) for i in range(2000)]
    keys = spark.createDataFrame(rows, "down long, doc_id long, n_features long, row long").repartition(5)
    scratch = Scratch(spark)
    assert resampling.cutoff(scratch.keep(keys, "keys"), place, scratch, block=40) == sorted(rows)[place - 1]


def test_crc_of_long_words():
    words = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(97, 123)) * 40]
    cut = np.cumsum([0, *map(len, words)])
    state = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    got = ~resampling.crc_extended(state, np.frombuffer(b"".join(words), dtype=np.uint8), cut[:-1], cut[1:])
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_numbered(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [(r.x, r.number) for r in numbered(df, [F.desc("x")]).collect()]
    assert sorted(got, reverse=True) == [(x, i + 1) for i, (x, _) in enumerate(sorted(got, reverse=True))]


# Fingerprints


def jaccard(a, b):
    def weigh(t):
        w = WORD.findall(low(t))
        return {x: n * len(x.encode()) ** 2 for x, n in Counter(w).items()} if w else {low(t): max(1, len((t or "").encode())) ** 2}

    a, b = weigh(a), weigh(b)
    every = set(a) | set(b)
    return sum(min(a.get(x, 0), b.get(x, 0)) for x in every) / sum(max(a.get(x, 0), b.get(x, 0)) for x in every)


def test_fingerprints(spark, docs, empty):
    rows = sorted({(d, t or "") for d, t in rows_of(docs)}, reverse=True)
    got = {r.doc_id: r for r in fingerprints.against_next(docs.dropDuplicates(["doc_id"]).repartition(5)).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(t, edited)) < 0.2
        assert abs(r.near_next - jaccard(t, n)) < 0.2
    assert got[16].fingerprint == got[17].fingerprint
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint
    assert got[1].fingerprint == got[4].fingerprint != got[3].fingerprint
    assert fingerprints.against_next(empty).count() == 0


def test_fingerprints_in_parts(spark, docs, monkeypatch):
    whole = fingerprints.against_next(docs)
    expected = sorted(map(str, whole.collect()))
    one = spark.createDataFrame([(7, "a single row", None)], "doc_id long, text string, edge int")
    assert [(r.near_next, r.n_chars) for r in fingerprints.against_next(one).collect()] == [(1.0, 12)]
    assert sorted(map(str, fingerprints.against_next(docs.repartition(1)).collect())) == expected
    assert whole.filter("doc_id = 1").count() == 2
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in whole.collect()}
    same = whole.select("near_edited", fingerprints.likeness("fingerprint", "edited_fingerprint").alias("again")).collect()
    assert all(r.near_edited == r.again for r in same)


def test_share_of_equal_samples_is_the_similarity():
    r, errors = random.Random(5), []
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(60)]
    for _ in range(150):
        one = [r.choice(words) for _ in range(r.randint(1, 120))]
        two = one[: r.randint(0, len(one))] + [r.choice(words) for _ in range(r.randint(0, 60))]
        a, b = " ".join(one), " ".join(two) or "x"
        s = fingerprints.sketches(pa.array([a, b], pa.large_string()))
        errors.append((s[0] == s[1]).mean() - jaccard(a, b))
    # The mean of 150 estimates of 128 samples each lies within four deviations.
    assert abs(np.mean(errors)) < 4 * 0.5 / math.sqrt(128 * 150)
    assert np.std(errors) < 0.06


# Ranked retrieval


def brute_ranked(items, rows, k=10):
    own = [(d, Counter(w), len(w)) for d, t in rows if (w := WORD.findall(low(t)))]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(WORD.findall(low(t)))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, n in own:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((score, d))
        best = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, p + 1, d, s) for p, (s, d) in enumerate(best)]
    return Counter(out)


QUESTIONS = [(1, sentence(2, 30)), (2, None), (3, ""), (4, "one three ONE"), (5, sentence(1, 8) + " é漢字"), (6, "nowhere-found zzzz"), (7, "x y"), (1, "two"), (None, "This passage of more")]


@pytest.mark.parametrize(("shard", "at_once"), [(1, 20), (4, 1000), (8192, 200_000)])
def test_ranked(spark, docs, shard, at_once):
    many = docs.unionByName(documents(spark, [(300 + i // 2, " ".join(random.Random(i).choices(sentence(2, 40).split() + ["one", "two", "the"], k=25))) for i in range(120)], extra=True))
    nobody = spark.createDataFrame([(None, sentence(2, 30))], "doc_id long, text string")
    many = many.unionByName(nobody, allowMissingColumns=True) if shard == 4 else many
    items = spark.createDataFrame([(i, t, "x", 0) for i, t in QUESTIONS], ITEMS)
    got = Counter(map(tuple, ranked_retrieval.ranked(items, many, shard=shard, item_terms_at_once=at_once).collect()))
    assert got == brute_ranked(QUESTIONS, rows_of(many))


def test_ranked_without_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "one", "x", 0)], ITEMS)
    assert ranked_retrieval.ranked(items, empty).count() == 0
    assert ranked_retrieval.ranked(items.limit(0), docs).count() == 0


def test_no_accumulator_beyond_the_bound():
    """A rare term decides; the many documents with the common term alone get no accumulator."""
    n = 1000
    row = np.append(np.arange(20), np.arange(n))
    term = np.append(np.zeros(20, dtype=np.int64), np.ones(n, dtype=np.int64))
    part = ranked_retrieval.Shard(np.arange(n), np.zeros(n, dtype=bool), row, term, np.append(np.full(20, 900), np.full(n, 100)), 2)
    best = ranked_retrieval.Best(10)
    assert part.answer(np.array([0, 1]), best) == 20
    assert best.doc.tolist() == list(range(10))
    assert best.score.tolist() == [1000] * 10
