"""Each numbered operator on odd rows, against brute force or a defined result."""

import hashlib
import tempfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import byte_bpe, exact_dedup, language_id, lm_scoring, ngram_join, packing, quality_rules, suffix_dedup, toxicity, url_filters
from lectern.llm._spark import Scratch
from lectern.llm._text import slices
from lectern.llm.queries import ORACLES, QUERIES
from tests.compare import connection, same
from tests.conftest import SF
from tests.llm.data import SHAPE, documents, sentence, texts

TEXTS = dict(texts())


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, extra=True).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), connection(SF), ORACLES[name])


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_ngram_join(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(TEXTS.items())
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = list(base) if i < 45 else [f"v{i % 3}x{j}" for j in range(rng.integers(1, 24))]
        for _ in range(rng.integers(0, 6)):
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_variants_around_the_threshold(spark):
    r = np.random.default_rng(21)
    words, passage, rows = sentence(62, 120).split(), sentence(63, 40), []
    for i in range(160):
        own = list(words)
        for at in r.choice(120, r.integers(0, 8), replace=False):
            own[at] = f"edit{r.integers(0, 400)}"
        rows.append((i, " ".join(own) if i % 4 else f"{passage} {sentence(1000 + i, 60)}"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 20


def test_exact_dedup(docs, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(1, 4, 4, False), (2, 4, 4, False), (4, 4, 4, True), (5, 6, 2, False), (6, 6, 2, True), (8, 9, 2, False), (17, 17, 2, True)} <= got
    assert exact_dedup.exact_groups(empty).count() == 0


def test_cuckoo_index():
    index, keys = exact_dedup.CuckooIndex(buckets=4), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.insert(k, i)
    assert all(index.find(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2])
    assert not index.delete(keys[0])
    assert [index.find(k) for k in keys[:4]] == [None, 1, None, 3]
    index.insert(keys[0], 7)
    assert index.find(keys[0]) == 7
    assert index.live == 1501


def test_packing(docs, empty):
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, rows = Tokenizer.from_file(path), packing.pack(docs.dropDuplicates(["doc_id"]), path, size=256, open_windows=2, keep_ids=True).toPandas()
    for doc, g in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(TEXTS[doc] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert b"".join(g["ids"]) == ids
        assert list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]]
        assert set(g["doc_tokens"]) == {len(ids) // 4}
        assert all(zlib.crc32(i) == c for i, c in zip(g["ids"], g["ids_crc32"], strict=True))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        total = g["length"].sum()
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
        assert total == 256 or total & (total - 1) == 0
    assert packing.pack(empty, path).count() == 0


def brute_cut(rows):
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests_of_kept(docs).collect()}
    assert got == brute_cut(TEXTS.items())
    assert suffix_dedup.digests_of_kept(empty).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.filter("doc_id = 2").first().text == ""


def test_suffix_dedup_of_overlapping_repeats(spark):
    rng = np.random.default_rng(9)
    parts = ["".join(rng.choice(list("abc "), 70)) for _ in range(6)]
    rows = [(i, "".join(parts[j][rng.integers(0, 15) :] for j in rng.integers(0, 6, 4))) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests_of_kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_cut(rows)


def test_multikey_quicksort(monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(suffix_dedup, "SMALL", 40)
    for letters, n in (("ab", 3000), ("a", 500), ("abcdefgh é", 4000), ("ab", 50)):
        data = "".join(r.choice(list(letters), n)).encode()
        data += data[: n // 3]
        s = next(slices(pa.array([data], pa.binary()), 1 << 20))
        at = r.permutation(len(data) - 49)
        order, new = suffix_dedup.multikey_quicksort(s.chunks(False), at)
        found = [data[i : i + 50] for i in at[order]]
        assert found == sorted(found)
        assert new.tolist() == [True] + [x != y for x, y in zip(found[1:], found[:-1], strict=True)]


def test_suffix_dedup_of_a_hot_token(spark):
    rng = np.random.default_rng(12)
    line = "a line of some sixty bytes that many of these documents have, always"
    letters = list("abcdefg ")
    rows = [(i, "".join(rng.choice(letters, 60)) + line + "".join(rng.choice(letters, 60)) + ("aaaaaaaaab" * 9 if i % 3 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests_of_kept(docs).collect()}
    assert got == brute_cut(rows)
    made = [(bytes([i]) * 16, i, 40, line[:24].encode(), f"{i % 4}{line}"[:75].encode()) for i in range(40)]
    contexts = spark.createDataFrame(made, "context binary, least long, k long, lead binary, data binary")
    one, two = ({(bytes(r.context), *sorted(r.lost)) for r in suffix_dedup.lost_strings(contexts, hot).collect()} for hot in (5, 500))
    assert one == two and len(one) == 39


def test_byte_bpe(docs, empty):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    bpe = byte_bpe.load(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for r in byte_bpe.round_trips(docs, path).collect():
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    decoded = {r.doc_id: bytes(r.data) for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path), path).collect()}
    assert decoded == {d: (t or "").encode() for d, t in TEXTS.items()}
    assert byte_bpe.round_trips(empty, path).count() == 0


def test_byte_bpe_joins_up_the_tree(docs):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    bpe, seams = byte_bpe.Bpe(path), Counter()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    join = bpe.join
    bpe.join = lambda a, b: (seams.update([bpe.is_stable(a[-1], b[0])]), join(a, b))[1]
    r = np.random.default_rng(8)
    for text in [sentence(31, 2000), "a" * 3000, "ab" * 777, *("".join(r.choice(list(letters), n)) for letters in ("abe", "xthe é", "0\u4e00\U0001f642\n ") for n in (5, 60, 300))]:
        assert bpe.encode(text) == library.encode_ordinary(text)
        assert bpe.tree(text.encode()) == bpe._merge_long(text.encode())
        assert bpe.decode(bpe.encode(text)) == text.encode()
    # The words of the fixture are not tokens: most of them are joined from their halves.
    assert seams[True] > 2000 and seams[False] > 2000


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    assert (got[5].n_words, got[5].kept, got[7].n_words, got[10].word_chars) == (0, False, 0, 11)
    assert got[1].kept and got[19].kept and not got[18].kept
    assert got[18].n_dup_lines == 29
    assert quality_rules.judge_quality(empty).count() == 0
    assert quality_rules.clean_lines(docs).filter("doc_id = 18").first().clean_text.strip() == ""


def test_url_filters(spark):
    urls = ["http://example.org", "http://Example.org/en/1x", "https://a.example.org/en/2?q", "x://org/", "http://b.com/de/#f", "http://b.com/fr", "no scheme", None, "http://ads.site.net/x", "http://a.net/login", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages).collect()}
    expected = [(None, "allow"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow")]
    assert got == dict(enumerate(expected))
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_url_filters_of_every_alternative(spark):
    urls = ["http://ads.site.net/x", "https://doubleclick.net/x", "http://tracking.site.net/y", "http://adserver.a.net/", "http://a.tracking.b/ads", "http://nodoubleclick.net/x", "http://a.net/tracking"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages).collect()}
    assert got == dict(enumerate([(None, "block")] * 5 + [(None, "allow")] * 2))
    pages.toPandas().to_parquet(folder := f"{tempfile.mkdtemp()}/pages.parquet")
    same(url_filters.judge_urls(pages), connection(Path(folder).parent), url_filters.OP9_SQL)


def test_language_id(spark, docs, empty):
    larger = SF.replace("0.001", "0.01")
    table = spark.read.parquet(f"{larger}/documents.parquet")
    got = language_id.op6_language_id(spark, larger).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    model = language_id.train(language_id.training_rows(docs))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert {d for d, (p, _) in found.items() if p == "und"} == {5, 6, 7, 21}
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, f"{('you awful grob person ' if i % 4 == 0 else '')}calm words number {i} here and there {i * 7}") for i in range(400)]
    made = documents(spark, rows)
    labels = made.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic")).distinct()
    held = (F.col("doc_id") % 5) == 0
    got = {r.doc_id: r.score for r in toxicity.score(made, toxicity.train(made, labels.filter(~held))).collect()}
    assert all((s >= toxicity.THRESHOLD) == (d % 4 == 0) for d, s in got.items() if d % 5 == 0)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, none).count() == 0


def plain_ftrl(rows, order):
    """Weights by the published update, one coordinate at a time; coordinate -1 is the bias, which L1 leaves alone."""
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0 if i == -1 else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 and i != -1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for k in order:
        found, label = rows[k]
        w = {i: weight(i) for i in [*found, -1]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i, v in w.items():
            rate = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - rate * v
            n[i] += g * g
    return {i: weight(i) for i in z}


def plain_features(text):
    return set(toxicity.features(next(slices(pa.array([text or ""]))))[1].tolist())


def test_toxicity_equals_a_plain_learner(spark):
    rows = [(i, f"{'you awful person ' if i % 3 == 0 else 'kind words '}number {i % 7} here {'and there ' * (i % 5)}") for i in range(120)]
    made = documents(spark, rows)
    labels = made.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    # The repeated row of the table is learned from twice.
    vectors = [(plain_features(t), int(i % 3 == 0)) for i, t in [rows[0], *rows]]
    rng = np.random.default_rng(3)
    w = plain_ftrl(vectors, [k for _ in range(toxicity.EPOCHS) for k in rng.permutation(len(vectors))])
    assert any(v for i, v in w.items() if i != -1)
    got = {r.doc_id: r.score for r in toxicity.score(made, toxicity.train(made, labels)).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-sum(w.get(f, 0) for f in [*plain_features(t), -1]))), abs=1e-5)


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Ftrl, "learn", lambda self, i, y: seen.append((len(i), y)))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(toxicity, "LONGEST", 300)
    made = documents(spark, [(i, f"w{i} " * (200 if i % 10 == 9 else 20)) for i in range(200)])
    labels = made.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.train(made, labels)
    for label in (0, 1):
        assert 2000 // 100 - 2 <= sum(y == label for _, y in seen) // toxicity.EPOCHS <= 2000 // 60


def test_toxicity_of_ties_repeated_rows_and_a_very_long_text(spark):
    long = "calm words " * 50_000
    made = documents(spark, [(1, "awful grob"), (1, "awful grob"), (2, "calm words"), (3, long), (4, None)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (9, 1)], "doc_id long, toxic int")
    got = [(r.doc_id, r.score) for r in toxicity.score(made, toxicity.train(made, labels)).collect()]
    assert sorted(d for d, _ in got) == [1, 1, 1, 2, 3, 4]  # the first row of these tables comes twice
    assert len({s for d, s in got if d == 1}) == 1 and all(0 <= s <= 1 for _, s in got)


def test_language_id_equals_a_plain_forward_pass(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur le tapis ") * (1 + i % 30)) for i in range(60)] + [(60, "x"), (61, "le chat est sur le tapis " * 2000)]
    made = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("en"))
    model = language_id.train(made.filter("doc_id < 60"))
    p, widths = model.p, np.repeat(language_id.WIDTHS, language_id.FILTERS)
    wide, size = max(language_id.WIDTHS), language_id.WINDOW

    def plain(window):
        x = [*window, *[language_id.PAD] * (size - len(window))]
        emb = [p["emb"][b] for b in x]
        top = []
        for f, width in enumerate(widths):
            kernel = p["conv"][: width * language_id.DIM, f]
            top.append(max(0.0, max(float(np.concatenate(emb[at : at + width]) @ kernel) for at in range(size - wide + 1)) + float(p["bias"][f])))
        out = np.exp(np.array(top) @ p["out"] + p["base"])
        return out / out.sum()

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(made, model).collect()}
    for i, t in [rows[0], rows[1], rows[58], rows[60]]:
        data = t.encode()
        s = next(slices(pa.array([t])))
        start, _, held = language_id.windows(s)
        assert sum(held) == len(data)
        share = sum(plain(s.data[a : a + n].tolist()) * n for a, n in zip(start, held, strict=True)) / len(data)
        assert got[i] == (model.labels[int(share.argmax())], pytest.approx(share.max(), abs=1e-4))
    assert got[61][0] == "fr"


def test_lm_scoring(docs, empty):
    held = F.col("doc_id") % 4 == 0
    got = lm_scoring.score_documents(docs, held).collect()
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in TEXTS.items()}
    c = Counter()
    for r in got:
        if not r.held_out:
            c.update(tokens[r.doc_id])
    n, v = sum(c.values()), len(c)
    for r in got:
        own = tokens[r.doc_id]
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    assert lm_scoring.score_documents(empty, held).count() == 0


def test_lm_scoring_beats_the_base(spark):
    got = QUERIES["op4_lm_scoring"](spark, SF.replace("0.001", "0.01")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    # Scores are negative: at least two percent closer to zero than those of word counts.
    assert got[0] > 0.98 * got[1]


def test_lm_scoring_learns_from_all_training_documents(spark):
    docs = documents(spark, [(i, f"n{i} " + "left right up down " * 1500) for i in range(12)]).distinct()
    held = F.col("doc_id") == 0
    got = lm_scoring.score_documents(docs, held).collect()
    # By counts alone each word of the cycle is one of four.
    assert len(got) == 12
    assert all(r.score > 0.8 * r.base_score for r in got)


def test_lm_scoring_trains_every_document_once(spark):
    coded = spark.range(500).selectExpr("id AS doc_id", "id % 10 = 0 AS held_out", "20000L AS n_tokens")
    rounds = [[(r.doc_id, r.shard) for r in d.collect()] for d in lm_scoring.training_rounds(coded)]
    assert sorted(d for found in rounds for d, _ in found) == [i for i in range(500) if i % 10]
    shards = [{s for _, s in found} for found in rounds]
    assert all(len(s) > 1 for s in shards) and len(set.union(*shards)) == sum(map(len, shards))


def test_lm_scoring_does_not_depend_on_the_layout(spark):
    docs = documents(spark, [(i, sentence(i % 7, 80)) for i in range(60)])
    held = F.col("doc_id") % 4 == 0
    one, two = ({r.doc_id: r.score for r in lm_scoring.score_documents(docs.repartition(n), held).collect()} for n in (1, 7))
    assert one == pytest.approx(two, rel=1e-4)


def plain_log10(model, codes):
    """The network word by word, in plain formulas."""
    p, v, n, h, total, before = model.p, model.v, lm_scoring.HIDDEN, np.zeros(lm_scoring.HIDDEN), 0.0, model.v.start
    for y in codes.tolist():
        e, r = p["emb"][before].astype(float), h @ p["rec"].astype(float)
        z, s = (1 / (1 + np.exp(-(e[k : k + n] + r[k : k + n]))) for k in (0, n))
        h = (1 - z) * h + z * np.tanh(e[2 * n :] + s * r[2 * n :])
        c = v.groups + y - v.head if y >= v.head else y // v.group
        a = np.exp(np.append(h, 1) @ p["cls"])
        total += np.log10(a[c] / a.sum())
        if y < v.head:
            b = np.exp(np.append(h, 1) @ p["word"][c])
            total += np.log10(b[y % v.group] / b.sum())
        before = y
    return total


def test_lm_scoring_equals_a_plain_forward_pass():
    r = np.random.default_rng(1)
    v = lm_scoring.Vocabulary([(f"w{i}", 1000 - i) for i in range(1000)], np.arange(1.0, 33.0), 10**6, 5000)
    model = lm_scoring.Gru(v)
    model.p = {k: w + r.normal(0, 0.3, w.shape).astype(np.float32) for k, w in model.p.items()}
    docs = [r.integers(0, 1000, k) for k in (1, 5, 90, 33)] + [np.array([v.head + 3, 5, v.head, 7])]
    assert lm_scoring.log_likelihoods(model, docs) == pytest.approx([plain_log10(model, d) for d in docs], rel=1e-4)


def test_lm_scoring_learns_a_cycle_through_its_state():
    v = lm_scoring.Vocabulary([(f"w{i}", 10) for i in range(16)], np.full(32, 1.0), 160, 16)
    model, docs = lm_scoring.Gru(v), [np.array([0, 1, 2, 0, 2, 1] * 40)] * 8
    memory, streams = {k: np.full_like(w, 1e-5) for k, w in model.p.items()}, lm_scoring.Streams([np.array([0, 1, 2, 0, 2, 1] * 40)] * 8, 8, v.start)
    before = lm_scoring.log_likelihoods(model, docs)
    for _ in range(40):
        h = np.zeros((lm_scoring.HIDDEN, 8), dtype=np.float32)
        for at, live in streams.windows(lm_scoring.STEPS):
            h = model.train(streams.x[at], streams.y[at], streams.first[at] & live, live, h, 0.1, memory)
    # What follows a 0 depends on the word before it.
    assert (lm_scoring.log_likelihoods(model, docs) > 0.1 * before).all()


def test_lm_scoring_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    v = lm_scoring.Vocabulary([(f"w{i}", 100 - i) for i in range(64)], np.arange(1.0, 33.0), 10**4, 500)
    model = lm_scoring.Gru(v)
    model.p = {k: w + r.normal(0, 0.3, w.shape).astype(np.float32) for k, w in model.p.items()}
    h, y = r.normal(0, 0.5, (20, lm_scoring.HIDDEN)).astype(np.float32), r.integers(0, 64, 20)
    grads = {k: np.zeros_like(model.p[k]) for k in ("cls", "word")}
    model.losses(h, y, grads)
    for k, at in (("cls", (3, 1)), ("cls", (16, 0)), ("word", (0, 2, 5)), ("word", (1, 16, 4))):
        sides = []
        for move in (1e-2, -1e-2):
            model.p[k][at] += move
            sides.append(-model.losses(h, y)[0].astype(float).sum())
            model.p[k][at] -= move
        assert grads[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.05, abs=0.02)


def test_lm_scoring_sizes_grow_with_the_vocabulary():
    small, large, huge = (lm_scoring.sizes(n) for n in (1000, 10**7, 10**9))
    assert all(a < b < c for a, b, c in zip(small, large, huge, strict=True))
    assert len({lm_scoring.tail_class(97 + i, large[2]) for i in range(26)}) == 26


def test_lm_scoring_numbers_words(docs):
    find = {lm_scoring.END: 0}
    for s in slices(pa.array(list(TEXTS.values()), pa.string()), 1000):
        for i, found in enumerate(lm_scoring._numbered(s, find)):
            names = list(find)
            assert [names[k] for k in found] == lm_scoring.tokens(list(TEXTS.values())[s.first + i])


def thue_morse(n=512):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_alike_structure_stay_apart(spark):
    one, two = thue_morse()
    rows = [(1, one), (2, two), (3, f"{one}\n{two}\n{one}"), (4, f"{one} x {two} x {one} y {one} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge_quality(docs).collect()} == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 0)}


def test_ngram_join_spreads_sets_at_every_similarity():
    rng = np.random.default_rng(2)
    for percent in (51, 60, 80, 95, 100):
        for n in (1, 2, 3, 7, 26, 27, 60, 200, 513):
            found = list(ngram_join.Bands(percent).signatures(np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))))
            assert all(len(sig) == len(place) for sig, place in found)
    for percent in (0, 50, 101):
        with pytest.raises(ValueError):
            ngram_join.Bands(percent)


def test_ngram_join_of_a_group_without_its_original(spark):
    r = np.random.default_rng(5)
    words, rows = sentence(77, 150).split(), []
    for i in range(150):
        own = list(words) if i % 9 else words[: 150 - 3 * int(r.integers(0, 9))]
        for at in r.choice(len(own), r.integers(3, 7), replace=False):
            own[at] = f"edit{r.integers(0, 60)}"
        rows.append((i, " ".join(own)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 20


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(5, "a b c d e f"), (9, "a b c d e f"), (5, "g h i j k l"), (7, "G h i j k l")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, gone int, gone_id int, gone_digest int, spans int, doc int")
    assert {(r.doc_id, r.text) for r in exact_dedup.keep_latest(docs).collect()} == {(9, rows[0][1]), (7, rows[3][1])}
    assert {(r.doc_id, r.text) for r in ngram_join.keep_one_per_group(docs).collect()} == {(5, rows[0][1]), (5, rows[2][1])}
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert out.count() == 4


def test_a_kept_table_leaves_no_shuffle_files(spark, tmp_path):
    blocks, setting = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    names = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, usual = names(), spark.conf.get(setting)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    kept = Scratch(spark).keep(df, "counts")
    for _ in range(50):
        if not (left := names() - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting) == usual
    assert kept.agg(F.sum("count")).first()[0] == df.agg(F.sum("count")).first()[0] == 5000


def test_ngram_join_shuffles_its_signatures_in_parts(spark):
    rows = [(i, sentence(500 + i, 3 + i * i % 397)) for i in range(150)] + [(150, "one"), (151, " "), (152, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shape = "sig long, class long, place long"
    whole = sorted(map(tuple, docs.mapInArrow(ngram_join._signature_rows(80), shape).distinct().collect()))
    sizes = [(len(s),) for s in ngram_join.word_sets(next(slices(pa.array([t or "" for _, t in rows])))) if len(s)]
    parts, found = ngram_join._passes(spark.createDataFrame(sizes, "n long"), 80, 2), []
    for low, high in parts:
        of = docs.filter(ngram_join._long_enough(low)) if low else docs
        found.append(list(map(tuple, of.mapInArrow(ngram_join._signature_rows(80, low, high), shape).distinct().collect())))
    assert len(parts) == ngram_join.PASSES == 2
    assert sorted(found[0] + found[1]) == whole
    assert max(map(len, found)) < 0.7 * len(whole)
    assert ngram_join._passes(spark.createDataFrame([], "n long"), 80, 2) == [(0, len(ngram_join._EDGES))]


def test_ngram_join_verifies_pairs_in_parts(spark, monkeypatch):
    r = np.random.default_rng(31)
    words, rows, kept, keep = sentence(88, 100).split(), [], [], Scratch.keep
    for i in range(60):
        own = list(words)
        for at in r.choice(100, r.integers(0, 7), replace=False):
            own[at] = f"edit{r.integers(0, 300)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(ngram_join, "LEAST_CARRIED", 500)
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: (kept.append(name), keep(self, df, name, *a))[1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert sum(name.startswith("links0_") for name in kept) > 3
