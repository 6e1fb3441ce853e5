"""The pipeline against a brute-force version of its stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import language_id, ngram_join, packing
from tests.llm.data import SHAPE, documents, sentence, texts
from tests.llm.test_operators import brute_components


def nodes(rows):
    """An id of its own for every distinct row: of several texts with one doc_id, the first by digest keeps it."""
    out, beyond = {}, max(d for d, _ in rows) + 1
    for d, t in sorted(set(rows), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest())):
        out[d, t] = d if d not in out.values() else (beyond := beyond + 1)
    return out


def brute(rows, model, spark):
    """(doc_id, text) of all rows that the first four stages keep, cut as the fourth does."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lang = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    kept = [(d, t) for d, t in rows if lang[d].lang_pred != "und" and lang[d].score >= language_id.MIN_SCORE]
    last = {}
    for d, t in kept:
        key = t.encode().lower()
        last[key] = max(d, last.get(key, d))
    kept = [(d, t) for d, t in kept if last[t.encode().lower()] == d]
    node = nodes(kept)
    label = brute_components([(n, t) for (_, t), n in node.items()])
    least = {}
    for (d, _), n in node.items():
        least[label[n][1]] = min(least.get(label[n][1], (d, n)), (d, n))
    kept = [(d, t) for d, t in kept if least[label[node[d, t]][1]][1] == node[d, t]]
    first, out = {}, []
    for d, t in sorted(kept):
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in kept:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        out.append((d, np.frombuffer(b, dtype=np.uint8)[~gone].tobytes().decode(errors="ignore")))
    return out


def test_pipeline(spark, tmp_path):
    rows = [(d, t) for d, t in texts() if t is not None] + [(30, sentence(71, 90)), (30, sentence(72, 80)), (40, sentence(73, 3000))]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [(r.doc_id, r.text) for r in docs.distinct().collect()]
    kept = brute(rows, language_id.train(language_id.training_rows(spark.read.parquet(str(tmp_path / "documents.parquet")))), spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    # The fixture repeats row 1, which does not survive exact deduplication.
    expected = [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in kept]
    assert sum(d == 30 for d, _ in expected) == 2
    # Every piece is a part of one of its document's texts, and the parts make up all of them.
    left = Counter((d, len(ids)) for d, ids in expected)
    assert Counter({k: sum(r.length for r in got if (r.doc_id, r.doc_tokens) == k) // k[1] for k in left}) == left
    for d, ids in expected:
        own = sorted((r for r in got if (r.doc_id, r.doc_tokens) == (d, len(ids))), key=lambda r: r.start)
        at = 0
        for r in own:
            if r.start == at and zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes()) == r.ids_crc32:
                at += r.length
        assert at == len(ids)
    # Sequences have no gaps and hold at most 4096 tokens; all but those of a power of two are padded to 4096, which is little.
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096
    assert sum(4096 - n for n in used.values() if n & (n - 1)) <= 4096


def test_no_text_of_a_repeated_id_is_lost(spark):
    one, two = sentence(80, 90), sentence(81, 90)
    rows = [(3, one), (5, one + " x"), (5, two), (None, one), (7, two + " y"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, digest int")
    got = ngram_join.keep_one_per_group(docs)
    assert got.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in got.collect()}
    # The two texts of 5 are told apart, and of each group the smallest doc_id stays.
    assert kept == {(3, one), (5, two), (None, one), (9, None), (9, "")}


def test_stages_keep_the_columns(spark):
    docs = documents(spark, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    nothing = spark.createDataFrame([], SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
