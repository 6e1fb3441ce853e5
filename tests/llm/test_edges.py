"""Rows without ids, repeated rows and rules from tables."""

from pyspark.sql import functions as F

from lectern.llm import language_id, lm_scoring, toxicity, url_filters
from lectern.llm._spark import split_by
from tests.compare import connection, same
from tests.llm.data import sentence


def test_rows_without_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id: r.x for r in rows.select("doc_id", split_by("doc_id", 3, 1).alias("x")).collect()}[None] is False
    texts = [(None, sentence(1, 40), "en"), (None, sentence(1, 40), "en"), (3, sentence(2, 40), "fr"), (4, sentence(3, 40), "en"), (5, None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    scored = lm_scoring.score_documents(docs, split_by("doc_id", 10, 0)).collect()
    assert len(scored) == 5
    assert [r.held_out for r in scored if r.doc_id is None] == [False, False]
    # What counts as a training token is what the model has learned from: all rows that are not held out.
    assert {r.train_tokens for r in scored} == {sum(r.n_tokens for r in scored if not r.held_out)}
    assert docs.count() == language_id.identify(docs, language_id.train(language_id.training_rows(docs))).count()
    labels = spark.createDataFrame([(None, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).filter("doc_id IS NULL AND score BETWEEN 0 AND 1").count() == 2


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), (F.col("id") % 3000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = docs.filter("lang IS NOT NULL")
    share = language_id.SAMPLE_PER_LANG / rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * share).dropDuplicates(["doc_id", "lang", "text"]).count()
    assert 0 < picked < 1.2 * language_id.SAMPLE_PER_LANG
    assert language_id.train(docs).labels == ["en"]


def test_repeated_pages_and_long_urls(spark, tmp_path):
    long = "http://a.org/" + "x" * 50_000 + "/login"
    urls = [(1, "http://example.org/es/a"), (1, "http://a.net/x"), (1, "http://a.net/x"), (2, long), (3, long.replace(".org", ".net")), (None, "http://ads.b.net/"), (4, "http://b.net/wp-admin"), (5, "http://b.net/a.exe?x"), (6, "http://b.net/a;jsessionid=1")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filters.judge_urls(pages)
    found = {(r.page_id, r.rule, r.verdict) for r in got.collect()}
    assert found == {(1, "example.org/es/", "block"), (1, None, "allow"), (2, "org/", "allow"), (3, None, "block"), (None, None, "block"), (4, None, "block"), (5, None, "block"), (6, None, "block")}
    con = connection(tmp_path)
    con.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(got, con, url_filters.OP9_SQL)


def test_rules_from_a_table(spark):
    rules = [("allow", f"site{i}.net/", None, None, None) for i in range(3000)] + [("block", None, "jobs", r"/jobs(?:/|$)", [["jobs"]]), ("block", None, "digits", r"\d{9}", None)]
    table = spark.createDataFrame(rules, "verdict string, address string, name string, pattern string, literals array<array<string>>")
    index = url_filters.RuleIndex(url_filters.rules_from(table), {"net": 10**6})
    assert len(index.always) == 1
    assert index.judge("www.site42.net", "/jobs") == ("site42.net/", "allow")
    assert index.judge("other.net", "/jobs/1") == (None, "block")
    assert index.judge("other.net", "/a123456789") == (None, "block")
    # Of thousands of rules an address meets those of its own tokens.
    assert len(index.candidates("www.site42.net/jobs")) < 10
