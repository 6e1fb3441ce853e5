"""Model calls as batch inference: the model is a plug-in function, errors are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lectern.functions.durable import written
from lectern.functions.rules import clean_text
from lectern.operators.chunking import _WS, _let
from lectern.sources.model import cte, query

DIM = 64


def hashing_embedding(text, dim: int = DIM):
    """#109 without a model: hashed word counts, signed, of length 1; blank texts are `[empty]`."""
    text = F.when(clean_text(text) == "", "[empty]").otherwise(F.lower(clean_text(text)))
    hashes = F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    places = lambda hs: F.transform(hs, lambda h: F.when(h > 0, F.pmod(h, F.lit(dim))).otherwise(-1 - F.pmod(h, F.lit(dim))))
    count = lambda ps, i: F.size(F.filter(ps, lambda p: p == i)) - F.size(F.filter(ps, lambda p: p == -1 - i))
    raw = _let(places(hashes), lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: count(ps, i).cast("double")))
    unit = lambda v: _let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(v, lambda x: F.when(n > 0, F.round(x / n, 6)).otherwise(0.0)))
    return _let(raw, unit)


def embedded(rows: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 48) -> DataFrame:
    """#109: rows with `vector`; with a model, texts go to it in batches and it must answer every one."""
    if model is None:
        return rows.withColumn("vector", hashing_embedding(F.col("text")))

    @F.pandas_udf(ArrayType(FloatType()))
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t if t and t.strip() else "[empty]" for t in part]
            out: list = []
            for at in range(0, len(texts), batch):
                got = model(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError("the model answered another number of texts")
                out += got
            yield pd.Series(out)

    return rows.withColumn("vector", call("text"))


def transformed(batches: DataFrame, model: Callable[[list[tuple[int, str]]], dict[int, str]], attempts: int = 2) -> DataFrame:
    """#110: (lecture, ids, texts) batches through a model that may fail: two attempts, then halves; a single failing item is an error row."""

    def solve(items: list[tuple[int, str]]) -> list[tuple[int, str | None, str | None]]:
        for _ in range(attempts):
            try:
                got = model(items)
            except Exception as e:  # the plug-in may raise anything
                error = f"{type(e).__name__}: {e}"[:1000]
                continue
            if set(got) == {i for i, _ in items}:
                return [(i, got[i], None) for i, _ in items]
            error = "the reply has other ids"
        if len(items) == 1:
            return [(items[0][0], None, error)]
        half = len(items) // 2
        return solve(items[:half]) + solve(items[half:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(key, *r) for key, ids, texts in zip(part["lecture"], part["ids"], part["texts"], strict=True) for r in solve(list(zip(map(int, ids), texts, strict=True)))]
            yield pd.DataFrame(rows, columns=["lecture", "id", "text", "error"])

    return batches.select("lecture", "ids", "texts").mapInPandas(run, "lecture long, id long, text string, error string")


def item_batches(rows: DataFrame, size: int) -> DataFrame:
    """Items of each lecture in order, `size` at a time."""
    k = F.floor((F.row_number().over(Window.partitionBy("lecture").orderBy("segment")) - 1) / size)
    listed = F.array_sort(F.collect_list(F.struct("segment", "text")))
    out = rows.withColumn("batch", k).groupBy("lecture", "batch").agg(listed.alias("x"))
    return out.select("lecture", "batch", F.transform("x", lambda r: r["segment"]).alias("ids"), F.transform("x", lambda r: r["text"]).alias("texts"))


def parsed_replies(replies: DataFrame) -> DataFrame:
    """#111: a model's reply to its items: fenced block or outermost braces, or the reason why it is none.

    Of each item: id, keep (true where it is left out, null where it is no boolean), text and reason.
    """
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    rows = replies.withColumn("body", F.when(fenced != "", fenced).otherwise(braces))
    get = "try_variant_get(x, '$.{0}', '{1}')".format
    kind = "schema_of_variant(variant_get(x, '$.keep'))"
    keep = f"CASE WHEN variant_get(x, '$.keep') IS NULL THEN true WHEN {kind} = 'BOOLEAN' THEN {get('keep', 'boolean')} END"
    item = f"named_struct('id', {get('id', 'long')}, 'keep', {keep}, 'text', {get('text', 'string')}, 'reason', {get('reason', 'string')})"
    items = F.expr(f"transform(try_variant_get(try_parse_json(body), '$.items', 'array<variant>'), x -> {item})")
    reason = F.when(F.col("body") == "", "no object").when(F.expr("try_parse_json(body)").isNull(), "not JSON").when(items.isNull(), "no items")
    return rows.select("reply_id", items.alias("items"), reason.alias("reason"))


# What a cleaned text keeps of the length and of the words of the kept sources.
LENGTHS, WORDS_KEPT = (0.45, 1.65), 0.55


def guarded_replies(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """#111: ids must be the asked ones in order, keep must be boolean, kept texts must not be empty, and what goes needs a reason; kept texts must keep length and words (#63).

    `asked` holds (reply_id, ids, texts); what is wrong first is the reason.
    """
    got = parsed_replies(replies).join(asked, "reply_id")
    ids = F.transform("items", lambda x: x["id"])
    bad_keep = F.exists("items", lambda x: x["keep"].isNull())
    empty = F.exists("items", lambda x: x["keep"] & (clean_text(x["text"]) == ""))
    silent = F.exists("items", lambda x: ~x["keep"] & x["reason"].isNotNull() & (clean_text(x["reason"]) == ""))
    first = F.coalesce("reason", F.when(~ids.eqNullSafe(F.col("ids")), "other ids").when(bad_keep, "keep is not boolean").when(empty, "empty text").when(silent, "no reason"))
    rows = written(got.select("reply_id", first.alias("reason"), "items", "texts"))

    both = rows.filter("reason IS NULL").select("reply_id", F.explode(F.arrays_zip("items", "texts")).alias("x")).filter("x.items.keep")
    kept = both.select("reply_id", F.coalesce("x.texts", F.lit("")).alias("source"), clean_text("x.items.text").alias("clean"))
    size = kept.groupBy("reply_id").agg(F.sum(F.length("source")).alias("before"), F.sum(F.length("clean")).alias("after"))
    words = lambda c, n: kept.select("reply_id", F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"((?U)[\w'-]+)"), 1)).alias("word")).groupBy("reply_id", "word").agg(F.count("*").alias(n))
    shared = words("source", "a").join(words("clean", "b"), ["reply_id", "word"], "left").groupBy("reply_id").agg(F.sum("a").alias("words"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("same"))
    ratio = F.col("after") / F.col("before")
    wrong = F.when((F.col("before") > 0) & ~ratio.between(*LENGTHS), "length").when(F.col("same") / F.col("words") < WORDS_KEPT, "wording")
    bounds = size.join(shared, "reply_id", "left").select("reply_id", wrong.alias("bound"))
    return rows.join(bounds, "reply_id", "left").select("reply_id", F.coalesce("reason", "bound").alias("reason"))


def _lower_unless_marked(items: list[tuple[int, str]]) -> dict[int, str]:
    """A stand-in model: fails on texts with a digit 7 in them, lower-cases others."""
    if any("7" in t for _, t in items):
        raise ValueError("marked")
    return {i: t.lower() for i, t in items}


def _replies(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    rid = (F.col("lecture") * 1000 + F.col("segment")).alias("reply_id")
    whole = "to_json(named_struct('items', array(named_struct('id', segment, {}))))".format
    body = F.expr(f"""CASE segment % 11 WHEN 0 THEN 'Sure: ```json ' || {whole("'keep', true, 'text', text")} || '```' WHEN 1 THEN 'none' WHEN 2 THEN '{{"items":[{{"id":5000,"keep":true,"text":"x"}}]}}' WHEN 3 THEN 'x {{"items":[{{"id":' || segment || ',"keep":"maybe","text":"a"}}]}} y'
      WHEN 4 THEN '{{"items":[{{"id":' || segment || ',"keep":true,"text":" "}}]}}' WHEN 5 THEN '{{"items": [' WHEN 6 THEN '{{"items":[{{"id":' || segment || ',"keep":false,"text":""}}]}} ' WHEN 7 THEN '{{"items":[{{"id":' || segment || ',"text":"ok"}}]}}'
      WHEN 8 THEN {whole("'keep', true, 'text', repeat('zzz ', greatest(1, length(text) div 4))")} WHEN 9 THEN {whole("'text', text")} ELSE '{{"items":[{{"id":' || segment || ',"keep":false,"reason":" "}}]}}' END""")
    return s.select(rid, body.alias("reply")), s.select(rid, F.array(F.col("segment").cast("long")).alias("ids"), F.array("text").alias("texts"))


QUERIES = {
    "hashed_embeddings": query(lambda s: embedded(s.select("lecture", "segment", "text")).select("lecture", "segment", "vector"), "m_segments"),
    "model_embeddings": query(lambda s: embedded(s.select("lecture", "segment", "text"), lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]).select("lecture", "segment", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("spaces")), "m_segments"),
    "validated_transform": query(lambda s: transformed(item_batches(s, 4), _lower_unless_marked), "m_segments"),
    "reply_guard": query(lambda s: guarded_replies(*_replies(s)), "m_segments"),
}

ORACLES = {
    "model_embeddings": cte("m_segments") + " SELECT lecture, segment, length(t) AS chars, length(t) - length(replace(t, ' ', '')) AS spaces FROM (SELECT lecture, segment, CASE WHEN trim(text) = '' THEN '[empty]' ELSE text END AS t FROM m_segments)",
    "validated_transform": cte("m_segments") + " SELECT lecture, segment AS id, CASE WHEN NOT contains(text, '7') THEN lower(text) END AS text, CASE WHEN contains(text, '7') THEN 'ValueError: marked' END AS error FROM m_segments",
    "reply_guard": cte("m_segments") + f""", r AS (SELECT lecture * 1000 + segment AS reply_id, segment % 11 AS k, text, CASE segment % 11 WHEN 7 THEN 'ok' WHEN 8 THEN trim(repeat('zzz ', greatest(1, length(text) // 4))) ELSE {_WS.format('text')} END AS c FROM m_segments),
      b AS (SELECT *, length(text) > 0 AND NOT length(c) / length(text) BETWEEN 0.45 AND 1.65 AS far, (SELECT coalesce(sum(least(a.n, coalesce(b.n, 0))) / sum(a.n), 1) FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS w) GROUP BY w) a LEFT JOIN (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS w) GROUP BY w) b USING (w)) AS share FROM r)
      SELECT reply_id, CASE WHEN k IN (1, 5) THEN 'no object' WHEN k = 2 THEN 'other ids' WHEN k = 3 THEN 'keep is not boolean' WHEN k = 4 OR (k IN (0, 9) AND c = '') THEN 'empty text' WHEN k = 10 THEN 'no reason' WHEN k = 6 THEN NULL WHEN far THEN 'length' WHEN share < 0.55 THEN 'wording' END AS reason FROM b""".replace("\\\\", "\\"),
}
