"""From raw documents to packed training sequences: five stages, each one operator.

Every stage reads what its predecessor kept and applies its decisions; all but the
last return rows with the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, language_id, ngram_join, packing, suffix_dedup
from lectern.llm._spark import Scratch, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a recognisable language."""
    return language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the largest id."""
    return exact_dedup.keep_latest(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keeps the document with the smallest id."""
    return ngram_join.keep_one_per_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document already has."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every token into a training sequence."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_duplicates", near), ("suffix_dedup", passages), ("packing", packed)]

#: A trained classifier decides in the first stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
