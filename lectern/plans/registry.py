"""All queries of the library and their SQL twins, by operator module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import align, catalog, chunking, incremental, jobs, library, models, notes, search, textjobs, transcript
from lectern.streaming import queries as streams

MODULES = (catalog, library, transcript, chunking, search, align, jobs, textjobs, notes, incremental, models, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ranked_search"](spark, sf_dir)
