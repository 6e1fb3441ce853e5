"""Cutting the lineage of steps that repeat."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. A cluster has to name one; a local master without one takes a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and later reads take only the columns that they need.

    `group_rows` limits the rows of a Parquet row group, for rows that are wide: readers decode up to a row group at once.
    """
    path = f"{shared_folder(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends Python at most `rows` rows at once. For wide rows: engine and Python hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the folder of `spark.checkpoint.dir`, so that a lost executor does not repeat what led to it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
