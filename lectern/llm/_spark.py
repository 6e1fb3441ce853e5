"""Shared Spark helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch where each row brings a whole text and a list.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one for a local master; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A table that is written survives lost executors and cuts the lineage.
    `forget` deletes one that nothing reads any more. The shuffle files of a step
    go as soon as its table is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Write `df`; `batch_rows` limits the Arrow batches of this step, for rows that are wide."""
        self.n += 1
        path = f"{self.at}/{self.n}-{name}"
        settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows} if batch_rows else {})
        usual = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in usual.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in [n for n in names if n in self.paths]:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, do not travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by(column: str, divisor: int, *rests: int):
    """True where crc32 of the id as decimal text leaves one of these remainders; false where there is no id."""
    return F.coalesce((F.crc32(F.col(column).cast("string").cast("binary")) % divisor).isin(*rests), F.lit(False))
