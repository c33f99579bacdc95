"""Tables in the folder that driver and executors share.

Iterative operators cut their lineage here: an intermediate result is written
as Parquet under ``spark.checkpoint.dir`` and read back, so a lost executor
costs a re-read, never a recomputation of the whole loop.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; set here only for local masters without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "graphloom-" + str(os.getuid()))


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Stage:
    """Intermediate tables of one operator call; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` and returns it reread; its shuffle files go once it is written."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _settings(self.spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded_broadcast(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """Hints a broadcast when ``df`` was counted to have at most ``rows`` rows, else leaves the join to Spark."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small
