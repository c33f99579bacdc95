"""Keeps file facts current from a stream of file events, by ``foreachBatch``.

``events(path, seq, kind, text)``, kind ``saved`` or ``removed``. A batch keeps the last
event of each path. Facts lie in buckets by a hash of their path; a batch writes
anew only the buckets that its paths fall into, each under the batch's number, and then one
manifest that names every bucket's number. Readers see one version or the next, and
a batch that is run again after a failure gives the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    last = events.groupBy("path").agg(F.max_by(F.struct("kind", "text"), "seq").alias("e"))
    return last.select("path", "e.kind", "e.text")


class FactTable:
    """``facts`` of files, one row or more a path; ``derive(files)`` gives them from ``files(path, text)``."""

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame], schema: str, buckets: int = 64):
        self.spark, self.root, self.derive, self.schema, self.buckets = spark, root.rstrip("/"), derive, schema, buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        p = self._fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last batch whose facts are complete, -1 before the first."""
        p, fs = self._path("CURRENT")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=-1) if fs.exists(p) else -1

    def _manifest(self, version: int) -> dict[int, int]:
        """The batch that wrote each bucket that has facts."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").json(f"{self.root}/CURRENT/{version:012d}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.root}/v{batch}/b={bucket}"

    def current(self) -> DataFrame:
        return self._read([self._folder(b, v) for b, v in sorted(self._manifest(self.version()).items())])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Splices a batch in: facts of its paths go, those of saved files come; buckets without one of its paths stay as they lie."""
        old = self.version()
        if batch_id <= old:
            return
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        last = coalesced(batch).withColumn("b", bucket)
        hit = sorted(r["b"] for r in last.select("b").distinct().collect())  # at most ``buckets`` numbers
        before = self._manifest(old)
        kept = self._read([self._folder(b, before[b]) for b in hit if b in before]).join(last.select("path"), "path", "left_anti")
        new = self.derive(last.where("kind = 'saved'").select("path", "text"))
        out = kept.unionByName(new).withColumn("b", bucket)
        out.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/v{batch_id}")
        p, fs = self._path(f"v{batch_id}")
        wrote = {int(s.getPath().getName().removeprefix("b=")) for s in fs.listStatus(p) if s.getPath().getName().startswith("b=")}
        now = {b: v for b, v in before.items() if b not in hit} | dict.fromkeys(wrote, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").json(f"{self.root}/.{batch_id}")
        (a, fs), (z, _) = self._path(f".{batch_id}"), self._path(f"CURRENT/{batch_id:012d}")
        fs.mkdirs(self._path("CURRENT")[0])
        fs.delete(z, True)
        fs.rename(a, z)  # from here on the version is seen
        for b, v in self._manifest(self._before(old)).items():  # readers of the version before this one go on
            if before.get(b) != v and now.get(b) != v:
                gone, fs = self._path(f"v{v}/b={b}")
                fs.delete(gone, True)

    def _before(self, version: int) -> int:
        p, fs = self._path("CURRENT")
        if version < 0:
            return -1
        return max((n for n in (int(s.getPath().getName()) for s in fs.listStatus(p)) if n < version), default=-1)

    def follow(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over all events that are there, batch by batch."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def watch(self, events: DataFrame, checkpoint: str, every: str = "200 milliseconds") -> StreamingQuery:
        """Runs on; events that arrive within ``every`` are one batch."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def file_events(spark: SparkSession, root: str, suffix: str = ".al") -> DataFrame:
    """A stream of ``saved`` events of the files below ``root``, in the order of their times. The file source tells of no removals; those come from a watcher's own stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.unix_micros("modificationTime").alias("seq"), F.lit("saved").alias("kind"), F.decode("content", "utf-8").alias("text"))


def watcher_events(changes: DataFrame) -> DataFrame:
    """Events of ``changes(path, seq, change, text)`` of a watcher: created and modified files are saved, deleted and renamed-away ones removed, an overflow asks for all."""
    kind = F.when(F.col("change").isin("created", "modified", "renamed-to"), "saved").when(F.col("change").isin("deleted", "renamed-from"), "removed").when(F.col("change") == "overflow", "overflow")
    return changes.withColumn("kind", kind).where("kind is not null").select("path", "seq", "kind", F.when(F.col("kind") == "saved", F.col("text")).alias("text"))
