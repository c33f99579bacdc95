"""Facts read from text: suppression directives, hunks of unified diffs, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed value: syntax of a suppression directive
DIRECTIVE = r"//\s*al-sem-ignore\s+([\w-]+)(?:\s*:\s*(.+))?"
#: Fingerprints of one baseline document.
ROWS = 100_000
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line, body), lines from 1, of every text."""
    return files.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def suppressions(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, detector, line, reason) of every directive; a line gives its first."""
    found = lines(files.where(F.col(text).contains("al-sem-ignore")), key, text).where(F.col("body").rlike(DIRECTIVE))
    part = lambda i: F.regexp_extract("body", DIRECTIVE, i)
    return found.select(key, part(1).alias("detector"), "line", F.nullif(part(2), F.lit("")).alias("reason"))


def unified_hunks(diffs: DataFrame, key: str = "diff", text: str = "text") -> DataFrame:
    """(key, path, change, old_start, old_count, new_start, new_count) of every hunk.

    A hunk belongs to the last file named before it; a count that is not written is 1. File
    headers count only outside hunks' lines, where no line starts with ``+`` or ``-`` by itself.
    """
    body = F.regexp_replace("body", "\r$", "")
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    named = lambda mark: F.last(F.when(F.col("body").startswith(f"{mark} "), F.regexp_extract("body", rf"^{mark.replace('+', '[+]')} (?:[ab]/)?([^\t]*)", 1)), True).over(w)
    at = lines(diffs, key, text).withColumn("body", body).withColumn("old", named("---")).withColumn("new", named("+++"))
    num = lambda i, none: F.coalesce(F.try_to_number(F.regexp_extract("body", _HUNK, i), F.lit("999999999")).cast("int"), F.lit(none))
    path = F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new"))
    change = F.when(F.col("old") == "/dev/null", "added").when(F.col("new") == "/dev/null", "deleted").when(F.col("old") != F.col("new"), "renamed").otherwise("modified")
    return at.where(F.col("body").rlike(_HUNK)).select(key, path.alias("path"), change.alias("change"), num(1, 0).alias("old_start"), num(2, 1).alias("old_count"), num(3, 0).alias("new_start"), num(4, 1).alias("new_count"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline file; a missing file is an empty baseline, a malformed one an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "fingerprint string")
    doc = spark.read.schema("schemaVersion string, fingerprints array<string>").option("multiLine", p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(p)).option("mode", "FAILFAST").json(path)
    return doc.select(F.explode("fingerprints").alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    """The distinct fingerprints of ``findings``, sorted, in documents of at most ROWS each, which a reader takes together."""
    f = findings.select("fingerprint").where("fingerprint is not null").distinct()
    parts = f.repartitionByRange("fingerprint").sortWithinPartitions("fingerprint").withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    doc = parts.groupBy("_p", F.floor(F.col("_n") / ROWS).alias("_k")).agg(F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    doc.orderBy("_p", "_k").select(F.lit("1.0.0").alias("schemaVersion"), "fingerprints").write.mode("overwrite").json(path)
