"""The flagship plan: facts in, a report's findings and an exit code out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import fingerprint
from graphloom.plans.gate import exit_code, first_findings, in_scope, select_findings, without_baseline, without_suppressed
from graphloom.rules import graph_rules  # noqa: F401  registers its detectors
from graphloom.rules.record_rules import chosen_detectors, run_detectors


@dataclass
class Report:
    findings: DataFrame
    before_baseline: DataFrame
    skipped: list[tuple[str, str]]
    exit_code: int


def projected(found: DataFrame, routines: DataFrame, places: DataFrame) -> DataFrame:
    """Findings with names, file, 1-based place, owning application and fingerprint.

    ``places(id, file, line, column)`` from 0, of operations, call sites and routines; a finding stands at its operation, else at its routine.
    """
    r = routines.select("routine_id", F.col("name").alias("routine_name"), "object_id", "app_guid", F.coalesce("is_dependency", F.lit(False)).alias("is_dependency") if "is_dependency" in routines.columns else F.lit(False).alias("is_dependency"))
    op = places.select(F.col("id").alias("op_id"), F.struct("file", "line", "column").alias("a"))
    home = places.select(F.col("id").alias("routine_id"), F.struct("file", "line", "column").alias("b"))
    j = found.join(r, "routine_id", "left").join(op, "op_id", "left").join(home, "routine_id", "left")
    at = F.coalesce("a", "b")
    out = j.withColumns({"file": at["file"], "line": at["line"] + 1, "column": at["column"] + 1, "tables": F.array_compact(F.array("table_id"))}).drop("a", "b")
    return out.withColumn("fingerprint", fingerprint(F.col("detector"), F.col("routine_id"), F.col("op_id"), F.col("table_id")))


def counters(found: DataFrame, reported: DataFrame, names: list[str]) -> DataFrame:
    """(detector, candidates, emitted) of every detector that ran, also of those without findings."""
    spark = found.sparkSession
    ran = spark.createDataFrame([(n,) for n in names], "detector string")
    c = found.groupBy("detector").agg(F.count(F.lit(1)).alias("candidates"))
    e = reported.groupBy("detector").agg(F.count(F.lit(1)).alias("emitted"))
    return ran.join(c, "detector", "left").join(e, "detector", "left").na.fill(0, ["candidates", "emitted"])


def analyze(facts: dict, places: DataFrame, detectors: list[str] | None = None, least: str | None = None, scope: str = "primary", limit: int | None = None, baseline: DataFrame | None = None, directives: DataFrame | None = None, fail_on: str | None = None) -> Report:
    """Detectors, then severity, scope, limit, baseline and suppressions, in this order; the baseline to save is what the limit left."""
    skipped: list[tuple[str, str]] = []
    chosen_detectors(detectors)
    found = projected(run_detectors(facts, detectors, skipped), facts["routines"], places)
    kept = first_findings(in_scope(select_findings(found, least), F.col("is_dependency"), scope), limit)
    out = kept if baseline is None else without_baseline(kept, baseline)
    out = out if directives is None else without_suppressed(out, directives)
    return Report(out, kept, skipped, exit_code(out, fail_on))
