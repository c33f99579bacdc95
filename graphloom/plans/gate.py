"""From findings to a report: severity and detector filters, scope, limit, baseline, suppressions, exit code.

``findings(detector, severity, file, line, fingerprint, ...)``; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import natural_key

#: From least to greatest.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(c: Column) -> Column:
    """0 for the least severity, null for an unknown word."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0)) - 1


def select_findings(findings: DataFrame, least: str | None = None, detectors: list[str] | None = None) -> DataFrame:
    out = findings
    if least is not None:
        out = out.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least))
    return out if detectors is None else out.where(F.col("detector").isin(detectors))


def in_scope(findings: DataFrame, is_dependency: Column, scope: str = "primary") -> DataFrame:
    """The primary scope drops findings of dependencies; an unknown object is kept."""
    return findings if scope == "all" else findings.where(~F.coalesce(is_dependency, F.lit(False)))


def report_order() -> list[Column]:
    return [natural_key(F.col("detector")), F.col("file"), F.col("line"), F.col("fingerprint")]


def first_findings(findings: DataFrame, limit: int | None) -> DataFrame:
    """The report's first rows; a limit is the feature here."""
    ordered = findings.orderBy(*report_order())
    return ordered if limit is None else ordered.limit(limit)


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def without_suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """A directive in ``directives(file, detector, line)`` covers its own line and the next."""
    both = directives.select("file", "detector", F.explode(F.array("line", F.col("line") + 1)).alias("line")).distinct()
    return findings.join(both, ["file", "detector", "line"], "left_anti")


def exit_code(findings: DataFrame, fail_on: str | None) -> int:
    """1 if a finding is at least as severe as ``fail_on``, else 0."""
    if fail_on is None:
        return 0
    return int(not select_findings(findings, fail_on).isEmpty())
