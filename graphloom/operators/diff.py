"""Versioned comparison of keyed relations, and findings gates (baseline, rollup, top rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed rows; a null equals a null."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")) for v in values])
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return a.join(b, keys, "full").select(*keys, kind.alias("change")).where("change is not null")


def set_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): what stands on one side only; empty when the sets are equal."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))
