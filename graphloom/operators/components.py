"""Connected components by alternating star contractions (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Relinks every node's neighbours to the least of them and itself.

    The minimum is a pre-aggregated group-by and the relinking a join, so a
    hub's neighbours are never gathered in one row.
    """
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    joined = both.join(least, "src")
    if large:
        out = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
            least.select("src", F.col("m").alias("dst"))
        )
    return out.where(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame, stage: Stage, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` of one ordered type -> ``(node, component)``, component = least node id reached.

    Nodes that stand in no edge do not appear. Null ends are ignored, loops and
    repeated edges change nothing, an empty input gives an empty result. Each
    round writes its edges to the shared folder, so lineage stays short; rounds
    grow with the logarithm of the longest path.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    cur = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    mirror = cur.where("src = dst")
    loops = stage.table(f"{name}_loops", mirror.select(F.col("src").alias("node"), F.col("src").alias("component")))
    cur = stage.table(f"{name}_0", cur.where("src <> dst"))
    before = None
    for k in range(1, max_rounds + 1):
        new = stage.table(f"{name}_{k}", _star(_star(cur, True), False))
        row = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        stage.drop(f"{name}_{k - 1}")
        cur = new
        if tuple(row) == before:
            break
        before = tuple(row)
    found = cur.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component")
    return found.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
