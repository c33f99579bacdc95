"""Paths as answers: witnesses, bounded evidence walks and event chains.

A round of a walk extends the newest paths by one edge and keeps a bounded number
at each node of each root, so what a round holds grows with roots times nodes reached,
never with the number of paths.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import parts as P
from graphloom.storage import Stage


def shortest_paths(seeds: DataFrame, edges: DataFrame, stage: Stage, k: int = 3, max_depth: int = 64, name: str = "paths") -> DataFrame:
    """(root, node, dist, path, rank): up to ``k`` paths without a repeated node from each ``seeds(root, node)`` to each node.

    Shorter paths come first, equal ones in the order of their nodes. Every
    path leads through one of the ``k`` best to each node before.
    """
    ends = [*P.column_types(edges, "src", "dst"), *P.column_types(seeds, "node")]
    if not P.plain(*ends) or not P.plain(*P.column_types(seeds, "root")):
        return path_rounds(seeds, edges, stage, k, max_depth, name)
    parts = P.weak_parts(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"), stage, f"{name}-parts")
    (small, big), (seeds_small, seeds_big) = parts.split(parts.edges), parts.split(parts.place(seeds.select("root", "node"), "node"))
    tables = [small.select("part", F.col("src").alias("x"), F.col("dst").alias("y")), seeds_small.select("part", "root", F.col("node").alias("x"))]
    number = T.IntegerType()
    schema = T.StructType([T.StructField("root", seeds.schema["root"].dataType), T.StructField("node", ends[0]), T.StructField("dist", number), T.StructField("path", T.ArrayType(ends[0])), T.StructField("rank", number)])
    out = P.solve(parts, tables, partial(P.paths_work, k=k, max_depth=max_depth), schema)
    return out if big is None else out.unionByName(path_rounds(seeds_big, big, stage, k, max_depth, name))


def path_rounds(seeds: DataFrame, edges: DataFrame, stage: Stage, k: int = 3, max_depth: int = 64, name: str = "paths") -> DataFrame:
    """``shortest_paths`` by rounds over the cluster."""
    e = stage.table(f"{name}-edges", edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    order = W.partitionBy("root", "node").orderBy("path")
    seen = stage.table(f"{name}0", seeds.select("root", "node").distinct().select("root", "node", F.lit(0).alias("dist"), F.array("node").alias("path"), F.lit(1).alias("rank")))
    parts, delta = [seen], seen
    counts = seen.groupBy("root", "node").agg(F.count(F.lit(1)).alias("have"))
    for d in range(1, max_depth + 1):
        step = delta.join(e, delta["node"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node"), F.lit(d).alias("dist"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(counts, ["root", "node"], "left").withColumn("rank", F.row_number().over(order) + F.coalesce("have", F.lit(0))).where(F.col("rank") <= k).drop("have")
        delta = stage.table(f"{name}{d}", step.select("root", "node", "dist", "path", F.col("rank").cast("int").alias("rank")))
        if delta.isEmpty():
            break
        parts.append(delta)
        new = stage.table(f"{name}-have{d}", counts.unionByName(delta.groupBy("root", "node").agg(F.count(F.lit(1)).alias("have"))).groupBy("root", "node").agg(F.sum("have").alias("have")))
        if d > 1:
            stage.drop(f"{name}-have{d - 1}")
        counts = new
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def witnesses(paths: DataFrame, terminals: DataFrame, k: int = 3) -> DataFrame:
    """The best ``k`` paths of each (root, fact) over ``terminals(node, fact)``: fewest edges, then nodes in order."""
    w = W.partitionBy("root", "fact").orderBy("dist", "path")
    return paths.join(terminals.select("node", "fact").distinct(), "node").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("root", "fact", "place", "dist", "path")


def rank_witnesses(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first of each key under a fixed list of criteria."""
    return candidates.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def evidence_walk(seeds: DataFrame, edges: DataFrame, terminals: DataFrame, stage: Stage, max_depth: int = 64, expands: Column | None = None) -> DataFrame:
    """(root, path, stop): where each walk from ``seeds(root, node)`` ends.

    Complete at a terminal, Cycle at a node it has passed, Depth at the bound,
    DeadEnd where no edge (that ``expands``, over ``edges(src, dst, ...)``, allows) leads on.
    A root's walks are told apart by their last node and stop; of equal ones the first path stays.
    """
    e = edges if expands is None else edges.where(expands)
    e = stage.table("walk-edges", e.select("src", "dst").where("src is not null and dst is not null").distinct())
    t = terminals.select("node").distinct().withColumn("end", F.lit(True))
    cur = stage.table("walk0", seeds.select("root", "node", F.array("node").alias("path")))
    done = []
    for d in range(max_depth + 1):
        at = cur.join(t, "node", "left")
        done.append(at.where("end").select("root", "path", F.lit("Complete").alias("stop")))
        go = at.where("end is null").drop("end")
        if d == max_depth:
            done.append(go.select("root", "path", F.lit("Depth").alias("stop")))
            break
        step = go.join(e, go["node"] == e["src"], "left")
        done.append(step.where("dst is null").select("root", "path", F.lit("DeadEnd").alias("stop")))
        step = step.where("dst is not null")
        back = F.array_contains("path", F.col("dst"))
        done.append(step.where(back).select("root", F.concat("path", F.array("dst")).alias("path"), F.lit("Cycle").alias("stop")))
        nxt = step.where(~back).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        cur = stage.table(f"walk{d + 1}", nxt)
        if cur.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.groupBy("root", F.element_at("path", -1).alias("_last"), "stop").agg(F.min("path").alias("path")).select("root", "path", "stop")


def event_chains(publishers: DataFrame, flow: DataFrame, stage: Stage, max_depth: int = 16, max_nodes: int = 1024) -> DataFrame:
    """(root, event_id, depth, path, stop) of the chains from each publisher over ``flow(event_id, next_event_id)``.

    A step into an event on its own path is a cycle and is not extended, at
    ``max_depth`` a chain stops, and of a root's steps the first ``max_nodes`` (by
    depth, then path) stay: cycle over depth over nodes.
    """
    e = stage.table("chain-edges", flow.select("event_id", "next_event_id").where("next_event_id is not null").distinct())
    cur = stage.table("chain0", publishers.select(F.col("event_id").alias("root"), "event_id", F.lit(0).alias("depth"), F.array("event_id").alias("path"), F.lit(False).alias("cycle")).distinct())
    parts = [cur]
    for d in range(1, max_depth + 1):
        step = cur.where("not cycle").join(e, "event_id").select("root", F.col("next_event_id").alias("event_id"), F.lit(d).alias("depth"), F.array_contains("path", F.col("next_event_id")).alias("cycle"), F.concat("path", F.array("next_event_id")).alias("path"))
        kept = step.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("path"))).where(F.col("n") <= max_nodes).drop("n")
        cur = stage.table(f"chain{d}", kept.select("root", "event_id", "depth", "path", "cycle"))
        if cur.isEmpty():
            break
        parts.append(cur)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    leads = e.select("event_id").distinct().withColumn("leads", F.lit(True))
    n = F.row_number().over(W.partitionBy("root").orderBy("depth", "path"))
    stop = F.when(F.col("cycle"), "cycle").when((F.col("depth") == max_depth) & F.col("leads"), "depth").when(F.col("n") == max_nodes, "nodes").otherwise("none")
    return out.join(leads, "event_id", "left").withColumn("n", n).where(F.col("n") <= max_nodes).select("root", "event_id", "depth", "path", stop.alias("stop"))


def chain_report(chains: DataFrame) -> DataFrame:
    """Depth, steps, cycles and truncations of each root."""
    return chains.groupBy("root").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("stop") == "cycle").alias("cycles"), F.count_if(F.col("stop").isin("depth", "nodes")).alias("truncated"))


def gaps_in_cones(cones: DataFrame, gaps: DataFrame) -> DataFrame:
    """(root, gaps): gap subjects, each a routine or an application, among what each root reaches in ``cones(root, node, app_guid)``."""
    by_routine = cones.join(gaps.select(F.col("subject").alias("node")), "node").select("root", F.col("node").alias("subject"))
    by_app = cones.join(gaps.select(F.col("subject").alias("app_guid")), "app_guid").select("root", F.col("app_guid").alias("subject"))
    return by_routine.unionByName(by_app).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("gaps"))


def call_multiplicity(chains: DataFrame) -> Column:
    """many if any call of ``in_loop array<boolean>`` stands in a loop, else once."""
    return F.when(F.exists("in_loop", lambda x: F.coalesce(x, F.lit(False))), "many").otherwise("once")
