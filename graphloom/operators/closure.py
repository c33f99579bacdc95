"""Reachability over ``edges(src, dst)``: all pairs, or from seeds.

Edges and seeds are plain DataFrames of any orderable id type; nothing here
knows what they stand for. Null ends are ignored. Weak components of some thousand
edges are worked on in memory, many to a task (``parts``). Of larger ones, and of ids that are neither whole
numbers nor texts, every round is written to the shared folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import parts as P
from graphloom.storage import Stage


def _known(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null")


def _in_parts(edges: DataFrame) -> DataFrame:
    return edges.select("part", F.col("src").alias("x"), F.col("dst").alias("y"))


def transitive_closure(edges: DataFrame, stage: Stage, name: str = "closure", max_rounds: int = 40) -> DataFrame:
    """(src, dst, dist) of every pair joined by a path of one edge or more, with the fewest edges.

    Pairs of components that one task takes are made as they are read, and not written.
    """
    if not P.plain(*P.column_types(edges, "src", "dst")):
        return closure_rounds(edges, stage, name, max_rounds)
    parts = P.weak_parts(_known(edges), stage, f"{name}-parts")
    small, big = parts.split(parts.edges)
    one = edges.schema["src"].dataType
    out = P.solve(parts, [_in_parts(small)], P.closure_work, T.StructType([T.StructField("src", one), T.StructField("dst", one), T.StructField("dist", T.IntegerType())]))
    return out if big is None else out.unionByName(closure_rounds(big, stage, name, max_rounds))


def closure_rounds(edges: DataFrame, stage: Stage, name: str = "closure", max_rounds: int = 40) -> DataFrame:
    """``transitive_closure`` by rounds over the cluster.

    Each round joins paths with paths, so the rounds are the logarithm of the longest shortest path.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    cur, size = stage.table(f"{name}0", e.withColumn("dist", F.lit(1))), -1
    for k in range(1, max_rounds + 1):
        a, b = cur.alias("a"), cur.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.dist") + F.col("b.dist")).alias("dist"))
        new = stage.table(f"{name}{k}", cur.union(longer).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
        stage.drop(f"{name}{k - 1}")
        cur = new
        now = cur.agg(F.count(F.lit(1)), F.sum("dist")).first()
        if now == size:
            return cur
        size = now
    raise RuntimeError("closure did not settle")


#: Steps that one round of a reach takes before it is written.
HOPS = 4


def reach_from(seeds: DataFrame, edges: DataFrame, stage: Stage, stop: DataFrame | None = None, max_depth: int | None = None, name: str = "reach") -> DataFrame:
    """(root, node, dist): what each ``seeds(root, node)`` reaches, itself at 0.

    Nodes of ``stop(node)`` are reached but not passed, except as seeds.
    """
    ends = [*P.column_types(edges, "src", "dst"), *P.column_types(seeds, "node"), *(P.column_types(stop, "node") if stop is not None else [])]
    if not P.plain(*ends) or not P.plain(*P.column_types(seeds, "root")):
        return reach_rounds(seeds, edges, stage, stop, max_depth, name)
    parts = P.weak_parts(_known(edges), stage, f"{name}-parts")
    at = parts.place(seeds.select("root", "node"), "node")
    small, big = parts.split(parts.edges)
    seeds_small, seeds_big = parts.split(at)
    tables = [_in_parts(small), seeds_small.select("part", "root", F.col("node").alias("x"))]
    if stop is not None:
        tables.append(parts.split(parts.place(stop.select("node").where("node is not null").distinct(), "node"))[0].select("part", F.col("node").alias("x")))
    one, root = ends[0], seeds.schema["root"].dataType
    schema = T.StructType([T.StructField("root", root), T.StructField("node", one), T.StructField("dist", T.IntegerType())])
    out = P.solve(parts, tables, partial(P.reach_work, max_depth=max_depth, stopped=stop is not None), schema)
    return out if big is None else out.unionByName(reach_rounds(seeds_big, big, stage, stop, max_depth, name))


def reach_rounds(seeds: DataFrame, edges: DataFrame, stage: Stage, stop: DataFrame | None = None, max_depth: int | None = None, name: str = "reach") -> DataFrame:
    """``reach_from`` by rounds over the cluster. A round
    takes the pairs that are farthest HOPS steps on, drops known pairs, and is written.
    """
    e = stage.table(f"{name}-edges", edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if stop is not None:  # edges out of stops are passed only in the first step
        onward = stage.table(f"{name}-onward", e.join(stop.select(F.col("node").alias("src")).distinct(), "src", "left_anti"))
    else:
        onward = e
    seen = stage.table(f"{name}0", seeds.select("root", "node").distinct().withColumn("dist", F.lit(0)))
    delta, depth, k = seen, 0, 0
    while max_depth is None or depth < max_depth:
        k += 1
        found, go = None, delta.where(F.col("dist") == depth)
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        for h in range(1, hops + 1):
            by = e if depth + h == 1 else onward
            go = go.join(by, go["node"] == by["src"]).select("root", F.col("dst").alias("node"), F.lit(depth + h).alias("dist")).distinct()
            found = go if found is None else found.unionByName(go)
        best = found.groupBy("root", "node").agg(F.min("dist").alias("dist"))
        delta = stage.table(f"{name}{k}", best.join(seen, ["root", "node"], "left_anti"))
        depth += hops
        seen = seen.unionByName(delta)
        if delta.where(F.col("dist") == depth).isEmpty():
            break
    return seen


def reach_summary(edges: DataFrame, facts: DataFrame, weights: list[str], stage: Stage, roots: DataFrame | None = None, proper: bool = False, name: str = "summary") -> DataFrame:
    """(root, keys, weights..., nearest) of the ``facts(node, key, weights...)`` that each root reaches, itself at 0: distinct keys, sums, least distance.

    Roots are all nodes, or those of ``roots(node)``; ``proper`` counts only what a path of one edge or more
    leads to. Roots that reach no fact are left out. Facts are never joined with pairs outside a task.
    """
    facts = facts.select("node", "key", *(F.col(w).cast("long").alias(w) for w in weights)).where("node is not null")
    ends = [*P.column_types(edges, "src", "dst"), *P.column_types(facts, "node"), *(P.column_types(roots, "node") if roots is not None else [])]
    if not P.plain(*ends) or not P.plain(*P.column_types(facts, "key")):
        return _summary_rounds(_known(edges), facts, weights, stage, roots, proper, name)
    parts = P.weak_parts(_known(edges), stage, f"{name}-parts", facts)
    (small, big), (facts_small, facts_big) = parts.split(parts.edges), parts.split(parts.place(facts, "node"))
    tables, roots_big = [_in_parts(small), facts_small.withColumnRenamed("node", "x")], None
    if roots is not None:
        roots_small, roots_big = parts.split(parts.place(roots.select("node").distinct(), "node"))
        tables.append(roots_small.select("part", F.col("node").alias("x")))
    schema = T.StructType([T.StructField("root", ends[0]), *(T.StructField(c, T.LongType()) for c in ("keys", *weights)), T.StructField("nearest", T.IntegerType())])
    out = P.solve(parts, tables, partial(P.summary_work, weights=weights, proper=proper, roots=roots is not None), schema)
    return out if big is None else out.unionByName(_summary_rounds(big, facts_big, weights, stage, roots_big, proper, name))


def _summary_rounds(edges: DataFrame, facts: DataFrame, weights: list[str], stage: Stage, roots: DataFrame | None, proper: bool, name: str) -> DataFrame:
    """``reach_summary`` by rounds over the cluster."""
    pairs = closure_rounds(edges, stage, name)
    if not proper:
        own = facts.select(F.col("node").alias("src")).distinct()
        pairs = pairs.where("src <> dst").unionByName(own.select("src", F.col("src").alias("dst"), F.lit(0).alias("dist")))
    if roots is not None:
        pairs = pairs.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    j = pairs.join(facts.withColumnRenamed("node", "dst"), "dst")
    return j.groupBy(F.col("src").alias("root")).agg(F.count_distinct("key").alias("keys"), *(F.sum(w).alias(w) for w in weights), F.min("dist").alias("nearest"))


def components_of(edges: DataFrame, stage: Stage, name: str = "scc", max_rounds: int = 200) -> DataFrame:
    """(node, component, size) of the strong components of two nodes or more, named by their least node."""
    if not P.plain(*P.column_types(edges, "src", "dst")):
        return component_rounds(edges, stage, name, max_rounds)
    parts = P.weak_parts(_known(edges).where("src <> dst"), stage, f"{name}-parts")
    small, big = parts.split(parts.edges)
    one = edges.schema["src"].dataType
    out = P.solve(parts, [_in_parts(small)], P.components_work, T.StructType([T.StructField("node", one), T.StructField("component", one), T.StructField("size", T.LongType())]))
    return out if big is None else out.unionByName(component_rounds(big, stage, name, max_rounds))


def component_rounds(edges: DataFrame, stage: Stage, name: str = "scc", max_rounds: int = 200) -> DataFrame:
    """``components_of`` by rounds over the cluster; no pair of nodes is made.

    Nodes without a way in or out are trimmed off until none is left. Of the rest each takes
    the least node that reaches it; those that reach their least node back are a component, which
    leaves the graph.
    """
    cur = stage.table(f"{name}-e", edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    parts = []
    for k in range(max_rounds):
        size = -1
        t = 0
        while True:
            now = cur.count()
            if now == size or now == 0:
                break
            size, t = now, t + 1
            ways_in, ways_out = cur.select(F.col("dst").alias("src")).distinct(), cur.select(F.col("src").alias("dst")).distinct()
            cur = stage.table(f"{name}-e{k}-{t}", cur.join(ways_in, "src", "left_semi").join(ways_out, "dst", "left_semi").select("src", "dst"))
        if cur.count() == 0:
            break
        nodes = cur.select(F.col("src").alias("node")).union(cur.select(F.col("dst").alias("node"))).distinct()
        color = stage.table(f"{name}-c{k}", nodes.withColumn("color", F.col("node")))
        total, r = None, 0
        while True:
            r += 1
            step = color
            for _ in range(2):
                sent = step.join(cur, step["node"] == cur["src"]).select(F.col("dst").alias("node"), "color")
                step = step.unionByName(sent).groupBy("node").agg(F.min("color").alias("color"))
            new = stage.table(f"{name}-c{k}-{r}", step)
            mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()
            stage.drop(f"{name}-c{k}" if r == 1 else f"{name}-c{k}-{r - 1}")
            color = new
            if mark == total:
                break
            total = mark
        inside = cur.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b")
        roots = color.where("node = color").select(F.col("color").alias("root"), "node")
        got = reach_rounds(roots, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), stage, name=f"{name}-b{k}")
        found = stage.table(f"{name}-f{k}", got.select("node", F.col("root").alias("component")).distinct())
        parts.append(found)
        cur = stage.table(f"{name}-n{k}", cur.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if not parts:
        return cur.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return out.join(sizes, "component").select("node", "component", "size")


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst) between components; a node without one is its own."""
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("a")), components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()


def strong_components(edges: DataFrame, nodes: DataFrame, stage: Stage) -> DataFrame:
    """(node, component, size, recursive) of every node; a node that calls itself is recursive, too."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("own", F.lit(True))
    found = nodes.select("node").distinct().join(components_of(edges, stage), "node", "left").join(loops, "node", "left")
    return found.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), (F.col("size").isNotNull() | F.coalesce("own", F.lit(False))).alias("recursive"))


def transaction_spans(commits: DataFrame, calls: DataFrame, stage: Stage, max_depth: int = 50) -> DataFrame:
    """(seed, member, dist): callers that run inside the transaction a committing routine ends.

    Reverse reach from each ``commits(node)``; another committing routine belongs to the span but ends it.
    """
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = commits.select(F.col("node").alias("root"), "node")
    return reach_from(seeds, back, stage, commits, max_depth, "span").select(F.col("root").alias("seed"), F.col("node").alias("member"), "dist")
