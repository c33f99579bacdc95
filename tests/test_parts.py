"""Weak components worked on in memory give what the rounds over the cluster give, and no pairs are written."""

import os
import random

import pytest

from graphloom.operators import capabilities as A
from graphloom.operators import closure as C
from graphloom.operators import parts as P
from graphloom.operators import walks as K
from graphloom.storage import Stage
from pyspark.sql import functions as F


def written(stage):
    root = stage.root.removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.fixture(scope="module")
def forest(spark):
    """Components of 1 to 9 nodes, with cycles, loops, repeated edges and null ends."""
    rng = random.Random(5)
    edges, at = [], 0
    for _ in range(40):
        n = rng.randrange(1, 10)
        edges += [(at + rng.randrange(n), at + rng.randrange(n)) for _ in range(n + rng.randrange(3))]
        at += n
    edges += [edges[0], (None, 3), (4, None)]
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.fixture(params=[4_000, 5], ids=["one task each", "some by rounds"])
def solo(request, monkeypatch):
    monkeypatch.setattr(P, "SOLO", request.param)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def calls(forest):
    site = F.concat_ws(">", "src", "dst")
    kind = F.when(F.col("src") % 3 == 0, "event-dispatch").when(F.col("src") % 3 == 1, "dynamic").otherwise("direct")
    return forest.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), kind.alias("kind"), site.alias("callsite_id"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_closures_are_those_of_the_rounds(spark, forest, solo, kind):
    e = forest.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    assert rows(C.transitive_closure(e, Stage(spark, "t")), "src", "dst", "dist") == rows(C.closure_rounds(e, Stage(spark, "t")), "src", "dst", "dist")
    assert rows(C.components_of(e, Stage(spark, "t")), "node", "component", "size") == rows(C.component_rounds(e, Stage(spark, "t")), "node", "component", "size")


def test_reach_is_that_of_the_rounds(spark, forest, solo):
    seeds = spark.createDataFrame([("a", 0), ("a", 50), ("b", 7), ("c", 5000), ("c", None), *((f"r{k}", k) for k in range(0, 160, 3))], "root string, node long")
    stop = spark.createDataFrame([(k,) for k in range(0, 160, 4)], "node long")
    for s, depth in ((None, None), (stop, 6)):
        got, want = (rows(f(seeds, forest, Stage(spark, "t"), s, depth), "root", F.coalesce("node", F.lit(-1)), "dist") for f in (C.reach_from, C.reach_rounds))
        assert got == want


def test_no_pairs_are_written(spark):
    """What is written is edges and nodes: before, each round wrote all pairs so far."""
    chains = spark.range(3_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("dst % 30 <> 0")
    stage = Stage(spark, "t")
    closure = C.transitive_closure(chains, stage)
    assert closure.count() == 100 * 30 * 29 // 2
    assert all(x.startswith("closure-parts-") for x in written(stage))
    assert sum(spark.read.parquet(stage.path(x)).count() for x in written(stage)) < 10_000


def test_cones_are_those_of_the_rounds(spark, calls, solo):
    """facts go to their callers in memory; before, each round wrote all that every routine had so far."""
    routines = spark.range(170).select(F.col("id").cast("string").alias("routine_id"))
    fact = F.expr("explode(array(named_struct('op', 'read', 'resource_id', 't' || id % 4), named_struct('op', 'commit', 'resource_id', null), named_struct('op', 'read', 'resource_id', 't' || id % 5)))")
    facts = spark.range(0, 180, 2).select("id", fact.alias("f")).select(F.col("id").cast("string").alias("routine_id"), "f.op", F.lit("table").alias("resource_kind"), "f.resource_id", F.lit("static").alias("confidence"))
    cover = routines.select("routine_id", F.when(F.col("routine_id") % 7 == 0, "partial").otherwise("complete").alias("status"), F.lit("parse").alias("reason"))
    stage, key = Stage(spark, "t"), ["op", "resource_kind", "resource_id", "confidence"]
    inherited, coverage = A.cones(routines, calls, facts, cover, stage)
    e = calls.select(F.col("from").alias("caller"), F.col("to").alias("callee")).where("caller is not null and callee is not null and caller <> callee").distinct()
    start = facts.join(routines, "routine_id", "left_semi").select("routine_id", *key, F.lit(0).alias("dist"), F.col("routine_id").alias("origin"))
    want = A._spread_rounds(start, e, key, Stage(spark, "t"), "w")
    shown = ["routine_id", "op", F.coalesce("resource_id", F.lit("")), "dist", "origin"]
    assert rows(inherited, *shown) == rows(want, *shown)
    digest = want.groupBy("routine_id", "op").agg(F.count(F.lit(1)), F.sum("dist"), F.coalesce(F.min("resource_id"), F.lit("")))
    assert rows(A.cone_digest(routines, calls, facts, stage), "routine_id", "op", "keys", "dists", F.coalesce("least", F.lit(""))) == rows(digest, *digest.columns)
    gaps = cover.where("status <> 'complete'").select("routine_id", "status", "reason", F.lit(0).alias("dist"), F.col("routine_id").alias("origin"))
    bad = {r[0] for r in A._spread_rounds(gaps, e, ["status", "reason"], Stage(spark, "t"), "g").collect()}
    assert {r[0] for r in coverage.where("coverage = 'partial'").collect()} == bad & {str(k) for k in range(170)}
    if P.SOLO > 100:
        assert all(n.startswith("cones-") for n in written(stage))


def test_effects_are_those_of_the_rounds(spark, calls, solo):
    """states go to their fixpoint in memory, with bindings of parameters; before, each round wrote all states so far."""
    temp = F.expr("case id % 4 when 0 then 'parameter' when 1 then 'known-true' when 2 then 'unknown' end")
    base = spark.range(0, 180, 2).select(F.col("id").cast("string").alias("routine_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("table_id"), F.lit("read").alias("op"), temp.alias("temp"), F.when(F.col("id") % 4 == 0, (F.col("id") % 3).cast("int")).alias("param"))
    bound = F.expr("case p when 0 then 'parameter' when 1 then 'known-true' end")
    bindings = calls.where("callsite_id like '%>%'").select("callsite_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).distinct().select("callsite_id", F.col("p").alias("position"), bound.alias("temp"), F.when(F.col("p") == 0, 1).alias("param"))
    stage, shown = Stage(spark, "t"), ["routine_id", "table_id", "op", F.coalesce("temp", F.lit("")), F.coalesce("param", F.lit(-1)), "via"]
    assert rows(A.propagate_effects(base, calls, bindings, stage), *shown) == rows(A._effect_rounds(base, calls, bindings, Stage(spark, "t")), *shown)
    if P.SOLO > 100:
        assert "effects0" not in written(stage)


def test_paths_are_those_of_the_rounds(spark, forest, solo):
    """the best paths are made in memory; before, each length was a round, with three shuffles."""
    seeds = spark.range(0, 170, 3).select(F.concat(F.lit("r"), F.col("id") % 20).alias("root"), F.col("id").alias("node"))
    stage, shown = Stage(spark, "t"), ["root", "node", "dist", "path", "rank"]
    assert rows(K.shortest_paths(seeds, forest, stage, 2, 5), *shown) == rows(K.path_rounds(seeds, forest, Stage(spark, "t"), 2, 5), *shown)
    if P.SOLO > 100:
        assert "paths1" not in written(stage)


def test_roles_are_those_of_the_rounds(spark, calls, solo):
    """F8: roles go to their fixpoint in memory; before, each round wrote all of them."""
    own = spark.range(170).select(F.col("id").cast("string").alias("routine_id"), F.lit(0).alias("position"), F.expr("array('no', 'no', 'unknown', 'yes')[int(id % 4)]").alias("loads"), F.expr("if(id % 9 = 0, 'yes', 'no')").alias("mutates"))
    passes = calls.select(F.col("from").alias("routine_id"), F.lit(0).alias("position"), F.when(F.col("from") != "12", F.col("to")).alias("callee"), F.when(F.col("from") % 8 == 0, 1).otherwise(0).alias("callee_position")).where("routine_id is not null")
    passes = passes.union(passes.where("callee_position = 0").select("routine_id", F.lit(2), "callee", F.lit(None)))
    stage, roles = Stage(spark, "t"), ["loads", "mutates"]
    for n in (1, 1000):
        assert rows(A.parameter_roles(own, passes, roles, stage, n), "routine_id", "position", *roles) == rows(A._role_rounds(own, passes, roles, Stage(spark, "t"), n), "routine_id", "position", *roles)
    if P.SOLO > 100:
        assert "roles1" not in written(stage)
