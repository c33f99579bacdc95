import random

import pytest

from graphloom.operators.closure import reach_from, strong_components, transaction_spans, transitive_closure
from graphloom.operators.components import connected_components
from graphloom.operators.diff import keyed_diff, set_difference
from graphloom.operators.predicates import compile_predicate, glob
from graphloom.storage import Stage
from pyspark.sql import functions as F


def bfs(edges, start, stop=(), depth=99):
    dist, todo = {start: 0}, [start]
    while todo:
        n = todo.pop(0)
        if dist[n] < depth and (n == start or n not in stop):
            for a, b in edges:
                if a == n and b not in dist:
                    dist[b] = dist[n] + 1
                    todo.append(b)
    return dist


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(34)]
    return edges, spark.createDataFrame([*edges, edges[0], (None, 3), (4, None)], "src long, dst long")


def test_closure_and_strong_components(spark, graph):
    edges, df = graph
    closure = transitive_closure(df, Stage(spark, "t"))
    want = {}
    for a, b in edges:
        for s in range(25):
            d = bfs(edges, s)
            if a in d:
                want[(s, b)] = min(want.get((s, b), 99), d[a] + 1)
    assert {(r[0], r[1]): r[2] for r in closure.collect()} == want
    got = {r["node"]: (r["component"], r["size"], r["recursive"]) for r in strong_components(df, spark.range(25).withColumnRenamed("id", "node"), Stage(spark, "t")).collect()}
    for n in range(25):
        own = {m for m in range(25) if (n, m) in want and (m, n) in want}
        assert got[n] == (min(own, default=n), max(1, len(own)), bool(own))


def test_reach_stops_and_depth(spark, graph):
    edges, df = graph
    stop = spark.createDataFrame([(3,), (7,)], "node long")
    got = reach_from(spark.createDataFrame([(0, 3), (1, 5)], "root long, node long"), df, Stage(spark, "t"), stop, 4)
    assert {(r[0], r[1]): r[2] for r in got.select("root", "node", "dist").collect()} == {(k, n): d for k, s in ((0, 3), (1, 5)) for n, d in bfs(edges, s, (3, 7), 4).items()}
    spans = transaction_spans(stop, df, Stage(spark, "t"))
    back = [(b, a) for a, b in edges]
    assert {(r[0], r[1]) for r in spans.select("seed", "member").collect()} == {(s, n) for s in (3, 7) for n in bfs(back, s, (3, 7), 50)}


def test_components(spark, graph):
    edges, df = graph
    got = {r[0]: r[1] for r in connected_components(df, Stage(spark, "t")).collect()}
    both = edges + [(b, a) for a, b in edges]
    assert got == {n: min(bfs(both, n)) for e in edges for n in e}


def test_predicates_follow_kleene(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    eq = {"all": [{"a": {"equals": True}}, {"not": {"b": {"equals": True}}}]}
    got = df.select(compile_predicate(eq, {"a": F.col("a"), "b": F.col("b")}).alias("x")).collect()
    for (a, b), r in zip(rows, got):
        want = False if a is False or b is True else None if a is None or b is None else True
        assert r["x"] is want
    names = spark.createDataFrame([("Sales.Post",), ("sales\npost",), (None,), ("SALESXPOST",)], "n string")
    assert [r[0] for r in names.select(glob(F.col("n"), "Sales?P*")).collect()] == [True, False, None, True]
    for bad in ({"zz": {"equals": 1}}, {"a": {"near": 1}}, {"a": {}, "b": {}}):
        with pytest.raises(ValueError):
            compile_predicate(bad, {"a": F.col("a"), "b": F.col("b")})


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "z", 1)], "id int, v string, w int")
    assert {tuple(r) for r in keyed_diff(a, b, ["id"], ["v", "w"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert {tuple(r) for r in set_difference(a, b, ["id"]).collect()} == {(3, "missing"), (4, "extra")}
    assert set_difference(a, a, ["id"]).isEmpty()
