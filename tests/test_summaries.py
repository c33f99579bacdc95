import json

from graphloom.operators import statements as T
from graphloom.operators import summaries as M
from graphloom.plans.analyze import analyze, counters
from graphloom.storage import Stage
from pyspark.sql import functions as F


def op(i, effect=None, var=None, record_op=None):
    return {"kind": "op", "op": i, "effect": effect, "var": var, "record_op": record_op}


TREES = {
    "a": [op("a1", "DB_MODIFY"), {"kind": "if", "then": [op("a2", "HTTP"), {"kind": "exit"}, op("a3", "HTTP")], "else": []}, op("a4", "COMMIT"), {"kind": "loop", "body": [op("a5", "FILE"), {"kind": "if", "then": [op("a6", "FILE")]}]}],
    "b": [{"kind": "case", "branches": [[op("b1", "COMMIT")], [{"kind": "error"}]], "else": [op("b2", "COMMIT")]}, op("b3", "HTTP")],
    "c": [{"kind": "if", "then": [{"kind": "error"}], "else": [{"kind": "error"}]}, op("c1", "HTTP")],
    "r": [op("r1", var="X", record_op="Modify"), {"kind": "if", "then": [op("r2", var="Y", record_op="Get")], "else": [op("r3", var="y", record_op="FindSet")]}, {"kind": "if", "then": [op("r4", var="Z", record_op="Get")]}, op("r5", var="Z", record_op="Validate"), {"kind": "loop", "body": [op("r6", var="W", record_op="Next"), op("r7", var="W", record_op="Validate")]}],
    "n": None,
}


def test_statement_trees(spark):
    trees = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in TREES.items()], "routine_id string, tree string")
    got = {r["op_id"]: r for r in T.ordered_operations(trees).collect()}
    assert [got[f"a{i}"]["order_id"] for i in range(1, 7)] == list(range(6))
    assert {k: v["context"] for k, v in got.items()} == {"a1": "always", "a2": "branch", "a3": "unreachable", "a4": "always", "a5": "loop", "a6": "loop-branch", "b1": "case", "b2": "case", "b3": "always", "c1": "unreachable", **{f"r{i}": x for i, x in ((1, "always"), (2, "branch"), (3, "branch"), (4, "branch"), (5, "always"), (6, "loop"), (7, "loop"))}}
    assert [got[k]["dominates_return"] for k in ("a1", "a2", "a4", "b3")] == [True, False, False, False] and got["a5"]["loop_depth"] == 1
    assert [tuple(f) for f in got["a2"]["frames"]] == [(1, "if-then", False)] and [f["kind"] for f in got["a6"]["frames"]] == ["loop", "if-then"] and not got["a3"]["on_success_path"]
    states = {(r["routine_id"], r["var"]): tuple(r)[2:] for r in T.record_states(trees).collect()}
    assert states == {("r", "x"): ("no", "no", "yes"), ("r", "y"): ("yes", "no", "no"), ("r", "z"): ("unknown", "yes", "unknown"), ("r", "w"): ("unknown", "unknown", "no")}
    b = {r["routine_id"]: tuple(r)[1:] for r in T.behaviours(trees).collect()}
    assert b == {"a": (True, False, True, False), "b": (True, False, True, True), "c": (False, True, False, False), "r": (True, False, False, False), "n": (True, False, False, False)}


def test_summaries(spark):
    df = spark.createDataFrame
    st = Stage(spark, "t")
    routines = df([("a", True, False), ("b", False, False), ("c", True, True), ("d", True, None)], "routine_id string, body_available boolean, parse_incomplete boolean")
    base = M.base_facts(routines, df([("d", "dynamic"), ("d", "dynamic")], "from string, kind string"))
    assert {r["routine_id"]: (r["unresolved"], r["reasons"]) for r in base.collect()} == {"a": (False, []), "b": (True, []), "c": (True, ["parse-incomplete"]), "d": (True, ["dynamic"])}
    edges = df([("a", "b"), ("x", "a"), ("a", "c"), ("y", "d")], "from string, to string")
    up = M.propagated_uncertainty(base, edges, st)
    assert {r["routine_id"]: (r["unresolved"], r["reasons"]) for r in up.collect()}["a"] == (True, ["parse-incomplete"])
    caps = df([("confirmed", ["x"]), ("likely", []), ("possible", ["x"])], "c string, u array<string>").select(M.capped_confidence(F.col("c"), F.col("u")))
    assert [r[0] for r in caps.collect()] == ["possible", "likely", "possible"]
    cyc = df([("1", "2"), ("2", "3"), ("3", "1"), ("2", "1")], "src string, dst string")
    assert {r["node"]: r["component"] for r in M.split_components(cyc, df([("3",)], "node string"), st).collect()} == {"1": "1", "2": "1"}
    assert {tuple(r) for r in M.seeded(df([("a", 1), ("b", 2)], "k string, v int"), df([("a", 9)], "k string, v int"), "k").collect()} == {("a", 9), ("b", 2)}
    ee = df([("e1", "p", "s1", "resolved"), ("e2", "q", "s2", "resolved"), ("e1", "p", "s9", "maybe")], "event_id string, publisher_routine_id string, subscriber_routine_id string, resolution string")
    ts = M.transitive_subscribers(df([("e1",)], "event_id string"), ee, df([("s1", "q")], "from string, to string"), st)
    assert {(r["routine_id"], r["dist"]) for r in ts.collect()} == {("s1", 0), ("q", 1), ("s2", 2)}
    gaps = M.unresolved_in_reach(df([("x",)], "routine_id string"), edges, df([("c", "k1", True), ("d", "k2", False)], "routine_id string, callsite_id string, open_world boolean"), st)
    assert [tuple(r) for r in gaps.collect()] == [("x", "k1", 2, True)]
    loops = M.loops_reaching(df([("l1", "a"), ("l2", "a"), ("l3", "d"), ("l1", "c")], "loop_id string, to string"), edges, df([("c",), ("b",), ("z",)], "routine_id string"), st)
    got = {r["routine_id"]: (r["loops"], r["set_id"]) for r in loops.collect()}
    assert {k: v[0] for k, v in got.items()} == {"b": ["l1", "l2"], "c": ["l1", "l2"]} and got["b"][1] == got["c"][1]
    keys, sets = M.interned_sets(df([("k1", "x"), ("k1", "y"), ("k2", "y"), ("k2", "x"), ("k3", "x")], "k string, i string"), "k", "i")
    assert sets.count() == 2 and keys.select("set_id").distinct().count() == 2
    comp = df([("1", "1"), ("2", "1")], "node string, component string")
    u = M.component_unions(df([("2", "i"), ("5", "j")], "node string, item string"), comp, df([("0", "1"), ("1", "5")], "src string, dst string"), st)
    assert {tuple(r) for r in u.collect()} == {("1", "i"), ("0", "i"), ("5", "j"), ("1", "j"), ("0", "j")}
    co = M.cohorts(df([("k", ["a", "c"]), ("k", ["a", "b"]), ("k", ["a"] * 3)], "cohort string, path array<string>")).first()
    assert (co["path"], co["paths"]) == (["a", "b"], 3)
    t = df([("parameter", [("parameter",), ("known-true",)]), ("parameter", [(None,)]), ("known-false", [("known-true",)])], "s string, b array<struct<temp:string>>").select(M.temp_along(F.col("b"), F.col("s")).alias("t"))
    assert [r["t"] for r in t.collect()] == ["known-true", "unknown", "known-false"] and [r[0] for r in t.select(M.terminal_verdict(F.col("t"), F.lit(False))).collect()] == ["Temporary", "Uncertain", "Physical"]
    live = M.live_parameters(df([("c", 1)], "routine_id string, position int"), df([("b", 0, "c", 1), ("a", 2, "b", 0), ("a", 0, "c", 0), ("a", 3, None, None)], "routine_id string, position int, callee string, callee_position int"), st)
    assert {tuple(r) for r in live.collect()} == {("c", 1), ("b", 0), ("a", 2)}
    assert {r["v"]: r["id"] for r in M.dense_ids(df([(x,) for x in "cabbage"], "v string"), "v").collect()} == {"a": 0, "b": 1, "c": 2, "e": 3, "g": 4}
    assert {r["chain_id"]: r["unconditional"] for r in M.must_commit(df([("1", [True, True]), ("2", [True, None])], "chain_id string, steps array<boolean>")).collect()} == {"1": True, "2": False}
    g = M.publisher_guards(df([("p", "IsHandled", True), ("q", "IsHandled", True), ("r", "IsHandled", True), ("p", "X", True)], "routine_id string, name string, is_var boolean"), df([("q", "ishandled")], "routine_id string, variable string"), df([("q",), ("r",)], "routine_id string"), F.lower("name") == "ishandled")
    assert {r["routine_id"]: r["confidence"] for r in g.collect()} == {"p": "exact", "q": "pattern", "r": "unknown"}
    row = M.composite(routines, df([("a", "t", "modify", "unknown", "direct")], "routine_id string, table_id string, op string, temp string, via string"), up, df([("a", 0, "yes")], "routine_id string, position int, loads string"), df([("b",)], "node string")).where("routine_id = 'a'").first()
    assert len(row["effects"]) == 1 and row["roles"][0]["loads"] == "yes" and not row["recursive"]


def test_analyze(spark):
    df = spark.createDataFrame
    facts = {
        "statements": df([("s1", "r", "b", 1, "exit"), ("s2", "r", "b", 2, "call"), ("s3", "q", "b", 1, "error"), ("s4", "q", "b", 2, "call"), ("s5", "d", "b", 1, "exit"), ("s6", "d", "b", 2, "call")], "statement_id string, routine_id string, block_id string, place int, kind string"),
        "routines": df([("r", "R", "o", "app", False), ("q", "Q", "o", "app", False), ("d", "D", "o2", "dep", True)], "routine_id string, name string, object_id string, app_guid string, is_dependency boolean"),
    }
    places = df([("s2", "a.al", 4, 0), ("s4", "a.al", 9, 2), ("d", "d.al", 0, 0)], "id string, file string, line int, column int")
    run = lambda **kw: analyze(facts, places, ["d20-unreachable-after-exit"], **kw)
    all_ = run(scope="all", fail_on="low")
    assert {(r["routine_id"], r["file"], r["line"], r["column"]) for r in all_.findings.collect()} == {("r", "a.al", 5, 1), ("q", "a.al", 10, 3), ("d", "d.al", 1, 1)} and all_.exit_code == 1
    own = run(limit=1, fail_on="high")
    assert [r["routine_id"] for r in own.findings.collect()] == ["r"] and own.exit_code == 0
    kept = run(baseline=own.before_baseline, directives=df([("a.al", "d20-unreachable-after-exit", 9)], "file string, detector string, line int"))
    assert kept.findings.count() == 0 and run(baseline=own.before_baseline).findings.count() == 1
    c = counters(all_.before_baseline, own.findings, ["d20-unreachable-after-exit", "d1-db-op-in-loop"])
    assert {r["detector"]: (r["candidates"], r["emitted"]) for r in c.collect()} == {"d20-unreachable-after-exit": (3, 1), "d1-db-op-in-loop": (0, 0)}
