import pytest

from graphloom.operators import capabilities as C
from graphloom.operators import ordering as O
from graphloom.operators.closure import components_of, condensation
from graphloom.storage import Stage
from pyspark.sql import functions as F

CALLS = "callsite_id string, routine_id string, shape string, receiver string, receiver_type string, method string, target_kind string, target string, args array<struct<kind:string,text:string,name:string>>"


def test_direct_facts(spark):
    df = spark.createDataFrame
    lit, par = ("literal", "'x'", None), ("parameter", "P", "P")
    calls = df(
        [
            ("c1", "r", "object-run", None, None, None, "Page", "21", []), ("c2", "r", "member", "TaskScheduler", None, "CreateTask", None, None, [par]), ("c3", "r", "member", "Client", "HttpClient", "Post", None, None, [lit]),
            ("c4", "r", "bare", None, None, "LogMessage", None, None, [lit]), ("c5", "r", "member", "IsolatedStorage", None, "Set", None, None, [lit, lit, ("enum", "DataScope::Company", None)]), ("c6", "r", "bare", None, None, "Confirm", None, None, [lit]),
            ("c7", "r", "bare", None, None, "StrMenu", None, None, []), ("c8", "r", "member", "P", "Page Card", "RunModal", None, None, []), ("c9", "r", "bare", None, None, "Hyperlink", None, None, [par]), ("c10", "r", "member", "B", "Codeunit TempBlob", "CreateOutStream", None, None, []),
            ("c11", "r", "bare", None, None, "Other", None, None, []), ("c12", "r", "object-run", None, None, None, "Codeunit", None, []),
        ],
        CALLS,
    )
    ops = df([("o1", "r", "Modify", "t1", ("known", True)), ("o2", "r", "FindSet", "unknown", None), ("o3", "r", "SetRange", "t1", None)], "operation_id string, routine_id string, op string, table_id string, temp struct<kind:string,value:boolean>")
    sites = df([("o9", "r", "commit"), ("o8", "r", "error-call"), ("o7", "r", "exit")], "operation_id string, routine_id string, kind string")
    ev = df([("s", "e1")], "routine_id string, event_id string")
    got = {(r["op"], r["resource_kind"], r["resource_id"], r["confidence"], r["detail"]) for r in C.direct_facts(ops, sites, calls, ev, ev).collect()}
    assert got == {
        ("modify", "table", "t1", "static", "known"), ("read", "table", None, "unresolved", None), ("commit", "transaction", None, "static", None), ("error-throw", "error", None, "static", None),
        ("execute", "object", "page:21", "static", "page"), ("execute", "object", "codeunit", "unresolved", "codeunit"), ("start", "background", None, "userDynamic", None), ("send", "http", None, "static", "POST"), ("log", "telemetry", None, "static", None),
        ("store-write", "isolated-storage", None, "static", "Company"), ("ui-confirm", "ui", None, "static", None), ("ui-window-open", "ui", None, "static", None), ("hyperlink", "http", None, "userDynamic", None), ("write-blob", "file", None, "static", None),
        ("subscribe", "event", "e1", "static", None), ("publish", "event", "e1", "static", None),
    }
    one = df([("findset", "Modify", "send"), ("GET", "LockTable", "read"), ("x", "Validate", "commit")], "m string, o string, f string").select(C.record_op(F.col("m")), C.op_class(F.col("o")), C.effect_type(F.col("f")))
    assert [tuple(r) for r in one.collect()] == [("FindSet", "db-write", "HTTP"), ("Get", "db-lock", None), (None, "trigger", "COMMIT")]
    masks = df([("r", "read"), ("r", "delete"), ("r", "commit")], "r string, op string").groupBy("r").agg(F.bit_or(C.access_mask(F.col("op"))).alias("m")).select(C.mask_accesses(F.col("m")))
    assert masks.first()[0] == ["delete", "read"]
    ways = df([("HTTP", "put", ""), ("HTTP", "HEAD", ""), ("FILE", "", "write-blob"), ("FILE", "", "open")], "k string, m string, f string").select(C.io_direction(F.col("k"), F.col("m"), F.col("f")))
    assert [r[0] for r in ways.collect()] == ["write", "read", "write", "unknown"]
    assert df([(("known", True),), (("known", False),), (("parameter", None),), (None,)], "t struct<kind:string,value:boolean>").where(C.known_temporary(F.col("t"))).count() == 1


@pytest.fixture(scope="module")
def calls(spark):
    # a -> b -> c -> b (a cycle), a -> d, e -> a
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("e", "a")], "from string, to string")


def test_cones(spark, calls):
    df = spark.createDataFrame
    routines = df([(x,) for x in "abcdef"], "routine_id string")
    fact = "routine_id string, op string, resource_kind string, resource_id string, confidence string"
    facts = df([("c", "modify", "table", "t1", "static"), ("d", "modify", "table", "t1", "static"), ("c", "commit", "transaction", None, "static"), ("a", "read", "table", "t2", "static")], fact)
    cover = df([("a", "complete", None), ("b", "complete", None), ("c", "partial", "parse"), ("d", "complete", None), ("e", "complete", None)], "routine_id string, status string, reason string")
    inherited, coverage = C.cones(routines, calls, facts, cover, Stage(spark, "t"))
    got = {(r["routine_id"], r["op"], r["resource_id"]): (r["dist"], r["origin"]) for r in inherited.collect()}
    assert got == {
        ("c", "modify", "t1"): (0, "c"), ("b", "modify", "t1"): (1, "c"), ("a", "modify", "t1"): (1, "d"), ("e", "modify", "t1"): (2, "d"), ("d", "modify", "t1"): (0, "d"),
        ("c", "commit", None): (0, "c"), ("b", "commit", None): (1, "c"), ("a", "commit", None): (2, "c"), ("e", "commit", None): (3, "c"), ("a", "read", "t2"): (0, "a"), ("e", "read", "t2"): (1, "a"),
    }
    assert {r["routine_id"]: (r["coverage"], r["reasons"]) for r in coverage.collect()} == {"a": ("partial", ["parse"]), "b": ("partial", ["parse"]), "c": ("partial", ["parse"]), "d": ("complete", []), "e": ("partial", ["parse"]), "f": ("unknown", ["no-summary"])}
    f = {r["routine_id"]: r for r in C.folded_facts(inherited).collect()}
    assert f["e"]["tables_written"] == ["t1"] and f["e"]["may_commit"] and not f["d"]["may_commit"] and [tuple(x) for x in f["e"]["tables"]] == [("t1", 4), ("t2", 1)]


def test_effects_follow_bindings(spark):
    df = spark.createDataFrame
    base = df([("leaf", "t1", "modify", "parameter", 0), ("leaf", "t2", "read", "known-true", None), ("top", "t2", "read", "known-true", None)], "routine_id string, table_id string, op string, temp string, param int")
    edges = df([("mid", "leaf", "direct", "c1"), ("top", "mid", "method", "c2"), ("dyn", "leaf", "dynamic", "c3"), ("sub", "top", "event-dispatch", "c4"), ("top", "top", "direct", "c5")], "from string, to string, kind string, callsite_id string")
    bind = df([("c1", 0, "parameter", 1), ("c2", 1, "known-true", None), ("c3", 0, "known-true", None)], "callsite_id string, position int, temp string, param int")
    got = {(r["routine_id"], r["table_id"], r["temp"], r["param"]): r["via"] for r in C.propagate_effects(base, edges, bind, Stage(spark, "t")).collect()}
    assert got == {
        ("leaf", "t1", "parameter", 0): "direct", ("leaf", "t2", "known-true", None): "direct", ("mid", "t1", "parameter", 1): "inherited", ("mid", "t2", "known-true", None): "inherited",
        ("top", "t1", "known-true", None): "inherited", ("top", "t2", "known-true", None): "direct", ("dyn", "t1", "unknown", None): "dynamic", ("dyn", "t2", "known-true", None): "dynamic",
        ("sub", "t1", "known-true", None): "event-subscriber", ("sub", "t2", "known-true", None): "event-subscriber",
    }


def test_roles_and_temporaries(spark):
    df = spark.createDataFrame
    own = df([("a", 0, "no", "no"), ("b", 0, "no", "yes"), ("c", 0, "yes", "no"), ("d", 0, "no", "no")], "routine_id string, position int, loads string, mutates string")
    passes = df([("a", 0, "b", 0), ("b", 0, "c", 0), ("c", 0, "b", 0), ("d", 0, None, None)], "routine_id string, position int, callee string, callee_position int")
    got = {r["routine_id"]: (r["loads"], r["mutates"]) for r in C.parameter_roles(own, passes, ["loads", "mutates"], Stage(spark, "t")).collect()}
    assert got == {"a": ("yes", "yes"), "b": ("yes", "yes"), "c": ("yes", "yes"), "d": ("unknown", "unknown")}
    params = df([(r, 0, "o", r, "local" if r != "pub" else None) for r in ("p1", "p2", "p3", "p4", "p5", "pub", "loop1", "loop2")], "routine_id string, position int, object_id string, name string, access string")
    args = df([("p1", 0, "direct", "known-true", "x", None), ("p2", 0, "method", "parameter", "p1", 0), ("p3", 0, "direct", "known-true", "x", None), ("p3", 0, "implicit-trigger", "known-true", "x", None), ("pub", 0, "direct", "known-true", "x", None), ("p5", 0, "direct", "known-true", "x", None), ("loop1", 0, "direct", "parameter", "loop2", 0), ("loop2", 0, "direct", "parameter", "loop1", 0)], "routine_id string, position int, kind string, temp string, caller string, caller_position int")
    got = {r["routine_id"] for r in C.proven_temporary(params, args, df([("o", "p5")], "object_id string, name string"), Stage(spark, "t")).collect()}
    assert got == {"p1", "p2"}


def test_roots_and_dead(spark):
    df = spark.createDataFrame
    routines = df(
        [("t1", "tab", "trigger", None, [], True, False), ("s1", "cu", "event-subscriber", None, [], True, False), ("p1", "cu", "procedure", None, [], True, False), ("l1", "cu", "procedure", "local", [], True, False), ("l2", "cu", "procedure", "local", [], True, False), ("i1", "cu", "procedure", "internal", [], True, False), ("u1", "up", "procedure", "local", ["Test"], True, False), ("dep", "cu", "procedure", "local", [], True, True), ("lp", "pg", "procedure", "local", [], True, False)],
        "routine_id string, object_id string, kind string, access string, attributes array<string>, body_available boolean, is_dependency boolean",
    )
    objects = df([("tab", "Table", None, None), ("cu", "Codeunit", None, None), ("up", "Codeunit", "Upgrade", None), ("pg", "Page", None, "API")], "object_id string, kind string, subtype string, page_type string")
    got = {r["routine_id"]: (r["kinds"], r["source"]) for r in C.root_kinds(routines, objects, df([("l1", "job-queue"), ("t1", "job-queue")], "routine_id string, kind string")).collect()}
    assert got == {"t1": (["job-queue", "trigger-table"], "ast+config"), "s1": (["event-subscriber"], "ast"), "p1": (["public-procedure"], "ast"), "u1": (["test-procedure", "upgrade-codeunit"], "ast"), "lp": (["api-page"], "ast"), "l1": (["job-queue"], "config")}
    edges = df([("p1", "l1")], "from string, to string")
    assert {r["routine_id"] for r in C.dead_routines(routines, objects, edges, Stage(spark, "t"), False).collect()} == {"l2", "i1", "u1"}
    assert {r["routine_id"] for r in C.reachable_roots(routines, True).collect()} == {"t1", "s1", "p1", "i1"}


def test_components_without_closure(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 8), (9, 1), (10, 10), (11, 12), (12, 11)]
    df = spark.createDataFrame(edges, "src long, dst long")
    comp = components_of(df, Stage(spark, "t"))
    assert {r["node"]: (r["component"], r["size"]) for r in comp.collect()} == {**{n: (1, 3) for n in (1, 2, 3)}, **{n: (4, 3) for n in (4, 5, 6)}, 11: (11, 2), 12: (11, 2)}
    assert {tuple(r) for r in condensation(df, comp).collect()} == {(1, 4), (4, 7), (7, 8), (9, 1)}
    assert components_of(df.where("src > 6 and src < 10"), Stage(spark, "t")).count() == 0


FRAME = "array<struct<id:int,kind:string,falls_through:boolean>>"


def test_order(spark):
    f = lambda *x: [(i, k, t) for i, k, t in x]
    top, then_, else_, loop, leave = f(), f((1, "if-then", True)), f((2, "if-else", True)), f((3, "loop", None)), f((4, "if-then", False))
    rows = [
        ("w0", "DB_MODIFY", 0, top, True, False, False), ("io", "HTTP", 1, top, True, False, False), ("wt", "DB_INSERT", 2, then_, True, False, False), ("ie", "FILE", 3, else_, True, False, False), ("c", "COMMIT", 4, top, True, True, False),
        ("i2", "HTTP", 5, top, True, False, False), ("tmp", "DB_INSERT", 6, top, True, False, True), ("ui", "UI_WINDOW_OPEN", 7, top, True, False, False), ("wl", "DB_DELETE", 8, loop, True, False, False), ("il", "HTTP", 9, loop, True, False, False), ("x", "HTTP", None, None, None, None, False),
    ]
    ops = spark.createDataFrame([("r", *r) for r in rows] + [("q", "lw", "DB_MODIFY", 0, leave, True, False, False), ("q", "li", "HTTP", 1, top, True, False, False)], f"routine_id string, op_id string, effect string, order_id int, frames {FRAME}, on_success_path boolean, dominates_return boolean, temporary boolean")
    got = {(r["op_id"], r["label"]): r["other_op_id"] for r in O.ordering_labels(ops).collect() if r["label"] != "COMMIT_REACHABLE"}
    assert got == {
        ("x", "ORDERING_UNKNOWN"): None, ("c", "COMMIT_ON_SUCCESS_PATH"): None, ("c", "COMMIT_DOMINATES_RETURN"): None, ("w0", "WRITE_COMMITTED_BEFORE_RETURN"): "c",
        ("io", "WRITE_PENDING_AT_EXTERNAL_IO"): "w0", ("ie", "WRITE_PENDING_AT_EXTERNAL_IO"): "w0", ("io", "EXTERNAL_IO_BEFORE_COMMIT"): "c", ("ie", "EXTERNAL_IO_BEFORE_COMMIT"): "c",
        ("il", "WRITE_PENDING_AT_EXTERNAL_IO"): "wt",  # the commit does not dominate what lies in a loop
    }
    a, b = F.col("a"), F.col("b")
    pairs = spark.createDataFrame([("1", then_, "2", else_), ("1", top, "2", then_), ("1", leave, "2", top), ("1", loop, "2", loop), ("1", then_, "1", then_)], f"i string, a {FRAME}, j string, b {FRAME}")
    assert [r[0] for r in pairs.select(O.may_co_execute(F.col("i"), a, F.col("j"), b)).collect()] == [False, True, False, True, False]
    assert [r[0] for r in pairs.select(O.dominates(F.lit(1), a, F.lit(2), b)).collect()] == [False, False, False, True, True]
    assert [r[0] for r in pairs.select(O.ordered_before(F.lit(1), a, F.lit(2), b)).collect()] == [True, True, True, False, True]
    grades = spark.createDataFrame([("WRITE_PENDING_AT_EXTERNAL_IO", "HTTP", "unknown", True, None), ("WRITE_PENDING_AT_EXTERNAL_IO", "FILE", "unknown", True, None), ("EXTERNAL_IO_BEFORE_COMMIT", "HTTP", "read", True, None), ("IO_BEFORE_ESCAPING_ERROR", "HTTP", "write", True, "proven_effective"), ("WRITE_PENDING_AT_UI", "", "", False, None)], "l string, t string, d string, r boolean, c string")
    assert [r[0] for r in grades.select(O.hazard_grade(*map(F.col, "ltdrc"))).collect()] == ["critical", "high", "suppressed", "medium", "suppressed"]
    chains = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "t"])], "chain_id string, routine_ids array<string>")
    assert {r["chain_id"]: r["escapes"] for r in O.error_escapes(chains, spark.createDataFrame([("t", True), ("a", False)], "routine_id string, is_try boolean")).collect()} == {"1": True, "2": False}
    steps = spark.createDataFrame([("r", "e", 1, "unconditional-on-success"), ("r", "e", 1, "conditional-branch"), ("r", "e", 2, "conditional-loop"), ("r", "f", 1, "?"), ("r", "f", 1, "conditional-loop")], "root string, effect string, path_id int, condition string")
    paths = O.path_conditionality(steps)
    assert {(r["effect"], r["path_id"]): r["conditionality"] for r in paths.collect()} == {("e", 1): "conditional-branch", ("e", 2): "conditional-loop", ("f", 1): "unknown"}
    assert {r["effect"]: (r["conditionality"], r["paths"]) for r in O.effect_conditionality(paths).collect()} == {"e": ("conditional-branch", 2), "f": ("unknown", 1)}
    depth = O.loop_depth(spark.createDataFrame([("r", "o1", 5), ("r", "o2", 1)], "routine_id string, op_id string, line int"), spark.createDataFrame([("r", 2, 9), ("r", 4, 6)], "routine_id string, start_line int, end_line int"))
    assert {r["op_id"]: r["depth"] for r in depth.collect()} == {"o1": 2, "o2": 0}
