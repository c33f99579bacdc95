import pytest

from graphloom.rules import graph_rules  # noqa: F401  registers its detectors
from graphloom.rules.record_rules import DETECTORS, OPT_IN, MissingFacts, chosen_detectors, run_detectors
from graphloom.storage import Stage

OPS = "op_id string, routine_id string, op string, var string, table_id string, temp struct<kind:string,value:boolean>, loop_stack array<string>, field_args array<string>, anchor struct<start_line:int,start_col:int>, in_until boolean, run_trigger boolean"
FRAMES = "array<struct<id:int,kind:string,falls_through:boolean>>"
NAMES = ["PostAll", "top", "mid", "leaf", "pub", "sub1", "sub2", "try", "dead", "old", "life", "dep", "pg", "walk", "clone", "handy", "q"]


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame

    def op(i, r, name, var="R", table="t1", temp=None, loops=(), args=(), line=1, until=False, trig=None):
        return (i, r, name, var, table, ("known", True) if temp else None, list(loops), list(args), (line, 0), until, trig)

    ops = [
        op("m1", "leaf", "Modify"), op("g1", "leaf", "Get", line=2), op("u1", "walk", "Next", var="C", loops=["l1"], line=3, until=True), op("f0", "walk", "FindSet", var="C", line=1), op("w1", "walk", "Modify", var="C", loops=["l1"], line=2),
        op("s1", "sub1", "Insert", table="t9"), op("s2", "sub2", "Modify", table="t9"), op("t5", "PostAll", "Insert", table="t5"), op("x1", "life", "Modify", var="C", loops=["l1"]), op("x2", "life", "Next", var="C", loops=["l1"], line=2),
        op("c1", "clone", "Next", var="C", loops=["l1"], line=9), op("c2", "clone", "Modify", var="D", loops=["l1"], line=5), op("k1", "q", "SetRange", var="K", loops=["l1"], args=["Field", "'A'"]), op("k2", "q", "SetRange", var="K", loops=["l1"], args=["Field", "X"], line=2),
        op("p1", "sub1", "Modify", var="P", table="t7", line=4), op("h1", "handy", "SetRange", var="H", line=1), op("h2", "handy", "FindSet", var="H", line=9), op("h3", "handy", "SetLoadFields", var="H", args=["Name"], line=2), op("e1", "mid", "Get", var="E", table="t4", line=1),
    ]
    kinds = {"sub1": "event-subscriber", "sub2": "event-subscriber", "life": "trigger", "pub": "event-publisher"}
    routines = [(n, n if n != "PostAll" else "PostAll", "cu" if n not in ("life", "pg") else n, kinds.get(n, "procedure"), "local" if n == "dead" else None, "app" if n != "dep" else "depapp", True, False, n == "dep", "removed" if n == "old" else None, n == "try") for n in NAMES]
    calls = [("k1", "top", ["l1"]), ("k2", "mid", []), ("k3", "top", ["l1", "l2"]), ("k4", "PostAll", []), ("k5", "try", []), ("k6", "top", []), ("k7", "top", []), ("k8", "handy", [])]
    edges = [("top", "mid", "direct", "k1", None), ("mid", "leaf", "direct", "k2", None), ("top", "pub", "direct", "k3", None), ("pub", "sub1", "event-dispatch", None, "ev"), ("pub", "sub2", "event-dispatch", None, "ev"), ("PostAll", "mid", "direct", "k4", None), ("try", "pub", "direct", "k5", None), ("top", "old", "direct", "k6", None), ("life", "mid", "direct", None, None), ("top", "dep", "direct", None, None), ("top", "try", "direct", "k7", None), ("sub2", "pub", "direct", None, None)]
    ordered = [("o1", "top", "DB_MODIFY", 0, [], True, False, False, None), ("o2", "top", "HTTP", 1, [], True, False, False, "POST"), ("o3", "top", "COMMIT", 2, [], True, True, False, None), ("o4", "mid", "HTTP", 0, [], True, False, False, "GET"), ("o5", "mid", "ERROR_THROW", 1, [], True, False, False, None), ("o6", "leaf", "HTTP", 0, [(1, "loop", None)], True, False, False, "PUT"), ("o7", "leaf", "ERROR_THROW", 1, [], True, False, False, None), ("o8", "q", "DB_INSERT", 0, [], True, False, False, None), ("o9", "q", "UI_WINDOW_OPEN", 1, [], True, False, False, None), ("oa", "walk", "TELEMETRY", 0, [], True, False, False, "LogUsage"), ("ob", "walk", "DB_MODIFY", 1, [], True, False, False, None)]
    anchor = "struct<start_line:int,start_col:int>"
    return {
        "stage": Stage(spark, "rules"),
        "record_operations": df(ops, OPS), "routines": df(routines, "routine_id string, name string, object_id string, kind string, access string, app_guid string, body_available boolean, parse_incomplete boolean, is_dependency boolean, obsolete string, is_try boolean"),
        "record_variables": df([("sub1", "P", True)], "routine_id string, name string, is_parameter boolean"),
        "call_sites": df([(c, r, "m", loops, (5, 0), c == "k7", False, False, [("call", "'<b>' + x", None)] if c == "k2" else []) for c, r, loops in calls], f"callsite_id string, routine_id string, method string, loop_stack array<string>, anchor {anchor}, in_statement boolean, under_asserterror boolean, result_used boolean, args array<struct<kind:string,text:string,name:string>>"),
        "combined_edges": df(edges, "from string, to string, kind string, callsite_id string, event_id string").selectExpr("*", "cast(null as string) as operation_id"),
        "operation_sites": df([("cm", "mid", "commit", []), ("cl", "leaf", "commit", ["l1"]), ("cr", "mid", "checked-run", [])], "op_id string, routine_id string, kind string, loop_stack array<string>"),
        "events": df([("ev", "pub", "integration"), ("lonely", "q", "integration")], "event_id string, publisher_routine_id string, kind string"),
        "event_edges": df([("ev", "sub1", "pub", "OnBeforeModify"), ("ev", "sub2", "pub", "OnBeforeModify"), ("eo", "q", "old", "OnX")], "event_id string, subscriber_routine_id string, publisher_routine_id string, event_name string"),
        "objects": df([("cu", "Codeunit", None, None, True, None, None, None, None), ("life", "Codeunit", "Upgrade", None, False, None, None, None, None), ("pg", "Page", None, "API", False, False, True, None, None)], "object_id string, kind string, subtype string, page_type string, single_instance boolean, editable boolean, insert_allowed boolean, modify_allowed boolean, delete_allowed boolean"),
        "coverage": df([(n, "complete") for n in NAMES if n != "top"], "routine_id string, status string"),
        "apps": df([("depapp", "2.0"), ("app", "1.0")], "app_guid string, version string"),
        "declared_dependencies": df([("app", "depapp", "1.9")], "app_guid string, dep_guid string, min_version string"),
        "parameters": df([("mid", "Unused", "Integer", False), ("mid", "Used", "Integer", False), ("sub1", "X", "Integer", False)], "routine_id string, name string, type string, is_var boolean"),
        "identifier_refs": df([("mid", "USED")], "routine_id string, name string"),
        "statements": df([("st1", "mid", "b", 1, "exit"), ("st2", "mid", "b", 2, "call"), ("st3", "mid", "c", 1, "call"), ("st4", "mid", "c", 2, "break"), ("st5", "mid", "c", 3, "call")], "statement_id string, routine_id string, block_id string, place int, kind string"),
        "field_accesses": df([("a1", "mid", "E", "Amount", "t4", False, (3, 0)), ("a2", "mid", "E", "Name", "t4", False, (4, 0)), ("a3", "mid", "E", "No", "t4", False, (5, 0))], f"access_id string, routine_id string, var string, field string, table_id string, is_parameter boolean, anchor {anchor}"),
        "fields": df([("t4", "Amount", "FlowField", False), ("t4", "Name", "Normal", False), ("t4", "No", "Normal", True)], "table_id string, name string, field_class string, in_key boolean"),
        "bindings": df([("k8", "handy", "H", "help", 0, True, (5, 0), [], False), ("k9", "handy", "Z", "help", 0, True, (6, 0), [], False)], f"callsite_id string, routine_id string, var string, callee string, position int, by_ref boolean, anchor {anchor}, loop_stack array<string>, known_temp boolean"),
        "roles": df([("help", 0, "no", "no", "yes", "no", "yes", "yes", "yes", ["Name", "City"])], "routine_id string, position int, loads string, filters string, resets string, persists string, dirty_at_exit string, requires_loaded string, mutates string, required_fields array<string>"),
        "handled_guards": df([("leaf", "ev", "m1", "t1", True)], "routine_id string, event_id string, op_id string, table_id string, straight boolean"),
        "handled_setters": df([("sub1", True)], "routine_id string, certain boolean"),
        "var_assignments": df([("clone", "D", "C", ["l1"], (4, 0))], f"routine_id string, target string, source string, loop_stack array<string>, anchor {anchor}"),
        "global_mutations": df([("sub1", "Cache", "grow"), ("sub2", "List", "grow"), ("mid", "list", "clear")], "routine_id string, variable string, kind string"),
        "query_operations": df([("q1", "q", "Q", "SetRange", (1, 0), "q1"), ("q2", "q", "Q", "Open", (2, 0), "q2"), ("q3", "q", "q", "SetFilter", (3, 0), "q3"), ("q4", "q", "Q", "Close", (4, 0), "q4"), ("q5", "q", "Q", "SetRange", (5, 0), "q5")], f"id string, routine_id string, var string, op string, anchor {anchor}, op_id string"),
        "ordered_operations": df(ordered, f"op_id string, routine_id string, effect string, order_id int, frames {FRAMES}, on_success_path boolean, dominates_return boolean, temporary boolean, method string"),
    }


WANT = {
    "d1-db-op-in-loop": {("leaf", "m1", "high"), ("leaf", "g1", "medium"), ("walk", "w1", "high"), ("sub1", "s1", "critical"), ("sub1", "p1", "critical"), ("sub2", "s2", "critical"), ("life", "x1", "high"), ("life", "x2", "medium"), ("clone", "c1", "medium"), ("clone", "c2", "high"), ("mid", "e1", "medium")},
    "d2-event-fanout-in-loop": {("top", "k3", "high")}, "d3-missing-setloadfields": {("mid", "e1", "medium")}, "d5-set-based-opportunity": {("walk", "w1", "info"), ("life", "x1", "info")}, "d7-recursive-event-expansion": {("pub", None, "high")},
    "d8-commit-in-transaction": {("mid", "cm", "high")}, "d9-transaction-span-summary": {("mid", "cm", "info")}, "d14-dead-routine": {("dead", None, "info")}, "d16-obsolete-routine-call": {("top", "k6", "high")}, "d17-min-version-drift": {("top", "depapp", "info")},
    "d18-constant-filter-in-loop": {("q", "k1", "low")}, "d19-unused-parameter": {("mid", "Unused", "info")}, "d20-unreachable-after-exit": {("mid", "st2", "low")}, "d22-flowfield-without-calcfields": {("mid", "a1", "medium")}, "d29-subscriber-modify-on-event-record": {("sub1", "p1", "medium")},
    "d34-commit-in-loop": {("leaf", "cl", "high"), ("top", "k1", "medium")}, "d35-commit-in-event-subscriber": set(), "d38-subscriber-to-obsolete-event": {("q", "eo", "high")}, "d39-record-left-dirty-across-chain": {("handy", "k8", "medium"), ("handy", "k9", "medium")},
    "d41-transitive-filter-loss": {("handy", "h2", "high")}, "d42-cross-call-wrong-setloadfields": {("handy", "k8", "low")}, "d43-event-ishandled-skip": {("leaf", "m1", "high")}, "d44-event-multi-subscriber-overlap": {("sub1", "ev", "medium")}, "d45-event-transitive-table-exposure": {("pub", None, "info")},
    "d53-ignored-tryfunction-result": {("top", "k7", "high")}, "d54-publish-in-tryfunction-cone": {("try", "ev", "medium")}, "d55-event-publish-in-loop": {("top", "k3", "high")}, "d56-clone-before-write-in-loop": {("clone", "c2", "medium")}, "d57-singleinstance-growing-state": {("sub1", "Cache", "medium")},
    "d58-query-filter-after-open": {("q", "q3", "medium")}, "d60-upgrade-loop-should-be-datatransfer": {("life", "x1", "medium")}, "d40-transitive-load-missing": {("handy", "k8", "high"), ("handy", "k9", "high")}, "d46-commit-in-lifecycle": {("life", None, "high")},
    "d47-io-unsafe-txn": {("top", "o2", "critical")}, "d48-io-in-loop": {("leaf", "o6", "high"), ("mid", "o4", "high")}, "d49-uncommitted-write-before-ui": {("q", "o9", "high")}, "d50-checked-run-implicit-commit": {("mid", "cr", "medium")}, "d51-retry-side-effect-duplication": {("leaf", "o6", "low")},
    "d61-ishandled-bypasses-critical-write": {("leaf", "m1", "high")}, "d62-telemetry-before-success": {("walk", "oa", "low")}, "d63-html-concat-injection": {("mid", "k2", "low")}, "d64-api-page-write-surface": {(None, "pg", "low")},
}


@pytest.mark.parametrize("name", WANT)
def test_detector(facts, name):
    got = {(r["routine_id"], r["op_id"], r["severity"]) for r in DETECTORS[name](facts).collect()}
    if name == "d45-event-transitive-table-exposure":
        assert len(DETECTORS[name](facts).collect()) == 2  # t9 and t7
    assert got == WANT[name]


def test_registry(facts):
    assert len(DETECTORS) == 54 and len(OPT_IN) == 11 and len(chosen_detectors()) == 43
    assert chosen_detectors(["transaction-integrity", "d1-db-op-in-loop", "d34-commit-in-loop"])[-1] == "d1-db-op-in-loop" and len(chosen_detectors(["bcquality"])) == 13
    skipped = []
    run_detectors({"statements": facts["statements"], "routines": facts["routines"]}, None, skipped)
    assert len(skipped) == 42 and ("d12-dead-integration-event", "events, event_edges") in skipped
    with pytest.raises(MissingFacts):
        run_detectors({"routines": facts["routines"]}, ["d20-unreachable-after-exit"])
    with pytest.raises(MissingFacts):
        run_detectors({})


def test_calls_are_walked_once_not_once_a_routine(facts, monkeypatch):
    """before, each routine with an operation, or that commits, was a root of its own."""
    roots, walk = [], graph_rules.reach_from
    monkeypatch.setattr(graph_rules, "reach_from", lambda seeds, *a, **b: roots.append(seeds.select("root").distinct().count()) or walk(seeds, *a, **b))
    for name, most in (("d1-db-op-in-loop", 2), ("d34-commit-in-loop", 1), ("d35-commit-in-event-subscriber", 1)):
        roots.clear()
        DETECTORS[name](facts)
        assert roots and max(roots) <= most


def test_overlap_looks_at_subscribers_only(facts, monkeypatch):
    """F16: before, operations of all routines were grouped by table and joined with the events."""
    seen, operations = [], graph_rules.operations
    monkeypatch.setattr(graph_rules, "operations", lambda f: seen.append({r[0] for r in f["record_operations"].select("routine_id").distinct().collect()}) or operations(f))
    DETECTORS["d44-event-multi-subscriber-overlap"](facts)
    assert seen and seen[0] <= {"sub1", "sub2", "q"}
