import pytest

from graphloom.functions.names import boolean_literal, fingerprint, folded, guard_name, natural_key, posting_name, strip_quotes, version_key
from graphloom.plans.gate import exit_code, first_findings, in_scope, select_findings, without_baseline
from graphloom.rules.record_rules import DETECTORS, run_detectors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def facts(spark):
    """Routine: operations as (name, variable, line, loops, arguments, temporary)."""
    bodies = {
        "plain": [("Get", "Cust", 1, [], [], None), ("Modify", "cust", 2, [], [], None), ("SetLoadFields", "Cust", 3, [], [], None)],
        "bare": [("Modify", "Cust", 1, [], [], None), ("DeleteAll", "Cust", 2, [], [], None), ("SetRange", "Cust", 3, [], [], None), ("ModifyAll", "Cust", 4, [], [], None), ("Reset", "Cust", 5, [], [], None), ("ModifyAll", "Cust", 6, [], [], None), ("DeleteAll", "Tmp", 7, [], [], True)],
        "loop": [("FindSet", "C", 1, [], [], None), ("Modify", "C", 2, ["l1"], [], None), ("Get", "S", 3, ["l1"], ["'A'"], None), ("Get", "s", 4, ["l1"], ["'A'"], None), ("Next", "C", 5, ["l1"], [], None)],
        "param": [("Modify", "P", 1, [], [], None), ("DeleteAll", "P", 2, [], [], None)],
        "valid": [("Get", "V", 1, [], [], None), ("Validate", "V", 2, [], [], None), ("Get", "V", 3, [], [], None), ("Validate", "V", 4, [], [], None), ("Modify", "V", 5, [], [], None), ("TestField", "W", 6, [], [], None)],
        "broken": [("Modify", "X", 1, [], [], None)],
    }
    ops = [(f"{r}{i}", r, op, v, f"t{v.lower()}", ("known", t) if t else None, loops, args, (line, 0)) for r, body in bodies.items() for i, (op, v, line, loops, args, t) in enumerate(body)]
    df = spark.createDataFrame
    return {
        "record_operations": df(ops, "op_id string, routine_id string, op string, var string, table_id string, temp struct<kind:string,value:boolean>, loop_stack array<string>, field_args array<string>, anchor struct<start_line:int,start_col:int>"),
        "routines": df([(r, "app1" if r != "plain" else "app2", "internal" if r == "plain" else "local", True, r == "broken") for r in bodies], "routine_id string, app_guid string, access string, body_available boolean, parse_incomplete boolean"),
        "record_variables": df([("param", "p", True), ("plain", "Cust", False)], "routine_id string, name string, is_parameter boolean"),
        "operation_sites": df([("c1", "loop", "commit", ["l1"]), ("c2", "loop", "commit", ["l1", "l2"]), ("c3", "bare", "commit", []), ("c4", "bare", "error-call", ["l"])], "op_id string, routine_id string, kind string, loop_stack array<string>"),
        "events": df([("e1", "bare", "integration"), ("e2", "loop", "integration"), ("e3", "plain", "business")], "event_id string, publisher_routine_id string, kind string"),
        "event_edges": df([("e1", "valid"), ("e9", "valid")], "event_id string, subscriber_routine_id string"),
        "combined_edges": df([("bare", "plain", "o1"), ("plain", "bare", "o2"), ("plain", "plain", "o3")], "from string, to string, operation_id string"),
        "arguments": df([("bare", 0, "TRUE"), ("bare", 0, " true"), ("bare", 1, "true"), ("bare", 1, "x"), ("loop", 0, "false"), ("plain", 0, "true"), ("plain", 0, "true")], "routine_id string, position int, text string"),
        "parameters": df([("bare", "SkipCheck", "Boolean", True), ("bare", "IsHandled", "Boolean", True), ("loop", "Amount", "Decimal", True), ("loop", "HasPermission", "Boolean", False), ("plain", "SkipX", "Boolean", True)], "routine_id string, name string, type string, is_var boolean"),
    }


WANT = {
    "d4-repeated-lookup-in-loop": {("loop", "loop2", "medium")},
    "d10-self-modifying-loop": {("loop", "loop1", "high")},
    "d11-modify-without-get": {("bare", "bare0", "medium")},
    "d21-read-without-load": {("valid", "valid5", "medium")},
    "d33-unfiltered-bulk-write": {("bare", "bare1", "critical"), ("bare", "bare5", "high")},
    "d36-late-setloadfields": {("plain", "plain2", "low")},
    "d37-validate-without-persist": {("valid", "valid1", "medium")},
    "d52-bulk-write-param-no-temp-guard": {("param", "param1", "high")},
    "d12-dead-integration-event": {("loop", None, "info")},
    "d13-cross-app-internal-call": {("bare", "o1", "high")},
    "d32-constant-boolean-parameter": {("bare", None, "info")},
    "d59-integrationevent-var-boolean-guard": {("bare", None, "medium")},
}


def test_detectors(facts):
    assert set(WANT) <= set(DETECTORS)
    found = run_detectors(facts, list(WANT)).collect()
    for name, want in WANT.items():
        assert {(r["routine_id"], r["op_id"], r["severity"]) for r in found if r["detector"] == name} == want, name
    assert len(found) == sum(map(len, WANT.values()))
    few = run_detectors({k: v for k, v in facts.items() if k in ("record_operations", "routines", "record_variables")})
    assert {r["detector"] for r in few.collect()} == {k for k in WANT if k[:3] in ("d4-", "d10", "d11", "d21", "d33", "d36", "d37", "d52")}
    assert {r["detector"] for r in run_detectors(facts, ["record-safety"]).collect()} == {k for k in WANT if k[:3] in ("d4-", "d10", "d11", "d21", "d33", "d36", "d37")}
    with pytest.raises(ValueError):
        run_detectors(facts, ["d0"])


def test_names(spark):
    def of(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]

    assert of(strip_quotes, '"No."', "No.", None) == ["No.", "No.", None]
    assert of(folded, "Sales Line", "ÄB", None) == ["sales line", "äb", None]
    assert of(posting_name, "PostSales", "Postal", "Release9") == [True, False, False]
    assert of(guard_name, "SkipIt", '"IsHandled"', "UserAuthorised", "Amount") == [True, False, True, False]
    assert of(boolean_literal, " TRUE ", "x", "false") == ["true", None, "false"]
    assert of(version_key, "1.10", "1.9.0.0", "junk", "3.4b.x", None) == [[1, 10, 0, 0], [1, 9, 0, 0], [0] * 4, [3, 4, 0, 0], [0] * 4]
    assert of(lambda c: fingerprint(c, F.lit("b")), "a")[0] == __import__("hashlib").sha256(b"a|b").hexdigest()[:16]
    names = ["d10", "d2", "d2-a", "1x", "d2-b", "x", "d002"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(natural_key(F.col("n")), "n").collect()] == ["1x", "d002", "d2", "d2-a", "d2-b", "d10", "x"]


def test_gate(spark):
    f = spark.createDataFrame([("d10", "high", "a", 3, "f1", False), ("d2", "info", "a", 1, "f2", None), ("d2", "odd", "b", 1, "f3", True)], "detector string, severity string, file string, line int, fingerprint string, dep boolean")
    ids = lambda df: [r["fingerprint"] for r in df.collect()]
    assert ids(select_findings(f, "low")) == ["f1"] and ids(select_findings(f, None, ["d10"])) == ["f1"]
    assert sorted(ids(in_scope(f, F.col("dep")))) == ["f1", "f2"] and len(ids(in_scope(f, F.col("dep"), "all"))) == 3
    assert ids(first_findings(f, 2)) == ["f2", "f3"] and ids(first_findings(f, None))[-1] == "f1"
    assert ids(without_baseline(f, spark.createDataFrame([("f2",), ("f2",), ("f3",)], "fingerprint string"))) == ["f1"]
    assert [exit_code(f, x) for x in (None, "high", "critical")] == [0, 1, 0]


def test_gates(spark, facts):
    """A callee that loads, filters or stores counts; so does the platform's Rec; virtual tables and guarded temporaries do not."""
    df = spark.createDataFrame
    anchor = "struct<start_line:int,start_col:int>"
    ops = [("a", "g", "Modify", "L", "t1", 5, False), ("b", "g", "DeleteAll", "F", "t1", 6, False), ("c", "g", "Validate", "S", "t1", 3, False), ("d", "trig", "Modify", "Rec", "t1", 2, False), ("e", "g", "Modify", "V", "virt", 2, False), ("f", "g", "DeleteAll", "T", "t1", 2, True)]
    more = {
        "record_operations": df([(i, r, o, v, t, None, [], [], (line, 0), g) for i, r, o, v, t, line, g in ops], f"op_id string, routine_id string, op string, var string, table_id string, temp struct<kind:string,value:boolean>, loop_stack array<string>, field_args array<string>, anchor {anchor}, temp_guard boolean"),
        "routines": df([("g", "cu", "procedure", True, False), ("trig", "tab", "trigger", True, False)], "routine_id string, object_id string, kind string, body_available boolean, parse_incomplete boolean"),
        "record_variables": facts["record_variables"].where("false"), "objects": df([("tab", "Table"), ("cu", "Codeunit")], "object_id string, kind string"), "tables": df([("virt", True), ("t1", False)], "table_id string, is_virtual boolean"),
    }
    found = lambda f: {(r["detector"][:3], r["op_id"]) for r in run_detectors(f, ["d11-modify-without-get", "d33-unfiltered-bulk-write", "d37-validate-without-persist"]).collect()}
    bare = found(more)
    assert bare == {("d11", "a"), ("d33", "b"), ("d37", "c"), ("d11", "c")}
    bind = [("k1", "g", "L", "h", 0, 4), ("k2", "g", "F", "h", 1, 5), ("k3", "g", "S", "h", 2, 9), ("k4", "g", "S", "h", 0, 1)]
    more["bindings"] = df([(c, r, v, h, p, True, (line, 0), []) for c, r, v, h, p, line in bind], f"callsite_id string, routine_id string, var string, callee string, position int, by_ref boolean, anchor {anchor}, loop_stack array<string>")
    more["roles"] = df([("h", 0, "yes", "no", "no", "no"), ("h", 1, "no", "unknown", "no", "no"), ("h", 2, "no", "no", "no", "yes")], "routine_id string, position int, loads string, filters string, resets string, persists string")
    assert found(more) == set()
