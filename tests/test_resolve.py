import pytest

from graphloom.operators import resolve as R
from graphloom.storage import Stage
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def world(spark):
    df = spark.createDataFrame
    objects = [
        ("c/T18", "c", "Table", 18, "Customer", None, [], None), ("b/T18", "b", "Table", 18, "Customer", None, [], None), ("b/T27", "b", "Table", 27, "Item", None, [], None), ("d/T27", "d", "Table", 27, "Item", None, [], None),
        ("a/TE1", "a", "TableExtension", 50, "Cust Ext", '"customer"', [], None), ("a/C1", "a", "Codeunit", 1, "Post", None, ["IRun"], None), ("b/C2", "b", "Codeunit", 2, "Help", None, ["irun"], None), ("c/C3", "c", "Codeunit", 3, "Other", None, ["IRun", "IOther"], None),
        ("a/P1", "a", "Page", 21, "Cust Card", None, [], "Customer"), ("x/T99", "x", "Table", 99, "Hidden", None, [], None), ("a/PE1", "a", "PageExtension", 60, "Card Ext", "Cust Card", [], None),
    ]
    routines = [
        ("post1", "a/C1", "Run", "procedure", None, 0), ("onrun", "a/C1", "OnRun", "trigger", None, 0), ("calc1", "a/C1", "Calc", "procedure", None, 1), ("calc2", "a/C1", "calc", "procedure", None, 1), ("calc3", "a/C1", "Calc", "procedure", None, 2),
        ("help", "b/C2", "Run", "procedure", None, 0), ("hid", "b/C2", "Secret", "procedure", "local", 0), ("tabp", "c/T18", "Balance", "procedure", None, 0), ("extp", "a/TE1", "Bonus", "procedure", None, 0), ("ins", "c/T18", "OnInsert", "trigger", None, 0),
        ("val", "c/T18", "OnValidate", "trigger", None, 0), ("exti", "a/TE1", "OnInsert", "trigger", None, 0), ("pub", "b/C2", "OnDone", "event-publisher", None, 1), ("open", "a/P1", "OnOpenPage", "trigger", None, 0),
    ]
    apps = df([(x,) for x in "abcdx"], "app_guid string")
    deps = df([("a", "b"), ("b", "c"), ("a", "d")], "app_guid string, dep_guid string")
    return {
        "apps": apps, "deps": deps, "closure": R.app_closure(apps, deps, Stage(spark, "t")),
        "objects": df(objects, "object_id string, app_guid string, kind string, number long, name string, extends string, implements array<string>, source_table string"),
        "routines": df(routines, "routine_id string, object_id string, name string, kind string, access string, arity int"),
    }


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def test_topology(spark, world):
    got = {}
    for r in world["closure"].collect():
        got.setdefault(r["app_guid"], set()).add(r["visible_guid"])
    assert got == {"a": {"a", "b", "c", "d"}, "b": {"b", "c"}, "c": {"c"}, "d": {"d"}, "x": {"x"}}
    m = spark.createDataFrame([("a", [("B",), ("zz",)], [("D",)])], "app_guid string, dependencies array<struct<id:string>>, internals_visible_to array<struct<id:string>>")
    assert [tuple(r) for r in R.dependency_topology(m, world["apps"]).collect()] == [("a", "b")]
    assert [tuple(r) for r in R.friend_apps(m, world["apps"]).collect()] == [("a", "d")]


def test_objects_by_name_and_number(spark, world):
    sites = spark.createDataFrame([("1", "b", "Table", "customer"), ("2", "a", "Table", '"CUSTOMER"'), ("3", "a", "Table", "Item"), ("4", "a", "Table", "Hidden"), ("5", "a", "Codeunit", "other")], "site_id string, app_guid string, kind string, name string")
    got = {r["site_id"]: (r["object_id"], r["outcome"]) for r in R.resolve_object(sites, world["objects"], world["closure"]).collect()}
    assert got == {"1": ("b/T18", "own"), "2": (None, "ambiguous"), "3": (None, "ambiguous"), "4": (None, "not-found"), "5": ("c/C3", "dependency")}
    refs = spark.createDataFrame([("1", "a", "Codeunit", "3"), ("2", "a", "Codeunit", "Help"), ("3", "a", "Table", "18"), ("4", "a", "Codeunit", "77")], "site_id string, app_guid string, kind string, ref string")
    got = {r["site_id"]: (r["object_id"], r["outcome"]) for r in R.resolve_object_ref(refs, world["objects"], world["closure"]).collect()}
    assert got == {"1": ("c/C3", "Resolved"), "2": ("b/C2", "Resolved"), "3": (None, "Ambiguous"), "4": (None, "NotFound")}
    runs = spark.createDataFrame([("1", "a", "Codeunit", "Post"), ("2", "a", "Page", "21"), ("3", "a", "Codeunit", None), ("4", "a", "Report", "9"), ("5", "a", "Codeunit", "Help")], "site_id string, app_guid string, kind string, ref string")
    got = {r["site_id"]: (r["routine_id"], r["outcome"]) for r in R.object_run(runs, world["objects"], world["closure"], world["routines"]).collect()}
    assert got == {"1": ("onrun", "routine"), "2": ("open", "routine"), "3": (None, "dynamic"), "4": (None, "opaque"), "5": (None, "no-entry")}


def test_extensions_interfaces_fields(spark, world):
    assert {tuple(r) for r in R.extensions_of(world["objects"], "Table").collect()} == {("b/T18", "a/TE1"), ("c/T18", "a/TE1")}
    assert {r["object_id"] for r in R.implementers_of(world["objects"]).where("interface_key = 'irun'").collect()} == {"a/C1", "b/C2", "c/C3"}
    p = spark.createDataFrame([("a/TE1", "c/T18"), ("a/C1", "c/T18"), ("a/PE1", "a/P1")], "from_id string, target_id string")
    assert R.object_extends(p, world["objects"], ["Table", "Page"]).count() == 2
    fields = spark.createDataFrame([("c/T18", "f1", "No."), ("a/TE1", "f2", "Bonus"), ("c/T18", "f3", "Name")], "table_id string, field_id string, name string")
    sites = spark.createDataFrame([("1", "a", "c/T18", '"NO."'), ("2", "a", "c/T18", "bonus"), ("3", "c", "c/T18", "bonus"), ("4", "a", "c/T18", "x")], "site_id string, app_guid string, table_id string, field string")
    assert pairs(R.field_in_table(sites, fields, world["objects"], world["closure"]), "site_id", "field_id") == {"1": "f1", "2": "f2", "3": None, "4": None}
    calls = spark.createDataFrame([("1", "IRun", "Run", 0), ("2", "IOther", "Run", 0), ("3", "INone", "Run", 0)], "site_id string, interface string, method string, arity int")
    got = {(r["site_id"], r["object_id"]): (r["routine_id"], r["outcome"]) for r in R.interface_dispatch(calls, world["objects"], world["routines"]).collect()}
    assert got == {("1", "a/C1"): ("post1", "routine"), ("1", "b/C2"): ("help", "routine"), ("1", "c/C3"): (None, "absent"), ("2", "c/C3"): (None, "absent"), ("3", None): (None, "no-implementer")}


def test_overloads(spark):
    # one argument a site: (type, length, var_passable, literal) against candidates of one parameter
    cases = {
        "exact": (("Integer", None, True, None), {"r1": ("Integer", None, False), "r2": ("Record", None, False)}, "r1", "picked"),
        "soft": (("Text", None, True, None), {"r1": ("Text", None, False), "r2": ("Code", 20, False)}, None, "ambiguous"),
        "twice": (("Integer", None, True, None), {"r1": ("Integer", None, False), "r2": ("integer", None, False)}, None, "ambiguous"),
        "byref": (("Text", 30, True, None), {"r1": ("Text", 30, True), "r2": ("Text", 50, True)}, "r1", "picked"),
        "value": (("Text", 30, False, None), {"r1": ("Text", 30, True), "r2": ("Boolean", None, False)}, None, "ambiguous"),
        "untyped": ((None, None, True, None), {"r1": ("Integer", None, False), "r2": ("Boolean", None, False)}, None, "ambiguous"),
        "variant": (("Integer", None, True, None), {"r1": ("Integer", None, False), "r2": ("Variant", None, False)}, None, "ambiguous"),
        "literal": (("Integer", None, False, "integer"), {"r1": ("Integer", None, False), "r2": ("Decimal", None, False)}, None, "ambiguous"),
        "single": (("Boolean", None, True, None), {"r1": ("Integer", None, False)}, "r1", "exact"),
        "none": (("Boolean", None, True, None), {"r1": ("Integer", None, False), "r2": ("Guid", None, False)}, None, "ambiguous"),
    }
    args = spark.createDataFrame([(s, 0, *a) for s, (a, *_) in cases.items()], "site_id string, position int, type string, length int, var_passable boolean, literal string")
    cand = spark.createDataFrame([(s, f"{s}/{r}") for s, (_, c, *_) in cases.items() for r in c], "site_id string, routine_id string")
    par = spark.createDataFrame([(f"{s}/{r}", 0, *p) for s, (_, c, *_) in cases.items() for r, p in c.items()], "routine_id string, position int, type string, length int, by_ref boolean")
    got = {r["site_id"]: (r["routine_id"], r["outcome"]) for r in R.pick_overload(args, cand, par).collect()}
    assert got == {s: (f"{s}/{want}" if want else None, out) for s, (_, _, want, out) in cases.items()}


def test_calls(spark, world):
    sites = spark.createDataFrame(
        [("1", "a/C1", "calc", 2, False), ("2", "a/C1", "Calc", 1, False), ("3", "a/P1", "balance", 0, False), ("4", "a/P1", "Bonus", 0, False), ("5", "a/C1", "Message", 1, False), ("6", "a/C1", "Nope", 0, False), ("7", "a/C1", "Calc", 2, True), ("8", "a/PE1", "OnOpenPage", 0, None)],
        "site_id string, object_id string, method string, arity int, under_with boolean",
    )
    builtins = spark.createDataFrame([("message",)], "name string")
    got = {r["site_id"]: (r["routine_id"], r["outcome"], r["tier"]) for r in R.resolve_bare(sites, world["objects"], world["routines"], builtins).collect()}
    assert got == {"1": ("calc3", "routine", "own"), "2": (None, "ambiguous", "own"), "3": ("tabp", "routine", "record"), "4": ("extp", "routine", "record"), "5": (None, "builtin", None), "6": (None, "unknown", None), "7": (None, "declined", "own"), "8": ("open", "routine", "base")}
    m = spark.createDataFrame(
        [("1", "Record", "c/T18", "FindSet", 0), ("2", "Record", "c/T18", "Balance", 0), ("3", "Record", "c/T18", "Bonus", 0), ("4", "Object", "a/C1", "Run", 1), ("5", "Object", "b/C2", "Secret", 0), ("6", "Dynamic", None, "X", 0), ("7", "HttpClient", None, "Get", 2), ("8", "SelfObject", "b/C2", "Secret", 0)],
        "site_id string, receiver_kind string, object_id string, method string, arity int",
    )
    catalog = spark.createDataFrame([("Record", "findset"), ("HttpClient", "Get")], "receiver_kind string, method string")
    got = {r["site_id"]: (r["routine_id"], r["outcome"]) for r in R.resolve_member(m, world["objects"], world["routines"], catalog).collect()}
    assert got == {"1": (None, "builtin"), "2": ("tabp", "routine"), "3": ("extp", "routine"), "4": ("onrun", "routine"), "5": (None, "unknown"), "6": (None, "dynamic"), "7": (None, "builtin"), "8": ("hid", "routine")}
    named = spark.createDataFrame([("1", "a/C1", "Calc", 2), ("2", "a/C1", "Calc", 7), ("3", "a/C1", "Nope", 0)], "site_id string, object_id string, method string, arity int")
    assert {(r["site_id"], r["routine_id"], r["tier"]) for r in R.by_name_and_arity(named, world["routines"]).collect()} == {("1", "calc3", "arity"), ("2", "calc1", "name"), ("2", "calc2", "name"), ("2", "calc3", "name")}


def test_events_triggers_and_graph(spark, world):
    pub = spark.createDataFrame([("pub", "b/C2", "OnDone", 1, True)], "routine_id string, object_id string, name string, arity int, include_sender boolean")
    subs = spark.createDataFrame([("s1", "a", "Codeunit", "help", "ondone", 2), ("s2", "b", "Codeunit", "Help", "OnDone", 3), ("s3", "a", "Codeunit", "Help", "OnOther", 0), ("s4", "a", "Codeunit", "Gone", "OnDone", 0)], "routine_id string, app_guid string, target_kind string, target_name string, event string, arity int")
    e = R.event_graph(pub, subs, world["objects"])
    got = {r["subscriber_routine_id"]: (r["event_id"], r["publisher_routine_id"], r["resolution"], r["arity_ok"]) for r in e.collect()}
    assert got == {"s1": ("b/C2#ondone", "pub", "resolved", True), "s2": ("b/C2#ondone", "pub", "resolved", False), "s3": ("b/C2#onother", None, "maybe", False), "s4": ("?Codeunit/gone#ondone", None, "unknown", False)}
    apps = spark.createDataFrame([("pub", "b")], "routine_id string, app_guid string")
    assert [r["subscriber_routine_id"] for r in R.cross_app_subscribers(e, apps).collect()] == ["s1"]
    ops = spark.createDataFrame([("o1", "post1", "Insert", "c/T18", True, None), ("o2", "post1", "Insert", "c/T18", False, None), ("o3", "help", "Validate", "c/T18", None, '"No."'), ("o4", "help", "Validate", "c/T18", None, "Name"), ("o5", "help", "Get", "c/T18", None, None)], "operation_id string, routine_id string, op string, table_id string, run_trigger boolean, field string")
    trig = spark.createDataFrame([("ins", "c/T18", "OnInsert", None), ("exti", "a/TE1", "OnInsert", None), ("val", "c/T18", "OnValidate", "No.")], "routine_id string, object_id string, name string, member string")
    t = R.implicit_trigger_edges(ops, trig, world["objects"])
    assert {tuple(r) for r in t.select("from", "to", "operation_id", "resolution").collect()} == {("post1", "ins", "o1", "maybe"), ("post1", "exti", "o1", "maybe"), ("help", "val", "o3", "resolved")}
    calls = spark.createDataFrame([("post1", "help", "direct", "c1", "x1", "resolved"), ("help", None, "method", "c2", "x2", "unknown")], "from string, to string, kind string, callsite_id string, operation_id string, resolution string")
    edges, unsure = R.combined_graph(calls, e, t)
    assert edges.groupBy("kind").count().orderBy("kind").collect() == [("direct", 1), ("event-dispatch", 2), ("implicit-trigger", 3)] and unsure.count() == 1
    assert [r["from"] for r in R.reversed_edges(edges).where("to = 's1'").collect()] == ["pub"]
    b = R.argument_bindings(spark.createDataFrame([("c1", "calc3")], "site_id string, routine_id string"), spark.createDataFrame([("c1", i, "variable", f"v{i}") for i in range(3)], "site_id string, position int, source_kind string, source string"), spark.createDataFrame([("calc3", 0, "P", True), ("calc3", 1, "Q", False)], "routine_id string, position int, name string, by_ref boolean"))
    assert [(r["position"], r["parameter"], r["bound"]) for r in b.orderBy("position").collect()] == [(0, "P", True), (1, "Q", True), (2, None, False)]


def test_outcomes_and_histogram(spark):
    route = lambda t="routine", e="source", *c: (t, e, list(c))
    cases = [
        ("src", "Exact", False, [route()], "Resolved", "source"), ("cat", "Exact", False, [route("builtin", "catalog")], "Resolved", "catalog"), ("abi", "Multicast", True, [route("abi", "abi"), route("x", "unknown")], "Resolved", "abi_external"),
        ("man", "Multicast", True, [route("routine", "source", "ManualBinding")], "ConditionalResolved", None), ("dyn", "DynamicOpen", True, [], "HonestDynamic", None), ("emp", "Polymorphic", True, [], "HonestEmpty", None), ("unk", "Exact", False, [route("unresolved", "unknown")], "Unknown", None),
        ("amb", "AmbiguousOverload", False, [route("a", "source", "AmbiguousDispatch"), route("b", "source", "AmbiguousDispatch")], "AmbiguousResolved", None), ("bad", "AmbiguousOverload", False, [route("a", "source", "AmbiguousDispatch"), route("b", "source")], "Unknown", None), ("none", "Exact", None, None, "Unknown", None),
    ]
    df = spark.createDataFrame([(i, s, p, r, "why" if i == "unk" else None) for i, s, p, r, *_ in cases], "edge_id string, shape string, partial boolean, routes array<struct<target:string,evidence:string,conditions:array<string>>>, reason string")
    c = R.classify(df)
    assert {r["edge_id"]: (r["outcome"], r["evidence"]) for r in c.collect()} == {i: (o, e) for i, _, _, _, o, e in cases}
    h = R.histogram(c).first()
    assert (h["total"], h["resolved_source"], h["unknown"], round(h["unknown_rate"], 2)) == (10, 1, 3, 0.3)
    assert {r["reason"]: r["n"] for r in R.unknown_breakdown(c, "reason").collect()} == {"why": 1, "none": 2}
    assert R.default_reach_edges(spark.createDataFrame([(1, ["ManualBinding"]), (2, []), (3, None)], "i int, conditions array<string>")).count() == 2


def test_matching_and_lookups(spark):
    a = spark.createDataFrame([("f", 1, "x"), ("f", 2, "x"), ("f", 3, "y")], "file string, line int, target string")
    b = spark.createDataFrame([("f", 1, "x"), ("f", 2, "z"), ("f", 4, "q")], "file string, line int, target string")
    assert {r["line"]: r["verdict"] for r in R.match_sites(a, b, ["file", "line"]).collect()} == {1: "same", 2: "differs", 3: "only-fresh", 4: "only-other"}
    spans = spark.createDataFrame([("f", "outer", 1, 0, 20, 0), ("f", "inner", 5, 2, 9, 0), ("f", "line", 6, 0, 6, 9)], "file string, id string, start_line int, start_col int, end_line int, end_col int")
    pos = spark.createDataFrame([("f", 6, 3), ("f", 5, 1), ("f", 30, 0), ("f", 5, 2)], "file string, line int, col int")
    assert {(r["line"], r["col"]): r["id"] for r in R.innermost_declaration(pos, spans).collect()} == {(6, 3): "line", (5, 1): "outer", (30, 0): None, (5, 2): "inner"}
    forms = [spark.createDataFrame([("a/C1/Run", "r1")], "selector_key string, id string"), spark.createDataFrame([("Run", "r1"), ("run", "r2"), ("Calc", "r3")], "selector_key string, id string")]
    got = {r["selector"]: (r["ids"], r["outcome"]) for r in R.resolve_selector(spark.createDataFrame([("A/c1/run",), ("Run",), ("calc",), ("?",)], "selector string"), forms).collect()}
    assert got == {"A/c1/run": (["r1"], "Found"), "Run": (["r1", "r2"], "Ambiguous"), "calc": (["r3"], "Found"), "?": (None, "NotFound")}
    routes = spark.createDataFrame([("1", "abi", "k1"), ("2", "abi", "k2"), ("3", "source", None)], "id string, evidence string, abi_key string")
    assert [r["id"] for r in R.unlisted_abi_routes(routes, spark.createDataFrame([("k1",)], "abi_key string")).collect()] == ["2"]
    c = spark.createDataFrame([("resolved", "direct"), ("unknown", "dynamic"), ("maybe", "method"), ("unknown", "method")], "r string, d string").select(R.legacy_class(F.col("r"), F.col("d")))
    assert [x[0] for x in c.collect()] == ["resolved", "dynamic", "maybe", "unresolved"]


def _most_joined(df):
    """The most rows that a join of the plan gave."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        below = [p.plan()] if "QueryStage" in name else [p.children().apply(k) for k in range(p.children().size())]
        own = p.metrics().apply("numOutputRows").value() if "Join" in name and p.metrics().contains("numOutputRows") else 0
        return max([own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_sites_are_not_joined_with_every_application_they_see(spark):
    """what an application sees is found once; before, each site was joined with each application that it sees."""
    apps = spark.range(20).select(F.lit("a").alias("app_guid"), F.concat(F.lit("d"), "id").alias("visible_guid"))
    objects = spark.range(40).select(F.concat(F.lit("o"), "id").alias("object_id"), F.concat(F.lit("d"), F.col("id") % 20).alias("app_guid"), F.lit("Table").alias("kind"), (F.col("id") % 7).alias("number"), F.concat(F.lit("N"), F.col("id") % 7).alias("name"))
    sites = spark.range(1_000).select(F.col("id").alias("site_id"), F.lit("a").alias("app_guid"), F.lit("Table").alias("kind"), (F.col("id") % 9).alias("number"), F.concat(F.lit("n"), F.col("id") % 9).alias("name"))
    for found in (R.object_by_number(sites, objects, apps), R.resolve_object(sites, objects, apps)):
        assert _most_joined(found) <= 1_000
        assert {r["outcome"] for r in found.where("number < 7").collect()} == {"ambiguous"} and found.where("outcome = 'not-found'").count() == 222
