import json

import pytest

from graphloom.functions import types as T
from graphloom.plans import answers as A
from graphloom.plans import editor as E
from graphloom.sources import symbols as Y
from graphloom.storage import Stage
from graphloom.streaming.incremental import FactTable, file_events, watcher_events
from pyspark.sql import functions as F


def col(spark, fn, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_types(spark):
    assert col(spark, T.canonical_type, "Text [ 50 ]", "Record  Customer Temporary", None) == ["text[50]", "record customer", None]
    assert col(spark, T.base_type, "Code[20]", "Integer") == ["code", "integer"] and col(spark, T.type_length, "Code[20]", "Integer") == [20, None]
    assert [r and tuple(r) for r in col(spark, T.object_reference, 'Record "Sales Line" temporary', "Codeunit Post", "Integer", "List of [Text]")] == [("record", "Sales Line"), ("codeunit", "Post"), None, None]
    assert [r["kind"] for r in col(spark, T.parsed_type, "array[2] of Text", "List of [Text]", "Enum Kind", "Text[5]", "", None)] == ["array", "generic", "object", "primitive", "unknown", "unknown"]
    assert col(spark, T.dispatch_type, 'record "SALES line"', "Record Sales", "TEXT[30]") == ["record:sales line", "record:sales", "text"]
    assert col(spark, T.has_unquoted_dot, '"a.b"', "a.b", "'x.y' + z") == [False, True, False] and col(spark, T.receiver_name, '"My Rec"', "A.B", "Rec", "F()") == ["My Rec", None, "Rec", None]
    assert col(spark, T.field_argument, 'Cust."No."', '"Na""me"', "Rec.Name", "Amount") == ["no.", 'na"me', "name", "amount"]
    par = "array<struct<type:string,by_ref:boolean>>"
    a, b, c, d = col(spark, T.signature, [("Text[5]", True)], [("text[9]", True)], [("Text", False)], [("Te", False), ("xt", False)], kind=par)
    assert a == b and len({a, c, d}) == 3
    at = "array<struct<name:string,args:array<string>>>"
    sub = [("EventSubscriber", ["ObjectType::Codeunit", 'Codeunit::"Sales Post"', "'OnDone'", "''"])]
    assert [r and tuple(r) for r in col(spark, T.subscription, sub, [], kind=at)] == [("Codeunit", "Sales Post", "OnDone", None), None]
    assert [tuple(r) for r in col(spark, T.routine_flags, [("obsolete", ["'x'", "'1'", "Removed"])], [("Obsolete", [])], [("TryFunction", [])], kind=at)] == [("removed", False, False), ("pending", False, False), ("no", True, False)]
    assert col(spark, T.publisher_kind, [("IntegrationEvent", ["true"])], [("Test", [])], kind=at) == ["integration", None] and col(spark, lambda c: T.arity_bound(F.lit(2), c), [("IntegrationEvent", ["true"])], [("IntegrationEvent", ["false"])], kind=at) == [3, 2]
    assert col(spark, lambda c: T.stable_ids(F.lit("r1 r10 x"), c), {"r1": "A", "r10": "B"}, kind="map<string,string>") == ["A B x"]
    assert col(spark, T.uri_of_path, "C:\\a b\\ü.al", "/x/y.al") == ["file:///C:/a%20b/%C3%BC.al", "file:///x/y.al"] and col(spark, T.path_of_uri, "file:///C:/a%20b/%C3%BC+.al", "file:///x/y.al") == ["C:/a b/ü+.al", "/x/y.al"]
    assert col(spark, lambda c: T.utf16_column(c, F.lit(7)), "aé😀b") == [4] and col(spark, T.complexity, ["if", "and", "call", "while"], [], kind="array<string>") == [4, 1]
    names = spark.createDataFrame([("unknown", None, None), ("t", "Customer", 18), ("t", None, 18), ("t", "", None)], "id string, name string, n int").select(T.table_name(F.col("name"), F.col("n"), F.col("id")))
    assert [r[0] for r in names.collect()] == ["unknown table", "Customer", "Table 18", "t"] and len(set(col(spark, lambda c: T.anonymised("k", "d", c), "a", "a", "b"))) == 2


def test_questions(spark):
    eff = [("r1", "COMMIT", None, "unconditional-on-success", "o1"), ("r2", "COMMIT", None, "conditional-branch", "o2"), ("r1", "DB_MODIFY", "Cust", "unknown", "o3"), ("r3", "UI_MESSAGE", None, "unknown", "o4")]
    e = spark.createDataFrame(eff, "root string, effect_type string, resource string, conditionality string, occurrence_id string")
    o = spark.createDataFrame([("r1", 0, 0, 0, "complete", False), ("r2", 0, 0, 0, "complete", False), ("r3", 1, 0, 0, "complete", False), ("r4", 0, 0, 0, "complete", None), ("r5", None, None, None, "partial", False)], "root string, unresolved int, open_world int, gaps int, coverage string, truncated boolean")
    ask = lambda q: {r["root"]: (r["answer"], r["evidence"], r["blockers"]) for r in A.prove(e, o, A.parse_question(q)).collect()}
    got = ask("may-commit")
    assert {k: v[0] for k, v in got.items()} == {"r1": "yes", "r2": "yes", "r3": "unknown", "r4": "no", "r5": "unknown"} and got["r3"][2] == ["unresolved-callsites"] and got["r5"][2] == ["coverage-incomplete"]
    got = ask("commits-on-success-path")
    assert {k: v[0] for k, v in got.items()} == {"r1": "yes", "r2": "unknown", "r3": "unknown", "r4": "no", "r5": "unknown"} and got["r2"][1:] == (["o2"], ["non-unconditional-effect-exists"])
    assert ask("writes-table:CUST")["r1"][0] == "yes" and ask("reaches-ui")["r3"][0] == "yes" and ask("throws-error")["r4"][0] == "no" and ask("publishes-event:X")["r1"][0] == "no"
    for bad in ("", "may-commit:x", "writes-table", "writes-table: ", "other"):
        with pytest.raises(ValueError):
            A.parse_question(bad)


def test_changed_digest_fanout(spark):
    df = spark.createDataFrame
    hunks = df([("a.al", "modified", 10, 3), ("b.al", "deleted", 1, 9)], "path string, change string, new_start int, new_count int")
    starts = df([("a.al", "r1", 9), ("a.al", "r2", 12), ("a.al", "r3", 11), ("b.al", "r4", 2)], "path string, routine_id string, line int")
    changed = A.changed_routines(hunks, starts)
    assert {r[0] for r in changed.collect()} == {"r1", "r3"}
    roots, lost = A.changed_roots(changed, df([("root",)], "routine_id string"), df([("root", "mid"), ("mid", "r1")], "from string, to string"), Stage(spark, "t"))
    assert [tuple(r) for r in roots.collect()] == [("root", 2, ["r1"])] and [r[0] for r in lost.collect()] == ["r3"]
    inh = df([("root", "modify", "table", "t1", 2), ("root", "read", "table", "t1", 1), ("root", "send", "http", None, 3), ("other", "send", "http", None, 0)], "routine_id string, op string, resource_kind string, resource_id string, dist int")
    d = A.digest(df([("root",)], "root string"), inh, df([("root", "t1", 2, ["root", "x"]), ("root", "t1", 1, ["root"])], "root string, fact string, place int, path array<string>"))
    assert {(r["effect_type"], r["dist"]): r["paths"] for r in d.collect()} == {("DB_MODIFY", 2): [["root"], ["root", "x"]], ("HTTP", 3): None} and d.select("occurrence_id").distinct().count() == 2
    fp = A.fingerprint_query(df([("root", ["api-page"]), ("other", ["x"])], "routine_id string, kinds array<string>"), inh, ["api-page"], ["table"])
    assert [tuple(r) for r in fp.collect()] == [("root", "table", ["modify", "read"], ["t1"])]
    ev = df([("e1", "p1"), ("e2", "p1"), ("e3", "p2")], "event_id string, publisher_routine_id string")
    ed = df([("e1", f"s{i}", "resolved") for i in range(6)] + [("e2", "s9", "resolved"), ("e2", "s8", "maybe")], "event_id string, subscriber_routine_id string, resolution string")
    cover = df([(f"s{i}", "complete") for i in range(6)] + [("s9", "partial")], "routine_id string, status string")
    f = A.fanout(ev, ed, cover)
    assert {r["event_id"]: (r["subscribers"], r["hot"], r["dispatch_edges"], r["composition"]) for r in f.collect()} == {"e1": (6, True, "complete", "complete"), "e2": (1, False, "partial", "partial"), "e3": (0, False, "complete", "unknown")}
    assert tuple(A.fanout_totals(f).first()) == (2, 3, 1, 1, 1)
    rep = A.integration_report(ev, ed, df([("p1", "a"), ("p2", "a"), ("s9", "b"), ("s8", "a")], "routine_id string, app_guid string")).where("event_id = 'e2'").first()
    assert rep["cross_app"] and len(rep["subscribers"]) == 2


def test_preflight(spark):
    df = spark.createDataFrame
    acc = A.coverage_accounting(df([(True, False), (False, True)], "body_available boolean, parse_incomplete boolean"), df([("Unknown", "x"), ("Unknown", "x"), ("HonestDynamic", "y"), ("Resolved", "z")], "outcome string, callee string"), df([("Clean",), ("Recovered",)], "status string"), df([("a", True), ("b", False)], "app_guid string, has_source boolean"))
    row = acc.first()
    assert (row["bodies"], row["unknown"], row["dynamic"], row["unresolved_callees"], row["recovered_files"], row["opaque_apps"]) == (1, 2, 1, ["x"], 1, ["b"])
    bad = A.preflight(acc.withColumn("coverage_holds", F.lit(False)), True)
    assert bad["failed"] and "2 unresolved" in bad["message"] and "b" in bad["message"]
    ok = df([(0, True, 0, [])], "unknown int, coverage_holds boolean, recovered_files int, opaque_apps array<string>")
    assert A.preflight(ok, True) == {"degraded": False, "failed": False, "message": "coverage is whole"} and A.preflight(ok.where("false"), False) == {"degraded": True, "failed": False, "message": "resolution coverage could not be verified"}


def test_editor(spark):
    df = spark.createDataFrame
    m = df([("r1", "a", "procedure", False, 11, 5, 4), ("r2", "a", "procedure", False, 1, 20, 0), ("r3", "b", "trigger", False, 1, 1, 0), ("r4", "b", "procedure", True, 1, 1, 0)], "routine_id string, file string, kind string, is_test boolean, complexity int, lines int, parameters int")
    edges = df([("r1", "r2", "c1"), ("r3", "r2", "c2"), ("r3", "r2", "c3")], "from string, to string, callsite_id string")
    want = {("r1", "complexity", "error"), ("r1", "parameters", "warning"), ("r2", "lines", "warning"), ("r1", "unused", "info")}
    assert {(r["routine_id"], r["metric"], r["severity"]) for r in E.diagnostics(m, edges).collect()} == want
    assert {(r["routine_id"], r["metric"]) for r in E.diagnostics(m, edges, E.thresholds({"complexity": (None, 99)}, {"lines": (50, 60)}), df([("a",)], "file string")).collect()} == {("r1", "complexity"), ("r1", "parameters"), ("r1", "unused")}
    with pytest.raises(ValueError):
        E.thresholds({"x": (1, 2)})
    ids = df([("r2",)], "routine_id string")
    assert {(r["caller"], tuple(r["places"])) for r in E.incoming_calls(edges, ids).collect()} == {("r1", ("c1",)), ("r3", ("c2", "c3"))} and E.outgoing_calls(edges, df([("r3",)], "routine_id string")).first()["callee"] == "r2"
    assert {r["routine_id"]: r["fan_in"] for r in E.code_lenses(m, edges).collect()} == {"r1": 0, "r2": 3, "r3": 0, "r4": 0}
    q = E.quality_report(m).first()
    assert (q["routines"], q["errors"], q["warnings"], q["most_complex"]) == (4, 1, 2, 11)
    decl = df([("a", "r1", 1, 0, 9, 0), ("a", "s1", 3, 0, 5, 0)], "file string, id string, start_line int, start_col int, end_line int, end_col int")
    pos = df([("a", 4, 0), ("a", 8, 0)], "file string, line int, col int")
    sub = E.subscription_at(pos, decl, df([("s1", "e", "p")], "subscriber_routine_id string, event_id string, publisher_routine_id string"))
    assert {r["line"]: r["event_id"] for r in sub.collect()} == {4: "e", 8: None}
    props = E.properties_at(pos, decl.where("id = 's1'").withColumn("properties", F.create_map(F.lit("Caption"), F.lit("x"))))
    assert {r["line"]: r["properties"] for r in props.collect()} == {4: {"Caption": "x"}, 8: None}
    assert E.publishers_in(df([("e", "r1")], "event_id string, publisher_routine_id string"), decl, df([("a",)], "file string")).count() == 1
    abi = df([("o", "Z", "procedure", "s"), ("o", "A", "procedure", "s"), ("p", "B", "procedure", "s")], "object_id string, name string, kind string, signature string")
    assert [r["name"] for r in E.dependency_symbols(abi, "o").collect()] == ["A", "Z"]


def test_saves(spark):
    df = spark.createDataFrame
    decl = "path string, id string, kind string, access string, signature string"
    before = df([("/w/a.al", "x", "procedure", None, "1"), ("/w/a.al", "y", "procedure", "local", "1"), ("/w/b.al", "z", "procedure", None, "1")], decl)
    after = df([("/w/a.al", "y", "procedure", "local", "2"), ("/w/a.al", "x", "procedure", None, "1"), ("/w/b.al", "z", "procedure", None, "2")], decl)
    ev = df([("/w/a.al", "saved"), ("/w/b.al", "saved"), ("/w/c.txt", "saved"), ("/w/.alpackages/x.app", "saved"), ("/v/a.al", "saved")], "path string, kind string")
    r = E.rungs(ev, E.surface_hash(before), E.surface_hash(after), "/w")
    assert {x["path"]: x["rung"] for x in r.collect()} == {"/w/a.al": 1, "/w/b.al": 2, "/w/c.txt": 0, "/w/.alpackages/x.app": 3, "/v/a.al": 0} and E.batch_rung(r) == 3 and E.batch_rung(r.where("false")) == 0
    files = df([("f1", "a"), ("f2", "b"), ("f3", "c")], "id string, file string")
    hit = E.affected_files(df([("f1", "f2")], "from string, to string"), df([("f1", "f3")], "from string, to string"), files, df([("a",)], "file string"))
    assert {x[0] for x in hit.collect()} == {"a", "b", "c"}
    found = df([("r", "a", "lines", 1, "info")], "routine_id string, file string, metric string, value long, severity string")
    assert {(x["file"], x["action"]) for x in E.partial_publish(df([("a", 1), ("b", 2)], "file string, hash long"), E.file_hashes(found), df([("a",), ("b",)], "file string")).collect()} == {("a", "publish"), ("b", "clear")}
    w = watcher_events(df([("a", 1, "created", "x"), ("b", 2, "deleted", "y"), ("c", 3, "touched", ""), (None, 4, "overflow", None)], "path string, seq long, change string, text string"))
    assert [(x["path"], x["kind"], x["text"]) for x in w.orderBy("seq").collect()] == [("a", "saved", "x"), ("b", "removed", None), (None, "overflow", None)]


def test_untouched_buckets_stay(spark, tmp_path):
    made = FactTable(spark, str(tmp_path / "t"), lambda f: f.select("path", F.length("text").alias("n")), "path string, n int", buckets=8)
    rows = [(f"p{i}", i, "saved", "x" * i) for i in range(40)]
    schema = "path string, seq long, kind string, text string"
    made.apply(spark.createDataFrame(rows, schema), 0)
    made.apply(spark.createDataFrame([("p3", 99, "saved", "y" * 77), ("p4", 99, "removed", None)], schema), 1)
    assert {r["path"]: r["n"] for r in made.current().collect()} == {f"p{i}": i for i in range(40) if i not in (3, 4)} | {"p3": 77}
    assert sum(v == 1 for v in made._manifest(1).values()) <= 2 and len(made._manifest(1)) >= 7
    for k in range(2, 5):
        made.apply(spark.createDataFrame([("p3", 99, "saved", "z" * k)], schema), k)
    assert made.current().where("path = 'p3'").first()["n"] == 4 and made.current().count() == 39
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.al").write_text("four")
    table = FactTable(spark, str(tmp_path / "u"), lambda f: f.select("path", F.length("text").alias("n")), "path string, n int")
    table.follow(file_events(spark, str(tmp_path / "src")), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["n"] for r in table.current().collect()] == [4]


def test_symbols(spark):
    doc = {"Tables": [{"Id": 18, "Name": "Customer"}], "Namespaces": [{"Name": "A", "Namespaces": [{"Name": "B", "Codeunits": [{"Id": 5, "Name": "Post", "Methods": [{"Name": "Run", "IsInternal": True, "Parameters": [{"Name": "R", "IsVar": True, "TypeDefinition": {"Name": "Record", "Subtype": {"Name": "Customer"}}}], "ReturnTypeDefinition": {"Name": "Boolean"}}]}]}]}]}
    entries = spark.createDataFrame([("p", "SymbolReference.json", json.dumps(doc) + "\x00"), ("q", "x/SymbolReference.json", "{"), ("p", "other", "{}")], "package string, entry string, text string")
    s = Y.package_symbols(entries)
    rows = [tuple(r) for r in s.collect()]
    assert ("p", "", "Table", 18, "Customer", None, None, None, None, None) in rows and [r[-1] is not None for r in rows].count(True) == 1
    run = s.where("routine = 'Run'").first()
    assert (run["namespace"], run["access"], tuple(run["parameters"][0]), run["return_type"]) == ("A.B", "internal", ("R", "Record Customer", True), "Boolean")
    assert {r["object_id"] for r in Y.symbol_objects(s).collect()} == {"p/Table/18", "p/Codeunit/5"} and Y.symbol_routines(s).first()["routine_id"] == "p/Codeunit/5#run#1"
    df = spark.createDataFrame
    dep = Y.with_implicit(df([("me", "d1", "D", "P", "1.0")], "app_guid string, dep_guid string, name string, publisher string, version string"), df([("me", "24.0", ""), ("base", "24.0", None)], "app_guid string, application string, platform string"), df([("application", "base", "Base", "M"), ("platform", "sys", "Sys", "M")], "tier string, dep_guid string, name string, publisher string"))
    assert {(r["app_guid"], r["dep_guid"], r["version"]) for r in dep.collect()} == {("me", "d1", "1.0"), ("me", "base", "24.0")}
    local = df([("1", "n", "p", "1.0"), ("2", "n", "p", "1.0"), ("1", None, "p", "1.0")], "id string, name string, publisher string, version string")
    assert Y.verified(local, df([("1", "n", "p", "1.0")], "id string, name string, publisher string, version string")).count() == 1
    cfg = Y.roots_config(df([("a/roots.config.json", '{"roots": [{"selector": "x", "kind": "job-queue"}]}'), ("b/roots.config.json", "{nope"), ("c.json", "{}")], "path string, text string"))
    assert {(r["selector"], r["problem"]) for r in cfg.collect()} == {("x", None), (None, "no list of roots")}
    art = Y.prune_status(df([("a", "h1", 2), ("b", "h2", 2), ("c", "h1", 1)], "path string, hash string, schema_version int"), df([("h1",)], "hash string"), 2)
    assert {r["path"]: r["status"] for r in art.collect()} == {"a": "keep", "b": "stale", "c": "outdated"}
    xml = '<Package xmlns="u"><App Id="1"/><InternalsVisibleTo><Module Id="g1" Name="N1"/></InternalsVisibleTo></Package>'
    assert [tuple(x) for x in Y.friend_manifest(df([("p", "NavxManifest.xml", xml)], "package string, entry string, text string")).first()["friends"]] == [("g1", "N1")]
    merged = Y.merged_fields(df([("t", 1, "f1", "A"), ("e2", 1, "f3", "C"), ("e1", 1, "f2", "B")], "table_id string, place int, field_id string, name string"), df([("t", "e1"), ("t", "e2")], "base_id string, extension_id string"))
    assert [x["field_id"] for x in merged.where("table_id = 't'").first()["fields"]] == ["f1", "f2", "f3"]
    assert Y.real_tables(df([("t", True, "stub"), ("t", False, "real")], "table_id string, is_stub boolean, name string")).first()["name"] == "real"
    assert Y.symbol_only(df([("p",), ("q",)], "package string"), df([("p",)], "package string")).first()[0] == "q"
