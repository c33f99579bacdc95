import gzip
import json

import pytest

from graphloom.operators import walks as K
from graphloom.plans import policy as P
from graphloom.plans import reports as S
from graphloom.plans import versions as V
from graphloom.storage import Stage
from pyspark.sql import functions as F


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "f"), ("f", "a"), ("g", "d"), ("b", "f")], "src string, dst string")
    paths = K.shortest_paths(spark.createDataFrame([("r", "a")], "root string, node string"), edges, Stage(spark, "t"), k=2)
    got = {(r["node"], r["rank"]): r["path"] for r in paths.collect()}
    assert got[("d", 1)] == ["a", "b", "d"] and got[("d", 2)] == ["a", "c", "d"] and ("d", 3) not in got and got[("f", 1)] == ["a", "b", "f"] and got[("f", 2)] == ["a", "b", "d", "f"] and got[("a", 1)] == ["a"]
    w = K.witnesses(paths, spark.createDataFrame([("d", "x"), ("f", "x")], "node string, fact string"), 3)
    assert [r["path"] for r in w.orderBy("place").collect()] == [["a", "b", "d"], ["a", "b", "f"], ["a", "c", "d"]]
    walk = K.evidence_walk(spark.createDataFrame([("r", "a"), ("s", "g")], "root string, node string"), edges, spark.createDataFrame([("d",)], "node string"), Stage(spark, "t"))
    assert {(r["root"], r["stop"], r["path"][-1]) for r in walk.collect()} == {("r", "Complete", "d"), ("r", "Cycle", "a"), ("s", "Complete", "d")}
    deep = K.evidence_walk(spark.createDataFrame([("r", "g")], "root string, node string"), edges, spark.createDataFrame([("z",)], "node string"), Stage(spark, "t"), max_depth=2)
    assert [(r["stop"], r["path"]) for r in deep.collect()] == [("Depth", ["g", "d", "f"])]
    best = K.rank_witnesses(spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "0")], "k int, n int, s string"), ["k"], [F.col("n"), F.col("s")])
    assert [tuple(r) for r in best.collect()] == [(1, 2, "a")]


def test_chains(spark):
    flow = spark.createDataFrame([("e1", "e2"), ("e2", "e3"), ("e3", "e1"), ("e2", "e4"), ("e4", "e5")], "event_id string, next_event_id string")
    c = K.event_chains(spark.createDataFrame([("e1",), ("e5",)], "event_id string"), flow, Stage(spark, "t"), max_depth=3)
    got = {(r["root"], tuple(r["path"])): r["stop"] for r in c.collect()}
    assert got == {("e1", ("e1",)): "none", ("e1", ("e1", "e2")): "none", ("e1", ("e1", "e2", "e3")): "none", ("e1", ("e1", "e2", "e4")): "none", ("e1", ("e1", "e2", "e3", "e1")): "cycle", ("e1", ("e1", "e2", "e4", "e5")): "none", ("e5", ("e5",)): "none"}
    assert {r["root"]: (r["depth"], r["steps"], r["cycles"]) for r in K.chain_report(c).collect()} == {"e1": (3, 6, 1), "e5": (0, 1, 0)}
    few = K.event_chains(spark.createDataFrame([("e1",)], "event_id string"), flow, Stage(spark, "t"), max_depth=2, max_nodes=3)
    assert [r["stop"] for r in few.orderBy("depth", "path").collect()] == ["none", "none", "depth"]
    gaps = K.gaps_in_cones(spark.createDataFrame([("r", "x", "a1"), ("r", "y", "a2"), ("s", "z", "a1")], "root string, node string, app_guid string"), spark.createDataFrame([("x",), ("a1",)], "subject string"))
    assert {r["root"]: r["gaps"] for r in gaps.collect()} == {"r": 2, "s": 1}


DOC = {
    "defaults": {"coverage": "any", "on_unknown": "fail-closed"},
    "rules": [
        {"id": "no-http", "severity": "high", "when": {"all": [{"routine.kind": "trigger"}, {"capability.op": ["send"]}]}, "except": {"object.name": {"glob": "Allowed*"}}},
        {"id": "sure", "when": {"capability.resourceId": {"equals": "t1"}}, "coverage": "complete"},
        {"id": "soft", "when": {"not": {"capability.via": "direct"}}, "on_unknown": "skip", "coverage": "partial"},
    ],
}


def test_policy(spark):
    df = spark.createDataFrame
    routines = df([("r1", "trigger", "Bad"), ("r2", "trigger", "allowed one"), ("r3", "procedure", "X"), ("r4", "trigger", "Y")], "routine_id string, kind string, object string")
    facts = df([("r1", "f1", "send", "t1", "direct"), ("r1", "f2", "send", None, None), ("r2", "f3", "send", "t1", "inherited"), ("r3", "f4", "send", None, "direct")], "routine_id string, fact_id string, op string, resource string, via string")
    cover = df([("r1", "complete"), ("r2", "complete"), ("r3", "complete"), ("r4", "unknown")], "routine_id string, status string")
    rf = {"routine.kind": F.col("kind"), "object.name": F.col("object")}
    ff = {"capability.op": F.col("op"), "capability.resourceId": F.col("resource"), "capability.via": F.col("via")}
    found, summary = P.run_policy(P.load(DOC), routines, facts, cover, rf, ff)
    got = {(r["rule_id"], r["routine_id"]): (r["kind"], r["facts"]) for r in found.collect()}
    assert got == {("no-http", "r1"): ("match", ["f1", "f2"]), ("sure", "r1"): ("match", ["f1"]), ("sure", "r2"): ("match", ["f3"]), ("sure", "r3"): ("unknown", []), ("sure", "r4"): ("coverage", []), ("soft", "r2"): ("match", ["f3"])}
    assert {r["rule_id"]: (r["evaluated"], r["matched"], r["skipped_coverage"], r["skipped_unknown"], r["passed"]) for r in summary.collect()} == {"no-http": (4, 1, 0, 0, 1), "sure": (4, 2, 1, 1, 0), "soft": (4, 1, 1, 1, 1)}
    assert [r["id"] for r in P.explain(DOC)] == ["no-http", "soft", "sure"] and P.explain(DOC)[0]["when"]["all"][1] == {"capability.op": {"in": ["send"]}}
    text = S.policy_report(found, summary)
    assert len(json.loads(text)["findings"]) == 6 and "6 findings" in S.policy_report(found, summary, "human") and json.loads(S.policy_report(found, summary, "sarif"))["version"] == "2.1.0"
    assert P.load(json.dumps(DOC)) == DOC
    with pytest.raises(P.PolicyError) as e:
        P.load({"rules": [{"id": "a", "when": {"x.y": 1}}, {"id": "a", "severity": "odd", "coverage": "some", "when": {"all": []}}, {"when": {}}]})
    assert len(e.value.problems) == 6 and "unknown field x.y" in e.value.problems[0]
    with pytest.raises(P.PolicyError):
        P.load("]")


def side(spark, **rows):
    kinds = {"abi": "routine_id string, visibility string, signature string, obsolete string", "schema": "field_id string, shape string, classification string", "enums": "value_id string, ordinal int", "events": "event_id string, signature string", "capabilities": "routine_id string, capability string, class string", "permissions": "object_id string, rights array<string>", "coverage": "routine_id string, status string"}
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in kinds.items()}


def test_versions(spark):
    old = side(spark, abi=[("r1", "public", "s", None), ("r2", "public", "s", "no"), ("r3", "local", "s", None), ("r4", "public", "s", "pending"), ("was", "public", "s", None)], schema=[("f1", "int", "CustomerContent"), ("f2", "int", None), ("f3", "x", "AccountData")], enums=[("e1", 1), ("e2", 2)], events=[("v1", "s"), ("v2", "s")],
               capabilities=[("r1", "c1", "x"), ("r2", "c2", "x")], permissions=[("o1", ["r", "w"]), ("o2", ["r"]), ("o4", ["r"])], coverage=[("r1", "complete"), ("r2", "complete")])
    new = side(spark, abi=[("r1", "internal", "t", "removed"), ("r3", "local", "z", None), ("r4", "public", "s", "no"), ("r5", "public", "s", None), ("is", "public", "s", None)], schema=[("f1", "long", "SystemMetadata"), ("f4", "x", None), ("f3", "x", "CustomerContent")], enums=[("e1", 3), ("e3", 9)], events=[("v1", "t"), ("v3", "s")],
               capabilities=[("r1", "c9", "x")], permissions=[("o1", ["r", "x"]), ("o3", ["r"]), ("o4", ["r"])], coverage=[("r1", "complete"), ("r2", "partial")])
    renames = spark.createDataFrame([("was", "is"), ("gone", "x"), ("f1", "q1"), ("q1", "q2"), ("v1", "w"), ("v2", "w")], "from_id string, to_id string")
    found, notes = V.compare(old, new, renames)
    want = {
        ("visibility-narrowed", "r1"), ("signature-changed", "r1"), ("obsoletion-progressed", "r1"), ("routine-removed", "r2"), ("obsoletion-regressed", "r4"), ("routine-added", "r5"),
        ("table-field-type-narrowed", "f1"), ("data-classification-weakened", "f1"), ("table-field-removed", "f2"), ("table-field-added", "f4"), ("data-classification-strengthened", "f3"),
        ("enum-value-renumbered", "e1"), ("enum-value-removed", "e2"), ("enum-value-added", "e3"), ("event-signature-changed", "v1"), ("event-removed", "v2"), ("event-added", "v3"),
        ("capability-gained", "r1"), ("capability-lost", "r1"), ("capability-lost-under-coverage", "r2"), ("permission-expanded", "o1"), ("permission-contracted", "o1"), ("permission-target-removed", "o2"), ("permission-target-added", "o3"),
    }
    assert {(r["kind"], r["id"]) for r in found.collect()} == want
    assert {(r["diagnostic"], r["id"]) for r in notes.collect()} == {("rename-stale", "gone"), ("rename-chain", "f1"), ("rename-chain", "q1"), ("rename-overlap", "v1"), ("rename-overlap", "v2")}
    strict, dropped = V.compare(old, new, renames, strict=True)
    assert {r["kind"] for r in strict.where("category = 'capability'").collect()} == {"capability-gained", "capability-lost"} and [r["id"] for r in dropped.where("kind <> 'rename'").collect()] == ["r2"]
    assert found.select("fingerprint").distinct().count() == len(want)
    assert {r["category"]: r["total"] for r in V.summary(found).collect()} == {"abi": 6, "schema": 8, "event": 3, "capability": 3, "permission": 4}
    lines = S.diff_report(found).splitlines()
    assert lines[-1] == "24 changes" and lines[0].startswith("high") and json.loads(S.diff_report(found, "json"))["findings"][0]["severity"] == "high"
    assert V.compatible({"schema_version": 1, "driver_version": "2.1", "app_guid": "a"}, {"schema_version": 1, "driver_version": "2.9", "app_guid": "a"}) == [] and len(V.compatible({"schema_version": 1}, {"schema_version": 2, "app_guid": "b"})) == 2
    d = V.publish_or_clear(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, hash int"), spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "file string, hash int"))
    assert {r["file"]: r["action"] for r in d.collect()} == {"b": "publish", "c": "clear", "d": "publish"}
    ev = V.event_capability_changes(spark.createDataFrame([("e", "x")], "event_id string, capability string"), spark.createDataFrame([("e", "y")], "event_id string, capability string"))
    assert {r["kind"] for r in ev.collect()} == {"event-capability-gained", "event-capability-lost"}


def test_reports(spark, tmp_path):
    f = spark.createDataFrame(
        [("d2", "high", "likely", "a.al", 3, 1, "f1", "say <b>", ["t1"]), ("d10", "info", "likely", "b.al", 1, 0, "f2", None, ["t2"]), ("d1", "critical", "likely", "a.al", 3, 1, "f3", "x|y", ["t1"])],
        "detector string, severity string, confidence string, file string, line int, column int, fingerprint string, message string, tables array<string>",
    )
    sarif = json.loads(S.sarif_report(f, "tool", "1"))["runs"][0]
    assert [r["ruleId"] for r in sarif["results"]] == ["d1", "d2", "d10"] and [r["level"] for r in sarif["results"]] == ["error", "error", "note"] and sarif["results"][2]["locations"][0]["physicalLocation"]["region"]["startColumn"] == 1
    report = json.loads(S.json_report(f, "1"))
    assert report["summary"] == {"total": 3, "info": 1, "low": 0, "medium": 0, "high": 1, "critical": 1} and "message" not in report["findings"][2]
    assert S.terminal_report(f).splitlines()[-1] == "3 findings" and "say &lt;b&gt;" in S.html_report(f, "T") and "| critical | d1 | a.al:3 |" in S.pr_summary(f, 1) and "2 more." in S.pr_summary(f, 1)
    r = {(x["file"], x["line"]): (x["severity"], [y["detector"] for y in x["by"]]) for x in S.rolled_up(f).collect()}
    assert r == {("a.al", 3): ("critical", ["d1", "d2"]), ("b.al", 1): ("info", ["d10"])}
    assert [tuple(x) for x in S.grouped_counts(f, "file").collect()] == [("a.al", 2), ("b.al", 1)]
    causes = spark.createDataFrame([("k", "i2", "high", "likely", 2, ["t2"], ["o1"]), ("k", "i1", "low", "likely", 2, ["t1"], ["o1"]), ("k", "i0", "low", "likely", 5, ["t1"], ["o2"])], "cause string, id string, severity string, confidence string, path_length int, tables array<string>, objects array<string>")
    m = S.merged_by_cause(causes, ["cause"]).first()
    assert (m["id"], m["tables"], m["objects"], m["path_count"]) == ("i1", ["t1", "t2"], ["o1", "o2"], 3)


def test_cbor_and_snapshots(spark, tmp_path):
    value = {"b": [1, -1, 23, 24, 300, 1 << 40, -500], "a": {"x": None, "y": True, "z": 1.5, "w": 0.1}, "text": "é", "raw": b"\x00\x01"}
    assert S.uncbor(S.cbor(value)) == value and S.cbor(24) == b"\x18\x18" and S.cbor(1.5) == b"\xf9\x3e\x00" and S.cbor({"bb": 1, "a": 2}) == b"\xa2\x61a\x02\x62bb\x01"
    for bad in (b"\x9f", b"\x18", b"\x01\x01", b"\x62a"):
        with pytest.raises(ValueError):
            S.uncbor(bad)
    doc = {"schema_version": 1, "facts": []}
    for raw in (json.dumps(doc).encode(), json.dumps({"snapshot": doc}).encode(), S.cbor(doc), gzip.compress(S.cbor(doc))):
        assert S.read_snapshot(raw) == doc
    t = {"facts": spark.createDataFrame([("a", 1), ("b", 2)], "app_guid string, x int"), "apps": spark.createDataFrame([("n",)], "name string")}
    S.write_snapshot(t, f"{tmp_path}/s")
    assert S.load_snapshot(spark, f"{tmp_path}/s", "b")["facts"].collect() == [("b", 2)] or [r["x"] for r in S.load_snapshot(spark, f"{tmp_path}/s", "b")["facts"].collect()] == [2]
    S.pack_tables(t, f"{tmp_path}/p")
    assert S.load_pack(spark, f"{tmp_path}/p")["apps"].count() == 1
    spark.createDataFrame([("m",)], "name string").write.mode("overwrite").parquet(f"{tmp_path}/p/apps")
    with pytest.raises(S.PackError):
        S.load_pack(spark, f"{tmp_path}/p")
    with pytest.raises(S.PackError):
        S.load_pack(spark, f"{tmp_path}/none")
    made = []
    for _ in range(2):
        df = S.cached_by_hash(f"{tmp_path}/c", "k1", spark, lambda: made.append(1) or t["apps"])
        assert [r["name"] for r in df.collect()] == ["n"]
    assert len(made) == 1
    S.node_link(t["facts"], t["facts"], t["apps"], f"{tmp_path}/g", "app_guid")
    assert spark.read.json(f"{tmp_path}/g/nodes").count() == 2
