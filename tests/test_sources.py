import io
import json
import zipfile

import pytest

from graphloom.sources import packages
from graphloom.sources.packages import app_manifest, first_provider, manifests, package_folders, read_packages, read_sources
from graphloom.sources.text_facts import read_baseline, suppressions, unified_hunks, write_baseline
from graphloom.streaming.incremental import FactTable
from pyspark.sql import functions as F


def package(path, entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    path.write_bytes(b"NAVX".ljust(packages.HEADER, b"\0") + buf.getvalue())


def test_folders_and_packages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".alpackages").mkdir()
    (tmp_path / "src/a.al").write_bytes(b"\xef\xbb\xbfcodeunit 1 A {}")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / ".alpackages/c.al").write_text("no")
    xml = '<Package xmlns="http://schemas.example/2015"><App Id="i1" Name="Base" Publisher="P" Version="1.2.0.0"/><Dependencies><Dependency Id="d1" Name="Sys" MinVersion="1.0.0.0"/></Dependencies></Package>'
    package(tmp_path / ".alpackages/x.app", {"src/My%20Unit.al": "codeunit 2 B {}", "NavxManifest.xml": xml, "logo.png": "x"})
    (tmp_path / ".alpackages/bad.app").write_bytes(b"NAVX")
    got = read_sources(spark, str(tmp_path)).collect()
    assert [r["text"] for r in got] == ["codeunit 1 A {}"] and got[0]["path"].endswith("src/a.al")
    folders = package_folders(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[-1] for f in folders] == [".alpackages"] and read_packages(spark, []).isEmpty()
    rows = {(r["package"].rsplit("/", 1)[-1], r["entry"]): r for r in read_packages(spark, folders).collect()}
    assert set(rows) == {("x.app", "src/My Unit.al"), ("x.app", "NavxManifest.xml"), ("bad.app", None)}
    assert rows["x.app", "src/My Unit.al"]["text"] == "codeunit 2 B {}" and rows["bad.app", None]["problem"].startswith("no package")
    m = manifests(read_packages(spark, folders)).first()
    assert (m["id"], m["name"], m["version"]) == ("i1", "Base", "1.2.0.0") and [tuple(d) for d in m["dependencies"]] == [("d1", "Sys", "1.0.0.0")]


def test_entry_over_its_cap(spark, tmp_path, monkeypatch):
    package(tmp_path / "x.app", {"a.al": "x" * 50})
    monkeypatch.setattr(packages, "SOURCE_CAP", 10)
    ((entry, kind, text, problem),) = packages._entries((tmp_path / "x.app").read_bytes())
    assert (entry, kind, text, problem) == ("a.al", "source", None, "over 10 bytes")


def test_manifest_and_providers(spark):
    app = {"id": "i", "name": "N", "version": "1.0.0.0", "dependencies": [{"id": "d", "version": "2.0.0.0"}], "extra": 1}
    got = app_manifest(spark.createDataFrame([("ws/app.json", json.dumps(app)), ("ws/x.json", "{}")], "path string, text string")).collect()
    assert len(got) == 1 and got[0]["app"]["dependencies"][0]["version"] == "2.0.0.0"
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 3, "w")], "app string, prio int, f string")
    assert sorted(r["f"] for r in first_provider(rows, "app", "prio").collect()) == ["w", "y", "z"]


def test_directives_and_hunks(spark):
    text = "x\ny // al-sem-ignore d1-db: known\n//al-sem-ignore  d2 // al-sem-ignore d3\n// al-sem-ignore\n"
    got = suppressions(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string")).collect()
    assert {tuple(r) for r in got} == {("p", "d1-db", 2, "known"), ("p", "d2", 3, None)}
    diff = "diff --git a/x.al b/x.al\r\n--- a/x.al\r\n+++ b/x.al\r\n@@ -1,2 +3,4 @@ f\r\n-a\r\n+b\r\n@@ -9 +11 @@\r\n--- a/y.al\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- /dev/null\n+++ b/z.al\n@@ -0,0 +1,2 @@\n"
    rows = unified_hunks(spark.createDataFrame([("d", diff), ("e", "")], "diff string, text string")).collect()
    assert {tuple(r)[1:] for r in rows} == {("x.al", "modified", 1, 2, 3, 4), ("x.al", "modified", 9, 1, 11, 1), ("y.al", "deleted", 1, 3, 0, 0), ("z.al", "added", 0, 0, 1, 2)}


def test_baseline(spark, tmp_path):
    assert read_baseline(spark, str(tmp_path / "none.json")).isEmpty()
    write_baseline(spark.createDataFrame([("b",), ("a",), ("b",)], "fingerprint string"), str(tmp_path / "base"))
    assert sorted(r[0] for r in read_baseline(spark, str(tmp_path / "base")).collect()) == ["a", "b"]
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_baseline(spark, str(tmp_path / "bad.json")).collect()


def test_stream_of_file_events(spark, tmp_path):
    schema = "path string, seq long, kind string, text string"
    batches = [[("a", 1, "saved", "x y"), ("b", 2, "saved", "z"), ("a", 0, "saved", "old")], [("b", 3, "saved", "q r"), ("c", 4, "saved", "s"), ("c", 5, "removed", None)], [("a", 6, "removed", None)]]
    words = lambda files: files.select("path", F.explode(F.split("text", " ")).alias("word"))
    table = FactTable(spark, str(tmp_path / "facts"), words, "path string, word string")
    assert table.current().isEmpty()
    want = [{("a", "x"), ("a", "y"), ("b", "z")}, {("a", "x"), ("a", "y"), ("b", "q"), ("b", "r")}, {("b", "q"), ("b", "r")}]
    for rows, facts in zip(batches, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        table.follow(events, str(tmp_path / "checkpoint")).awaitTermination(60)
        assert {tuple(r) for r in table.current().collect()} == facts
    before = table.version()
    table.apply(spark.createDataFrame(batches[0], schema), before)  # a batch that is run again changes nothing
    assert {tuple(r) for r in table.current().collect()} == want[-1]
