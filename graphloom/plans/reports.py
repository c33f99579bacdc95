"""Sinks for findings, snapshots and graphs.

Findings are bounded by their limit before they get here; a report streams them from
the plan in order (``toLocalIterator``), one partition on the driver at a time.
Snapshots and graphs are written by the executors.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.gate import SEVERITIES, severity_rank

#: SARIF levels by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def _plain(row) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc_nulls_last(), "detector", "file", "line", "fingerprint")


def rows_of(findings: DataFrame) -> Iterable[dict]:
    return map(_plain, ordered(findings).toLocalIterator())


def to_json(value) -> str:
    """Keys sorted, nulls dropped at any depth."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def json_report(findings: DataFrame, version: str, diagnostics: list[dict] = ()) -> str:
    rows = list(rows_of(findings))
    counts = {s: sum(r["severity"] == s for r in rows) for s in SEVERITIES}
    return to_json({"schemaVersion": "1.0.0", "version": version, "findings": rows, "summary": {"total": len(rows), **counts}, "diagnostics": list(diagnostics)})


def sarif_report(findings: DataFrame, tool: str, version: str) -> str:
    """SARIF 2.1.0 with one rule for each detector, partial fingerprints and 1-based places."""
    rows = list(rows_of(findings))
    rules = sorted({r["detector"] for r in rows})
    place = {r: i for i, r in enumerate(rules)}
    results = [
        {
            "ruleId": r["detector"], "ruleIndex": place[r["detector"]], "level": LEVELS.get(r["severity"], "none"), "message": {"text": r.get("message", r["detector"])},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"].replace("\\", "/")}, "region": {"startLine": max(1, int(r.get("line") or 1)), "startColumn": max(1, int(r.get("column") or 1))}}}] if r.get("file") else [],
            "partialFingerprints": {"primary": r["fingerprint"]} if r.get("fingerprint") else {}, "properties": {"severity": r["severity"], "confidence": r.get("confidence")},
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": [{"id": x} for x in rules]}}, "results": results, "columnKind": "utf16CodeUnits"}
    return to_json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def rolled_up(findings: DataFrame) -> DataFrame:
    """One row for each place and set of tables: the worst severity, and its detectors with theirs in order."""
    keys = ["file", "line", F.coalesce("column", F.lit(0)).alias("column") if "column" in findings.columns else F.lit(0).alias("column"), F.array_sort(F.coalesce("tables", F.array().cast("array<string>"))).alias("tables") if "tables" in findings.columns else F.array().cast("array<string>").alias("tables")]
    rank = severity_rank(F.col("severity"))
    return findings.groupBy(*keys).agg(F.max_by("severity", rank).alias("severity"), F.array_sort(F.collect_list(F.struct((-rank).alias("order"), "detector", "severity"))).alias("by")).withColumn("by", F.transform("by", lambda x: F.struct(x["detector"], x["severity"])))


def grouped_counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings by object, routine, table, detector or file: many first, then by name."""
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def merged_by_cause(findings: DataFrame, key: list[str]) -> DataFrame:
    """One finding for each root cause: the one of the shortest path (ties: least id), the tables and objects of all, and their number."""
    best = F.min_by(F.struct("id", "severity", "confidence", "path_length"), F.struct("path_length", "id")).alias("b")
    return findings.groupBy(*key).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_set("tables")))).alias("tables"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("objects")))).alias("objects"), F.count(F.lit(1)).alias("path_count")).select(*key, "b.*", "tables", "objects", "path_count")


def terminal_report(findings: DataFrame, coverage: dict | None = None) -> str:
    out = []
    for r in rows_of(findings):
        out.append(f"{r['severity']:<8} {r['detector']}  {r.get('file', '?')}:{r.get('line', 0)}" + (f"  {r['message']}" if r.get("message") else ""))
    out.append(f"{len(out)} finding{'' if len(out) == 1 else 's'}")
    if coverage:
        out.append("coverage: " + ", ".join(f"{k} {v}" for k, v in sorted(coverage.items())))
    return "\n".join(out) + "\n"


def html_report(findings: DataFrame, title: str) -> str:
    """One page without outside files."""
    rows = "".join(f"<tr class='{html.escape(r['severity'])}'>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in ("severity", "detector", "file", "line", "message")) + "</tr>" for r in rows_of(findings))
    style = "body{font:14px sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}.critical,.high{background:#fdd}.medium{background:#ffd}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><table><tr><th>severity</th><th>detector</th><th>file</th><th>line</th><th>message</th></tr>{rows}</table></body></html>"


def pr_summary(findings: DataFrame, limit: int = 20) -> str:
    """Markdown for a pull request: counts, then the first rows."""
    counts = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
    total = sum(counts.values())
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"### {total} finding{'' if total == 1 else 's'}", "", "| " + " | ".join(reversed(SEVERITIES)) + " |", "|" + "-|" * len(SEVERITIES), "| " + " | ".join(str(counts.get(s, 0)) for s in reversed(SEVERITIES)) + " |", ""]
    rows = [_plain(r) for r in ordered(findings).limit(limit).collect()]
    if rows:
        lines += ["| severity | detector | place |", "|-|-|-|"] + [f"| {cell(r['severity'])} | {cell(r['detector'])} | {cell(r.get('file', '?'))}:{r.get('line', 0)} |" for r in rows]
    if total > len(rows):
        lines.append(f"\n{total - len(rows)} more.")
    return "\n".join(lines) + "\n"


def diff_report(findings: DataFrame, form: str = "human") -> str:
    """Differences of two versions as text, JSON or SARIF."""
    from graphloom.plans.versions import diff_order

    rows = [_plain(r) for r in findings.orderBy(*diff_order()).toLocalIterator()]
    if form == "json":
        return to_json({"schemaVersion": "1.0.0", "findings": rows})
    if form == "sarif":
        results = [{"ruleId": r["kind"], "level": LEVELS.get(r["severity"], "none"), "message": {"text": f"{r['kind']}: {r['id']}"}, "partialFingerprints": {"primary": r.get("fingerprint")}} for r in rows]
        return to_json({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "diff", "rules": [{"id": k} for k in sorted({r["kind"] for r in rows})]}}, "results": results}]})
    return "".join(f"{r['severity']:<8} {r['kind']}  {r['id']}" + (f"  {r['secondary']}" if r.get("secondary") else "") + "\n" for r in rows) + f"{len(rows)} changes\n"


def policy_report(findings: DataFrame, summary: DataFrame, form: str = "json") -> str:
    rows = [_plain(r) for r in findings.orderBy("rule_id", "routine_id").toLocalIterator()]
    if form == "human":
        return "".join(f"{r['severity']:<8} {r['rule_id']}  {r['routine_id']}  {r['kind']}\n" for r in rows) + f"{len(rows)} findings\n"
    if form == "sarif":
        results = [{"ruleId": r["rule_id"], "level": LEVELS.get(r["severity"], "none"), "message": {"text": f"{r['kind']}: {r['routine_id']}"}} for r in rows]
        return to_json({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "policy"}}, "results": results}]})
    return to_json({"findings": rows, "rules": [_plain(r) for r in summary.orderBy("rule_id").collect()]})


# --- canonical CBOR (RFC 8949, deterministic encoding) -------------------------------


def _head(major: int, n: int) -> bytes:
    for size, code, form in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < size:
            return bytes([major << 5 | n]) if code is None else bytes([major << 5 | code]) + struct.pack(form, n)
    raise ValueError("integer beyond 64 bits")


def cbor(value) -> bytes:
    """Shortest heads, definite lengths, map keys in the order of their encodings."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        for form, mark in ((">e", 0xF9), (">f", 0xFA), (">d", 0xFB)):
            try:
                raw = struct.pack(form, value)
            except OverflowError:
                continue
            if struct.unpack(form, raw)[0] == value or value != value:
                return bytes([mark]) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, dict):
        items = sorted((cbor(k), cbor(v)) for k, v in value.items())
        return _head(5, len(items)) + b"".join(k + v for k, v in items)
    raise TypeError(f"no CBOR for {type(value).__name__}")


def uncbor(raw: bytes):
    """The one value of a document; anything after it, or a form that ``cbor`` does not write, is an error."""

    def take(at: int):
        if at >= len(raw):
            raise ValueError("CBOR ends early")
        major, low = raw[at] >> 5, raw[at] & 31
        at += 1
        if major == 7:
            if low in (20, 21, 22):
                return {20: False, 21: True, 22: None}[low], at
            if low in (25, 26, 27):
                size = {25: 2, 26: 4, 27: 8}[low]
                return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw[at : at + size])[0], at + size
            raise ValueError("unknown simple value")
        if low < 24:
            n = low
        elif low in (24, 25, 26, 27):
            size = 1 << (low - 24)
            n = int.from_bytes(raw[at : at + size], "big")
            at += size
        else:
            raise ValueError("indefinite length")
        if major == 0:
            return n, at
        if major == 1:
            return -1 - n, at
        if major in (2, 3):
            if at + n > len(raw):
                raise ValueError("CBOR ends early")
            part = raw[at : at + n]
            return (part if major == 2 else part.decode()), at + n
        if major == 4:
            out = []
            for _ in range(n):
                v, at = take(at)
                out.append(v)
            return out, at
        if major == 5:
            made = {}
            for _ in range(n):
                k, at = take(at)
                made[k], at = take(at)
            return made, at
        raise ValueError("tags are not used")

    value, end = take(0)
    if end != len(raw):
        raise ValueError("bytes after the value")
    return value


def read_snapshot(raw: bytes, hint: str | None = None) -> dict:
    """A snapshot in JSON, an envelope ``{"snapshot": ...}`` around it, or CBOR, each also gzipped."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    form = hint or ("json" if raw.lstrip()[:1] in (b"{", b"[") else "cbor")
    value = json.loads(raw) if form == "json" else uncbor(raw)
    if isinstance(value, dict) and set(value) >= {"snapshot"} and isinstance(value["snapshot"], dict):
        value = value["snapshot"]
    if not isinstance(value, dict):
        raise ValueError("a snapshot is a mapping")
    return value


def write_snapshot(tables: dict[str, DataFrame], path: str, app_column: str = "app_guid") -> None:
    """Each table as Parquet under ``path``, sliced by application where it has the column; the manifest is written last, so a whole snapshot has one."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        w = df.write.mode("overwrite")
        (w.partitionBy(app_column) if app_column in df.columns and len(df.columns) > 1 else w).parquet(f"{path}/{name}")
        rows.append((name, df.schema.json(), app_column in df.columns))
    spark.createDataFrame(rows, "name string, schema string, sliced boolean").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def load_snapshot(spark, path: str, app: str | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot; of one application's slices if it is named."""
    out = {}
    for r in spark.read.schema("name string, schema string, sliced boolean").json(f"{path}/_manifest").collect():
        df = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['name']}")
        out[r["name"]] = df.where(F.col("app_guid") == app) if app is not None and r["sliced"] else df
    return out


def node_link(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame, path: str, by: str | None = None) -> None:
    """A node-link graph as JSON lines: ``nodes``, ``edges`` and ``hyperedges``, in fragments by a column if given."""
    for name, df in (("nodes", nodes), ("edges", edges), ("hyperedges", hyperedges)):
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by and by in df.columns else w).json(f"{path}/{name}")


def pack_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables with a hash over their rows; returns it."""
    write_snapshot(tables, path)
    digest = tables_hash(tables)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(digest,)], "hash string").coalesce(1).write.mode("overwrite").json(f"{path}/_hash")
    return digest


def tables_hash(tables: dict[str, DataFrame]) -> str:
    """A hash of the rows of all tables, whatever their order."""
    h = hashlib.sha256()
    for name, df in sorted(tables.items()):
        cols = sorted(df.columns)
        row = df.select(F.xxhash64(F.to_json(F.struct(*cols))).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
        h.update(f"{name}|{','.join(cols)}|{row[0]}|{row[1]};".encode())
    return h.hexdigest()


class PackError(ValueError):
    pass


def load_pack(spark, path: str) -> dict[str, DataFrame]:
    """Tables of a pack whose hash agrees; PackError otherwise."""
    from pyspark.errors import AnalysisException

    try:
        want = spark.read.schema("hash string").json(f"{path}/_hash").first()
        tables = load_snapshot(spark, path)
    except AnalysisException as e:
        raise PackError(f"no whole pack at {path}") from e
    if want is None or tables_hash(tables) != want["hash"]:
        raise PackError("hash mismatch")
    return tables


def cached_by_hash(stage_root: str, key: str, spark, make) -> DataFrame:
    """A table kept under the hash of its inputs; a whole one is read back, anything less is made anew."""
    from pyspark.errors import AnalysisException

    path = f"{stage_root}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    try:
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.parquet(path)
    except AnalysisException:
        pass
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)

