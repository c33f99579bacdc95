"""What an editor asks: callers, callees, lenses, diagnostics, symbols at a place; and what a save sets off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.resolve import innermost_declaration
from graphloom.plans.versions import publish_or_clear

#: Warning and error thresholds of a routine's measures; fan-in has one.
THRESHOLDS = {"complexity": (5, 10), "lines": (20, 50), "parameters": (4, 7), "fan_in": (20, None)}


def thresholds(*layers: dict) -> dict:
    """The defaults overlaid by configurations, the last one strongest; what a layer leaves out stays."""
    out = dict(THRESHOLDS)
    for layer in layers:
        for k, v in (layer or {}).items():
            if k not in out:
                raise ValueError(f"unknown measure {k}")
            out[k] = tuple(b if a is None else a for a, b in zip(v, out[k]))
    return out


def item_at(positions: DataFrame, declarations: DataFrame) -> DataFrame:
    """The innermost declaration at each position."""
    return innermost_declaration(positions, declarations)


def incoming_calls(edges: DataFrame, routine_ids: DataFrame) -> DataFrame:
    """(routine_id, caller, places) of the routines asked for."""
    e = edges.join(routine_ids.select(F.col("routine_id").alias("to")), "to", "left_semi")
    return e.groupBy(F.col("to").alias("routine_id"), F.col("from").alias("caller")).agg(F.array_sort(F.collect_list("callsite_id")).alias("places"))


def outgoing_calls(edges: DataFrame, routine_ids: DataFrame) -> DataFrame:
    e = edges.join(routine_ids.select(F.col("routine_id").alias("from")), "from", "left_semi")
    return e.groupBy(F.col("from").alias("routine_id"), F.col("to").alias("callee")).agg(F.array_sort(F.collect_list("callsite_id")).alias("places"))


def fan_in(edges: DataFrame) -> DataFrame:
    """(routine_id, fan_in): calls and event deliveries that arrive."""
    return edges.groupBy(F.col("to").alias("routine_id")).agg(F.count(F.lit(1)).alias("fan_in"))


def code_lenses(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """``metrics(routine_id, file, ...)`` with the number of references to each."""
    return metrics.join(fan_in(edges), "routine_id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))


def threshold_findings(metrics: DataFrame, limits: dict | None = None) -> DataFrame:
    """(routine_id, file, metric, value, severity) of every measure at or over its threshold."""
    rows = []
    for name, (warn, error) in (limits or THRESHOLDS).items():
        if name in metrics.columns:
            c = F.col(name).cast("long")
            severity = F.when(c >= error, "error") if error is not None else F.when(F.lit(False), "error")
            rows.append(F.when(c >= warn, F.struct(F.lit(name).alias("metric"), c.alias("value"), severity.when(c >= warn, "warning").alias("severity"))))
    return metrics.select("routine_id", "file", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("routine_id", "file", "x.*")


def unused_procedures(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Procedures (not triggers, subscribers or test procedures) that nothing refers to."""
    own = metrics.where("kind = 'procedure' and not coalesce(is_test, false)")
    free = own.join(edges.select(F.col("to").alias("routine_id")).distinct(), "routine_id", "left_anti")
    return free.select("routine_id", "file", F.lit("unused").alias("metric"), F.lit(0).cast("long").alias("value"), F.lit("info").alias("severity"))


def diagnostics(metrics: DataFrame, edges: DataFrame, limits: dict | None = None, files: DataFrame | None = None) -> DataFrame:
    """All diagnostics, or those of some files; edges are counted whole either way."""
    own = metrics if files is None else metrics.join(files.select("file").distinct(), "file", "left_semi")
    return threshold_findings(code_lenses(own, edges), limits).unionByName(unused_procedures(own, edges))


def file_hashes(found: DataFrame) -> DataFrame:
    """(file, hash) of each file's diagnostics, whatever their order."""
    return found.groupBy("file").agg(F.sum(F.xxhash64("routine_id", "metric", "value", "severity").cast("decimal(38,0)")).alias("hash"))


def partial_publish(before: DataFrame, now: DataFrame, touched: DataFrame) -> DataFrame:
    """What to publish and clear after some files were computed anew; other files stay as they are."""
    t = touched.select("file").distinct()
    return publish_or_clear(before.join(t, "file", "left_semi"), now.join(t, "file", "left_semi"))


def quality_report(metrics: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row: routines, averages, and counts of findings by severity."""
    found = threshold_findings(metrics, limits).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    own = metrics.agg(F.count(F.lit(1)).alias("routines"), F.avg("complexity").alias("average_complexity"), F.avg("lines").alias("average_lines"), F.max("complexity").alias("most_complex"))
    return own.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").drop("_k")


def dependency_symbols(abi: DataFrame, object_id: str) -> DataFrame:
    return abi.where(F.col("object_id") == object_id).select("name", "kind", "signature").orderBy("kind", "name")


def publishers_in(events: DataFrame, declarations: DataFrame, files: DataFrame) -> DataFrame:
    d = declarations.join(files.select("file"), "file", "left_semi")
    return events.join(d.select(F.col("id").alias("publisher_routine_id"), "file", "start_line"), "publisher_routine_id")


def subscription_at(positions: DataFrame, declarations: DataFrame, edges: DataFrame) -> DataFrame:
    """What the subscriber at each position subscribes to."""
    return item_at(positions, declarations).join(edges.select(F.col("subscriber_routine_id").alias("id"), "event_id", "publisher_routine_id"), "id", "left")


def properties_at(positions: DataFrame, members: DataFrame) -> DataFrame:
    """Properties of the field or action at each position, ``members(file, id, start_line, ..., properties map<string, string>)``."""
    return item_at(positions, members).join(members.select("id", "properties"), "id", "left")


# --- saves -------------------------------------------------------------------------

RELOAD, REBUILD, RESTART = 1, 2, 3


def path_class(path: Column, root: str) -> Column:
    """workspace for sources under the root, dependency for packages and the manifest, ignored for all else."""
    below = path.startswith(root.rstrip("/") + "/")
    low = F.lower(path)
    return F.when(~below, "ignored").when(low.rlike(r"/\.alpackages/[^/]*\.app$") | low.endswith("/app.json"), "dependency").when(low.endswith(".al") & ~low.contains("/.alpackages/"), "workspace").otherwise("ignored")


def surface_hash(declarations: DataFrame) -> DataFrame:
    """(path, surface) of what other files can see of each: ``declarations(path, id, kind, access, signature)`` that are not local, in any order."""
    seen = declarations.where("coalesce(access, 'public') <> 'local'")
    own = seen.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "kind", "access", "signature").cast("decimal(38,0)")).alias("h"))
    return declarations.select("path").distinct().join(own, "path", "left").select("path", F.sha2(F.concat_ws("|", F.coalesce("n", F.lit(0)), F.coalesce("h", F.lit(0).cast("decimal(38,0)"))), 256).alias("surface"))


def rungs(events: DataFrame, before: DataFrame, after: DataFrame, root: str) -> DataFrame:
    """``events(path, kind)`` with the least work that each asks for: RELOAD its facts, REBUILD the workspace if what others see of it changed, RESTART for dependencies and overflow."""
    e = events.withColumn("class", path_class(F.col("path"), root))
    j = e.join(before.select("path", F.col("surface").alias("a")), "path", "left").join(after.select("path", F.col("surface").alias("b")), "path", "left")
    rung = F.when((F.col("kind") == "overflow") | (F.col("class") == "dependency"), RESTART).when(F.col("class") == "ignored", 0).when(F.col("a").eqNullSafe(F.col("b")) & (F.col("kind") != "removed"), RELOAD).otherwise(REBUILD)
    return j.select("path", "kind", "class", rung.alias("rung"))


def batch_rung(with_rungs: DataFrame) -> int:
    """A batch takes its highest rung; 0 asks for nothing."""
    return with_rungs.agg(F.coalesce(F.max("rung"), F.lit(0))).first()[0]


def affected_files(edges_before: DataFrame, edges_after: DataFrame, declarations: DataFrame, saved: DataFrame) -> DataFrame:
    """Files whose diagnostics a save may change: the saved ones, and those that declare a callee that gained or lost a caller."""
    a, b = edges_before.select("from", "to").distinct(), edges_after.select("from", "to").distinct()
    moved = a.join(b, ["from", "to"], "left_anti").union(b.join(a, ["from", "to"], "left_anti")).select(F.col("to").alias("id")).distinct()
    return declarations.join(moved, "id", "left_semi").select("file").union(saved.select("file")).distinct()
