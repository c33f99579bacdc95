"""Composed answers: questions with three answers, digests, preflight, changed roots.

An entry is one root: ``effects(root, effect_type, resource, conditionality, occurrence_id)`` and
``obligations(root, unresolved, open_world, gaps, coverage, truncated)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import folded
from graphloom.operators.capabilities import effect_type
from graphloom.operators.closure import reach_from
from graphloom.storage import Stage

UNCONDITIONAL = "unconditional-on-success"
_BARE = ("may-commit", "commits-on-success-path", "reaches-ui", "throws-error")
_NAMED = ("writes-table", "publishes-event")


@dataclass(frozen=True)
class Question:
    kind: str
    subject: str | None = None


def parse_question(text: str) -> Question:
    """One of six forms; two of them name a table or an event after a colon."""
    kind, _, subject = text.strip().partition(":")
    if kind in _BARE and not _:
        return Question(kind)
    if kind in _NAMED and subject.strip():
        return Question(kind, subject.strip())
    raise ValueError(f"no question: {text}")


def _matches(q: Question) -> Column:
    t = F.col("effect_type")
    if q.kind in ("may-commit", "commits-on-success-path"):
        return t == "COMMIT"
    if q.kind == "reaches-ui":
        return t.startswith("UI_")
    if q.kind == "throws-error":
        return t == "ERROR_THROW"
    same = F.coalesce(folded(F.col("resource")) == folded(F.lit(q.subject)), F.lit(False))
    return same & (t.startswith("DB_") if q.kind == "writes-table" else t == "EVENT_PUBLISH")


def prove(effects: DataFrame, obligations: DataFrame, question: Question) -> DataFrame:
    """(root, answer, evidence, blockers) for every root of ``obligations``.

    May-questions: any match is yes; no needs all obligations clear. The question
    of the success path: yes needs an unconditional commit and all clear, no needs no commit at all and all clear.
    """
    e = effects.where(_matches(question)).groupBy("root").agg(
        F.array_sort(F.collect_set("occurrence_id")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("conditionality") == UNCONDITIONAL, F.col("occurrence_id")))).alias("sure"), F.count_if(F.col("conditionality") != UNCONDITIONAL).alias("unsure")
    )
    o = obligations.join(e, "root", "left")
    none = F.array().cast("array<string>")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    found, sure = F.coalesce("all", none), F.coalesce("sure", none)
    whole = F.coalesce(F.col("coverage") == "complete", F.lit(False))
    clear = (n("unresolved") == 0) & (n("open_world") == 0) & (n("gaps") == 0) & whole & ~F.coalesce("truncated", F.lit(False))
    must = question.kind == "commits-on-success-path"
    if must:
        answer = F.when((F.size(sure) > 0) & clear, "yes").when((F.size(found) == 0) & clear, "no").otherwise("unknown")
        evidence = F.when(answer == "yes", sure).when(answer == "no", none).otherwise(found)
    else:
        answer = F.when(F.size(found) > 0, "yes").when(clear, "no").otherwise("unknown")
        evidence = found
    tests = [("unresolved-callsites", n("unresolved") > 0), ("open-world", n("open_world") > 0), ("analysis-gaps", n("gaps") > 0), ("coverage-incomplete", ~whole), ("cone-truncated", F.coalesce("truncated", F.lit(False)))]
    if must:
        tests.append(("non-unconditional-effect-exists", n("unsure") > 0))
    blockers = F.array_sort(F.array_compact(F.array(*(F.when(c, name) for name, c in tests))))
    return o.select("root", answer.alias("answer"), evidence.alias("evidence"), F.when(answer == "unknown", blockers).otherwise(none).alias("blockers"))


def occurrence_ids(effects: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """With an id for the n-th effect of each key, the same on every run."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return effects.withColumn("occurrence_id", F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), n), 256), 1, 16))


def digest(roots: DataFrame, inherited: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Effects of each root with its best witness paths: ``inherited`` facts that are effects, ``witnesses(root, fact, place, path)``."""
    e = inherited.withColumn("effect_type", effect_type(F.col("op"))).where("effect_type is not null").join(roots.select(F.col("root").alias("routine_id")), "routine_id", "left_semi")
    e = e.groupBy(F.col("routine_id").alias("root"), "effect_type", F.col("resource_id").alias("resource")).agg(F.min("dist").alias("dist"))
    w = witnesses.groupBy("root", F.col("fact").alias("resource")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    out = e.join(w, ["root", "resource"], "left")
    return occurrence_ids(out, ["root", "effect_type", "resource"], ["dist"])


def fingerprint_query(roots: DataFrame, inherited: DataFrame, kinds: list[str] | None = None, families: list[str] | None = None) -> DataFrame:
    """(root, family, ops, resources) of roots ``(routine_id, kinds)``, of some root kinds and resource kinds if given."""
    r = roots if kinds is None else roots.where(F.arrays_overlap("kinds", F.array(*map(F.lit, kinds))))
    f = inherited if families is None else inherited.where(F.col("resource_kind").isin(families))
    j = f.join(r.select("routine_id"), "routine_id", "left_semi")
    return j.groupBy(F.col("routine_id").alias("root"), F.col("resource_kind").alias("family")).agg(F.array_sort(F.collect_set("op")).alias("ops"), F.array_sort(F.collect_set("resource_id")).alias("resources"))


def changed_routines(hunks: DataFrame, starts: DataFrame) -> DataFrame:
    """(routine_id) with an operation or call, ``starts(path, routine_id, line)`` from 0, in the new lines of a hunk; deleted files have none."""
    h = hunks.where("change <> 'deleted'").select("path", (F.col("new_start") - 1).alias("lo"), (F.col("new_start") - 1 + F.col("new_count")).alias("hi"))
    return starts.join(h, "path").where("line >= lo and line < hi").select("routine_id").distinct()


def changed_roots(changed: DataFrame, roots: DataFrame, edges: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(roots that reach a changed routine, changed routines that no root reaches)."""
    seeds = changed.select(F.col("routine_id").alias("root"), F.col("routine_id").alias("node"))
    up = reach_from(seeds, edges.select(F.col("to").alias("src"), F.col("from").alias("dst")), stage, name="changed")
    hit = up.join(roots.select(F.col("routine_id").alias("node")), "node", "left_semi")
    lost = changed.join(hit.select(F.col("root").alias("routine_id")).distinct(), "routine_id", "left_anti")
    return hit.groupBy(F.col("node").alias("root")).agg(F.min("dist").alias("dist"), F.array_sort(F.collect_set("root")).alias("changed")), lost


def preflight(coverage: DataFrame, required: bool) -> dict:
    """The verdict over one row ``coverage(unknown, coverage_holds, recovered_files, opaque_apps)``; without a row the check itself failed."""
    row = coverage.first()
    if row is None:
        return {"degraded": True, "failed": required, "message": "resolution coverage could not be verified"}
    said = []
    if row["unknown"]:
        said.append(f"{row['unknown']} unresolved edge(s)")
    if not row["coverage_holds"]:
        said.append("sites and edges differ")
    if row["recovered_files"]:
        said.append(f"{row['recovered_files']} file(s) with syntax errors")
    if row["opaque_apps"]:
        said.append(f"{len(row['opaque_apps'])} application(s) without source: " + ", ".join(sorted(row["opaque_apps"])))
    return {"degraded": bool(said), "failed": bool(said) and required, "message": "coverage is partial: " + "; ".join(said) if said else "coverage is whole"}


def coverage_accounting(routines: DataFrame, call_sites: DataFrame, files: DataFrame, apps: DataFrame) -> DataFrame:
    """One row: bodies, incomplete parses, recovered files, opaque applications, unresolved and dynamic sites (each place counts)."""
    r = routines.agg(F.count(F.lit(1)).alias("routines"), F.count_if("body_available").alias("bodies"), F.count_if("parse_incomplete").alias("parse_incomplete"))
    c = call_sites.agg(F.count_if(F.col("outcome") == "Unknown").alias("unknown"), F.count_if(F.col("outcome") == "HonestDynamic").alias("dynamic"), F.array_sort(F.collect_set(F.when(F.col("outcome") == "Unknown", F.col("callee")))).alias("unresolved_callees"))
    f = files.agg(F.count_if(F.col("status") == "Recovered").alias("recovered_files"))
    a = apps.agg(F.array_sort(F.collect_set(F.when(~F.col("has_source"), F.col("app_guid")))).alias("opaque_apps"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(r).join(one(c), "_k").join(one(f), "_k").join(one(a), "_k").drop("_k")


def integration_report(events: DataFrame, edges: DataFrame, routines: DataFrame) -> DataFrame:
    """Who reacts to what: each event with its publisher's application and its subscribers, by application."""
    app = routines.select("routine_id", "app_guid")
    p = events.join(app.select(F.col("routine_id").alias("publisher_routine_id"), F.col("app_guid").alias("publisher_app")), "publisher_routine_id", "left")
    s = edges.join(app.select(F.col("routine_id").alias("subscriber_routine_id"), F.col("app_guid").alias("subscriber_app")), "subscriber_routine_id", "left")
    s = s.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("subscriber_app", "subscriber_routine_id"))).alias("subscribers"))
    out = p.join(s, "event_id", "left").withColumn("subscribers", F.coalesce("subscribers", F.array().cast("array<struct<subscriber_app:string,subscriber_routine_id:string>>")))
    return out.withColumn("cross_app", F.exists("subscribers", lambda x: x["subscriber_app"] != F.col("publisher_app")))


def fanout(events: DataFrame, edges: DataFrame, coverage: DataFrame, hot: int = 5) -> DataFrame:
    """Per event: direct subscribers, whether it is hot, and three coverages: dispatch edges, what subscribers compose, both."""
    s = edges.join(coverage.select(F.col("routine_id").alias("subscriber_routine_id"), "status"), "subscriber_routine_id", "left")
    good = F.col("resolution") == "resolved"
    g = s.groupBy("event_id").agg(
        F.count_distinct(F.when(good, F.col("subscriber_routine_id"))).alias("n"), F.bool_or(~good).alias("open"), F.count_if(good & F.col("status").isNull()).alias("blank"), F.count_if(good & (F.col("status") != "complete")).alias("partial")
    )
    j = events.join(g, "event_id", "left")
    n = F.coalesce("n", F.lit(0))
    dispatch = F.when(F.coalesce("open", F.lit(False)), "partial").otherwise("complete")
    composed = F.when((n == 0) | (F.col("blank") > 0), "unknown").when(F.col("partial") > 0, "partial").otherwise("complete")
    return j.select("event_id", "publisher_routine_id", n.alias("subscribers"), (n > hot).alias("hot"), dispatch.alias("dispatch_edges"), composed.alias("composition"), F.greatest(dispatch, F.when(composed == "unknown", "partial").otherwise(composed)).alias("coverage"))


def fanout_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("publisher_routine_id").alias("publishers"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("subscribers") == 0).alias("silent"), F.count_if("hot").alias("hot"),
        F.count_if((F.col("dispatch_edges") == "partial") | (F.col("composition") == "partial")).alias("partial"),
    )
