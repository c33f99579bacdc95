"""Whole-program summaries: base facts, uncertainty, loops that reach a place, cohorts and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.closure import components_of, reach_from
from graphloom.storage import Stage


def base_facts(routines: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """(routine_id, unresolved, reasons) of each routine itself: a body that is not there has unresolved calls but no uncertainty, an incomplete parse both."""
    u = uncertainties.groupBy(F.col("from").alias("routine_id")).agg(F.collect_set("kind").alias("kinds"))
    none = F.array().cast("array<string>")
    incomplete = F.coalesce("parse_incomplete", F.lit(False))
    j = routines.join(u, "routine_id", "left")
    reasons = F.array_union(F.coalesce("kinds", none), F.when(incomplete, F.array(F.lit("parse-incomplete"))).otherwise(none))
    return j.select("routine_id", (~F.coalesce("body_available", F.lit(False)) | incomplete | F.col("kinds").isNotNull()).alias("unresolved"), F.array_sort(reasons).alias("reasons"))


def _against(seeds: DataFrame, edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    return reach_from(seeds, edges.select(F.col("to").alias("src"), F.col("from").alias("dst")), stage, name=name)


def propagated_uncertainty(base: DataFrame, edges: DataFrame, stage: Stage) -> DataFrame:
    """(routine_id, unresolved, reasons) with those of all that a routine reaches; reasons travel once each, whoever has them."""
    marks = base.select("routine_id", F.explode(F.concat(F.col("reasons"), F.when(F.col("unresolved"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")))).alias("mark"))
    got = _against(marks.select(F.col("mark").alias("root"), F.col("routine_id").alias("node")), edges, stage, "uncertain").select(F.col("node").alias("routine_id"), F.col("root").alias("mark")).distinct()
    g = got.groupBy("routine_id").agg(F.bool_or(F.col("mark") == "?").alias("unresolved"), F.array_sort(F.collect_set(F.when(F.col("mark") != "?", F.col("mark")))).alias("reasons"))
    return base.select("routine_id").join(g, "routine_id", "left").select("routine_id", F.coalesce("unresolved", F.lit(False)).alias("unresolved"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def capped_confidence(confidence: Column, uncertainties: Column) -> Column:
    """No better than possible while anything is uncertain."""
    return F.when((F.size(uncertainties) > 0) & confidence.isin("confirmed", "likely"), "possible").otherwise(confidence)


def split_components(edges: DataFrame, fixed: DataFrame, stage: Stage) -> DataFrame:
    """Components that are left when the nodes of ``fixed(node)`` no longer pass anything on."""
    own = edges.join(fixed.select(F.col("node").alias("src")), "src", "left_anti").join(fixed.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return components_of(own, stage, "split")


def seeded(computed: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """Summaries of a dependency that were made before, and of all others those that are computed."""
    return leaves.unionByName(computed.join(leaves.select(key), key, "left_anti"))


def transitive_subscribers(events: DataFrame, event_edges: DataFrame, calls: DataFrame, stage: Stage) -> DataFrame:
    """(event_id, routine_id, dist): subscribers of each event, and of the events that they in turn publish, over calls between."""
    seeds = events.join(event_edges.where("resolution = 'resolved'"), "event_id").select(F.col("event_id").alias("root"), F.col("subscriber_routine_id").alias("node")).distinct()
    hops = calls.select(F.col("from").alias("src"), F.col("to").alias("dst")).union(event_edges.where("resolution = 'resolved'").select(F.col("publisher_routine_id").alias("src"), F.col("subscriber_routine_id").alias("dst")))
    return reach_from(seeds, hops, stage, name="subscribers").select(F.col("root").alias("event_id"), F.col("node").alias("routine_id"), "dist")


def unresolved_in_reach(roots: DataFrame, edges: DataFrame, unresolved_sites: DataFrame, stage: Stage, max_depth: int = 64) -> DataFrame:
    """(root, callsite_id, dist, open_world) of unresolved sites in what each root reaches."""
    got = reach_from(roots.select(F.col("routine_id").alias("root"), F.col("routine_id").alias("node")), edges.select(F.col("from").alias("src"), F.col("to").alias("dst")), stage, None, max_depth, "gaps")
    return got.join(unresolved_sites.select(F.col("routine_id").alias("node"), "callsite_id", "open_world"), "node").select("root", "callsite_id", "dist", "open_world")


def loops_reaching(in_loop_calls: DataFrame, edges: DataFrame, terminals: DataFrame, stage: Stage) -> DataFrame:
    """(routine_id, loops, set_id): the loops whose calls reach each terminal routine; equal sets have one id.

    ``in_loop_calls(loop_id, to)``. Goes against the calls from the terminals, so loops that reach none cost nothing.
    """
    callers = _against(terminals.select(F.col("routine_id").alias("root"), F.col("routine_id").alias("node")).distinct(), edges, stage, "loops")
    hit = callers.join(in_loop_calls.select("loop_id", F.col("to").alias("node")).distinct(), "node").select(F.col("root").alias("routine_id"), "loop_id").distinct()
    sets = hit.groupBy("routine_id").agg(F.array_sort(F.collect_list("loop_id")).alias("loops"))
    return sets.withColumn("set_id", F.xxhash64("loops"))


def interned_sets(members: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(key, set_id) and (set_id, items): each different set is kept once."""
    s = members.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items")).withColumn("set_id", F.xxhash64("items"))
    return s.select(key, "set_id"), s.select("set_id", "items").dropDuplicates(["set_id"])


def component_unions(members: DataFrame, components: DataFrame, edges: DataFrame, stage: Stage) -> DataFrame:
    """(component, item): what the members of each component, and of all components after it, have; ``members(node, item)``."""
    own = members.join(components.select("node", "component"), "node", "left").select(F.coalesce("component", "node").alias("component"), "item").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = reach_from(own.select(F.col("item").alias("root"), F.col("component").alias("node")), back, stage, name="unions")
    return got.select(F.col("node").alias("component"), F.col("root").alias("item")).distinct()


def cohorts(paths: DataFrame) -> DataFrame:
    """One representative of the paths of a cohort ``paths(cohort, path, ...)``: the shortest, then the first by its nodes."""
    return paths.groupBy("cohort").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"), F.count(F.lit(1)).alias("paths"))


def temp_along(path_bindings: Column, start: Column) -> Column:
    """A record's temporary state after the calls of ``array<struct<temp>>``: a known state stays, a parameter takes what the next call binds, anything else is unknown."""
    return F.aggregate(path_bindings, start, lambda state, step: F.when(state == "parameter", F.coalesce(step["temp"], F.lit("unknown"))).otherwise(state))


def terminal_verdict(temp: Column, flowfield: Column) -> Column:
    """Temporary, Physical, FlowFieldGated or Uncertain."""
    return F.when(temp == "known-true", "Temporary").when(F.coalesce(flowfield, F.lit(False)), "FlowFieldGated").when(temp == "known-false", "Physical").otherwise("Uncertain")


def live_parameters(uses: DataFrame, passes: DataFrame, stage: Stage) -> DataFrame:
    """(routine_id, position) of parameters whose state matters: used here, ``uses(routine_id, position)``, or passed to one that matters."""
    node = lambda r, p: F.concat_ws("#", r, p)
    seeds = uses.select(F.lit(0).alias("root"), node("routine_id", "position").alias("node")).distinct()
    back = passes.where("callee is not null").select(node("callee", "callee_position").alias("src"), node("routine_id", "position").alias("dst"))
    got = reach_from(seeds, back, stage, name="live")
    return got.select(F.regexp_extract("node", r"^(.*)#(\d+)$", 1).alias("routine_id"), F.regexp_extract("node", r"^(.*)#(\d+)$", 2).cast("int").alias("position")).distinct()


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(value, id) from 0 without gaps in the order of the distinct values: ranges are sorted on their own, their sizes give each its start."""
    part = values.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id())
    stage = Stage(values.sparkSession, "ids")
    part = stage.table("ranges", part)
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(W.orderBy("_p")) - F.col("n")).select("_p", "start")  # one row a range
    own = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1
    return part.withColumn("own", own).join(F.broadcast(starts), "_p").select(column, (F.col("start") + F.col("own")).alias("id"))


def composite(routines: DataFrame, effects: DataFrame, uncertainty: DataFrame, roles: DataFrame, components: DataFrame) -> DataFrame:
    """One row a routine: its effects, roles, whether calls are unresolved and why, whether it is recursive."""
    e = effects.groupBy("routine_id").agg(F.array_sort(F.collect_set(F.struct("table_id", "op", "temp", "via"))).alias("effects"))
    r = roles.groupBy("routine_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in roles.columns if c != "routine_id"]))).alias("roles"))
    c = components.select(F.col("node").alias("routine_id")).withColumn("recursive", F.lit(True))
    out = routines.select("routine_id")
    for part in (e, r, uncertainty, c):
        out = out.join(part, "routine_id", "left")
    return out.withColumn("recursive", F.coalesce("recursive", F.lit(False)))


def must_commit(chains: DataFrame) -> DataFrame:
    """(chain_id, unconditional): whether an operation at a chain's end runs on every success of the root: each call of ``steps array<boolean>`` dominates its caller's return."""
    return chains.select("chain_id", F.forall("steps", lambda x: F.coalesce(x, F.lit(False))).alias("unconditional"))


def publisher_guards(parameters: DataFrame, assignments: DataFrame, branches: DataFrame, handled: Column) -> DataFrame:
    """(routine_id, parameter, confidence) of handled flags: exact where the body has no branches, pattern where the flag is assigned, unknown else."""
    p = parameters.where("is_var").where(handled)
    a = assignments.select("routine_id", F.lower("variable").alias("k")).distinct().withColumn("set", F.lit(True))
    b = branches.select("routine_id").distinct().withColumn("branchy", F.lit(True))
    j = p.withColumn("k", F.lower("name")).join(a, ["routine_id", "k"], "left").join(b, "routine_id", "left")
    return j.select("routine_id", F.col("name").alias("parameter"), F.when(F.col("branchy").isNull(), "exact").when(F.col("set"), "pattern").otherwise("unknown").alias("confidence"))
