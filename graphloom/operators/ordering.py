"""Order of operations inside a routine, and what it guarantees about a transaction.

``ops(routine_id, op_id, effect, order_id, frames, on_success_path, dominates_return,
temporary)``; ``frames array<struct<id, kind, falls_through>>`` from the outermost. Selector
frames are if-then, if-else and case-branch; loops are loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SELECTORS = ("if-then", "if-else", "case-branch")
#: A routine's pairs of operations are made only between effects that a label speaks of.
WRITES = ("DB_INSERT", "DB_MODIFY", "DB_DELETE")
EXTERNAL = ("HTTP", "FILE")


def _ids(frames: Column) -> Column:
    return F.transform(frames, lambda f: f["id"])


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading frames that both chains have."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(a, i.cast("int"))["id"] == F.try_element_at(b, i.cast("int"))["id"], F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(n == 0, 0).when(first_other == 0, n).otherwise(first_other - 1)


def ordered_before(a_order: Column, a: Column, b_order: Column, b: Column) -> Column:
    """a before b on every run that has both: a smaller number, and no loop around both."""
    loops = F.filter(b, lambda f: f["kind"] == "loop")
    return (a_order < b_order) & ~F.arrays_overlap(_ids(a), _ids(loops))


def dominates(a_order: Column, a: Column, b_order: Column, b: Column) -> Column:
    """No run reaches b without a: a's frames lead b's, and below them b lies in no selector or loop."""
    below = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    return (a_order < b_order) & (F.size(a) <= F.size(b)) & (shared_prefix(a, b) == F.size(a)) & ~F.exists(below, lambda f: f["kind"].isin(*SELECTORS, "loop"))


def may_co_execute(a_id: Column, a: Column, b_id: Column, b: Column) -> Column:
    """False for branches of one selector, and where one lies in a branch that is left for good and the other does not."""
    n = shared_prefix(a, b)
    at = lambda x: F.coalesce(F.try_element_at(x, (n + 1).cast("int"))["kind"].isin(*SELECTORS), F.lit(False))
    leaves = lambda x, y: F.exists(x, lambda f: f["kind"].isin(*SELECTORS) & (f["falls_through"] == F.lit(False)) & ~F.array_contains(_ids(y), f["id"]))
    return (a_id != b_id) & ~(at(a) & at(b)) & ~leaves(a, b) & ~leaves(b, a)


def quantifier(dom: Column) -> Column:
    return F.when(dom, "must-all-paths").otherwise("may")


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes(routine_id, op_id, path)`` with order ids in preorder; paths are arrays of child places."""
    return nodes.withColumn("order_id", F.row_number().over(W.partitionBy("routine_id").orderBy("path", "op_id")) - 1)


def loop_depth(ops: DataFrame, loops: DataFrame) -> DataFrame:
    """``ops(routine_id, op_id, line)`` with the number of ``loops(routine_id, start_line, end_line)`` around each."""
    hit = ops.join(loops, "routine_id").where("line >= start_line and line <= end_line").groupBy("op_id").agg(F.count(F.lit(1)).alias("depth"))
    return ops.join(hit, "op_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def _side(ops: DataFrame, name: str, effects) -> DataFrame:
    own = ops.where(F.col("effect").isin(*effects) & ~F.coalesce("temporary", F.lit(False)))
    return own.select("routine_id", F.struct("op_id", "effect", "order_id", "frames", "dominates_return").alias(name))


def _pair_terms(a: str, b: str):
    return F.col(f"{a}.order_id"), F.col(f"{a}.frames"), F.col(f"{b}.order_id"), F.col(f"{b}.frames")


def ordering_labels(ops: DataFrame) -> DataFrame:
    """(routine_id, op_id, label, other_op_id) of each routine's own operations.

    Commits: COMMIT_REACHABLE (on every operation of the routine),
    COMMIT_ON_SUCCESS_PATH, COMMIT_DOMINATES_RETURN. Writes: WRITE_COMMITTED_BEFORE_RETURN,
    if their nearest commit after dominates the return and they dominate it. External IO and
    UI windows: WRITE_PENDING_AT_EXTERNAL_IO and WRITE_PENDING_AT_UI for a write that comes
    before with no commit between that the write must pass, EXTERNAL_IO_BEFORE_COMMIT for a
    commit after. Operations without order data are ORDERING_UNKNOWN. Known temporary writes do not count.
    """
    known = ops.where("order_id is not null and frames is not null")
    none = F.lit(None).cast("string")
    commits = _side(known, "c", ["COMMIT"])
    with_commit = commits.select("routine_id").distinct()
    out = ops.where("order_id is null or frames is null").select("routine_id", "op_id", F.lit("ORDERING_UNKNOWN").alias("label"), none.alias("other_op_id"))
    out = out.unionByName(known.join(with_commit, "routine_id", "left_semi").select("routine_id", "op_id", F.lit("COMMIT_REACHABLE").alias("label"), none.alias("other_op_id")))
    c = known.where("effect = 'COMMIT'")
    out = out.unionByName(c.where("on_success_path").select("routine_id", "op_id", F.lit("COMMIT_ON_SUCCESS_PATH").alias("label"), none.alias("other_op_id")))
    out = out.unionByName(c.where("dominates_return").select("routine_id", "op_id", F.lit("COMMIT_DOMINATES_RETURN").alias("label"), none.alias("other_op_id")))
    writes = _side(known, "w", WRITES)
    after = writes.join(commits, "routine_id").where("c.order_id > w.order_id")
    nearest = after.groupBy("routine_id", "w").agg(F.min_by("c", F.col("c.order_id")).alias("c"))
    kept = nearest.where(F.col("c.dominates_return") & dominates(*_pair_terms("w", "c")))
    out = out.unionByName(kept.select("routine_id", F.col("w.op_id").alias("op_id"), F.lit("WRITE_COMMITTED_BEFORE_RETURN").alias("label"), F.col("c.op_id").alias("other_op_id")))
    for effects, label in ((EXTERNAL, "WRITE_PENDING_AT_EXTERNAL_IO"), (("UI_WINDOW_OPEN",), "WRITE_PENDING_AT_UI")):
        io = _side(known, "x", effects)
        pairs = writes.join(io, "routine_id").where(ordered_before(*_pair_terms("w", "x")) & may_co_execute(F.col("w.op_id"), F.col("w.frames"), F.col("x.op_id"), F.col("x.frames")))
        between = pairs.join(commits, "routine_id").where(F.expr("c.order_id > w.order_id and c.order_id < x.order_id") & dominates(*_pair_terms("c", "x")))
        pending = pairs.join(between.select("routine_id", "w", "x").distinct(), ["routine_id", "w", "x"], "left_anti")
        out = out.unionByName(pending.groupBy("routine_id", F.col("x.op_id").alias("op_id")).agg(F.max_by("w.op_id", "w.order_id").alias("other_op_id")).select("routine_id", "op_id", F.lit(label).alias("label"), "other_op_id"))
    io = _side(known, "x", EXTERNAL)
    before = io.join(commits, "routine_id").where(ordered_before(*_pair_terms("x", "c")) & may_co_execute(F.col("x.op_id"), F.col("x.frames"), F.col("c.op_id"), F.col("c.frames")))
    first = before.groupBy("routine_id", F.col("x.op_id").alias("op_id")).agg(F.min_by("c.op_id", "c.order_id").alias("other_op_id"))
    return out.unionByName(first.select("routine_id", "op_id", F.lit("EXTERNAL_IO_BEFORE_COMMIT").alias("label"), "other_op_id"))


def hazard_grade(label: Column, io_type: Column, direction: Column, refutable: Column, commit_effect: Column) -> Column:
    """How bad a label is: none, info, low, medium, high, critical, or suppressed."""
    sure = F.coalesce(refutable, F.lit(False))
    return (
        F.when(label == "WRITE_PENDING_AT_EXTERNAL_IO", F.when(~sure, "suppressed").when((io_type == "HTTP") | (direction == "write"), "critical").otherwise("high"))
        .when(label == "EXTERNAL_IO_BEFORE_COMMIT", F.when((commit_effect == "proven_suppressed") | (direction != "write"), "suppressed").otherwise("info"))
        .when(label == "WRITE_PENDING_AT_UI", F.when(sure, "high").otherwise("suppressed"))
        .when(label == "WRITE_COMMITTED_BEFORE_EXTERNAL_IO", "none")
        .when(label == "IO_BEFORE_ESCAPING_ERROR", F.when(~sure | (direction == "read"), "suppressed").when(commit_effect == "proven_effective", "medium").otherwise("low"))
        .when(label == "EXTERNAL_IO_IN_EVENT_SUBSCRIBER_TXN", "info")
        .otherwise("none")
    )


def error_escapes(chains: DataFrame, routines: DataFrame) -> DataFrame:
    """``chains(chain_id, routine_ids)`` with whether an error at the end reaches the root: no routine between is a TryFunction."""
    step = chains.select("chain_id", F.posexplode("routine_ids").alias("at", "routine_id")).join(routines.select("routine_id", "is_try"), "routine_id", "left")
    blocked = step.groupBy("chain_id").agg(F.bool_or(F.coalesce("is_try", F.lit(False))).alias("blocked"))
    return chains.join(blocked, "chain_id", "left").withColumn("escapes", ~F.coalesce("blocked", F.lit(False))).drop("blocked")


CONDITIONALITY = ("unconditional-on-success", "conditional-branch", "conditional-loop", "unreachable")


def path_conditionality(steps: DataFrame) -> DataFrame:
    """(root, effect, path_id, conditionality) of ``steps(root, effect, path_id, condition)``: the most restrictive on the path; an unknown step makes it unknown."""
    rank = F.array_position(F.array(*map(F.lit, CONDITIONALITY)), F.col("condition"))
    got = steps.groupBy("root", "effect", "path_id").agg(F.max(rank).alias("r"), F.bool_or(F.coalesce(rank == 0, F.lit(True))).alias("unknown"))
    return got.select("root", "effect", "path_id", F.when(F.col("unknown"), "unknown").otherwise(F.try_element_at(F.array(*map(F.lit, CONDITIONALITY)), F.greatest("r", F.lit(1)).cast("int"))).alias("conditionality"))


def effect_conditionality(paths: DataFrame) -> DataFrame:
    """(root, effect, conditionality, paths): the least restrictive over the paths that are known; unknown if none is."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, CONDITIONALITY)), F.col("conditionality")), F.lit(0))
    got = paths.groupBy("root", "effect").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("paths"))
    return got.select("root", "effect", F.coalesce(F.try_element_at(F.array(*map(F.lit, CONDITIONALITY)), F.coalesce("r", F.lit(99)).cast("int")), F.lit("unknown")).alias("conditionality"), "paths")
