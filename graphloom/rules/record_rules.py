"""Detectors over record operations, calls and events, each one declarative plan.

``Facts`` holds the fact tables by name; a detector returns (detector, severity,
confidence, routine_id, op_id, table_id). Operations before or after another are
found by windows over a routine's variable in source order, so every operation
is read once and only rows of one routine meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import boolean_literal, guard_name
from graphloom.operators.predicates import ascii_lower

# fixed values: names of record operations
LOOKUP_OPS = ["Get", "FindFirst", "FindLast"]
RETRIEVAL_OPS = ["Get", "FindFirst", "FindLast", "FindSet", "Find", "Next"]
LOAD_OPS = ["Get", "FindFirst", "FindLast", "FindSet", "Find", "Next", "Init", "Insert", "Copy"]
SELF_WRITE_OPS = ["Modify", "ModifyAll", "Validate", "Delete", "DeleteAll"]
RESET_OPS = ["Init", "Reset", "Get", "FindFirst", "FindLast", "FindSet", "Find", "Next", "Copy", "TransferFields"]
FILTER_OPS = ["SetRange", "SetFilter"]
BULK_OPS = ["DeleteAll", "ModifyAll"]

OUT = ["detector", "severity", "confidence", "routine_id", "op_id", "table_id"]
Detector = Callable[[dict[str, DataFrame]], DataFrame]
DETECTORS: dict[str, Detector] = {}
#: Detectors that run only when named.
OPT_IN: set[str] = set()
PRESETS = {
    "transaction-integrity": ["d8-commit-in-transaction", "d34-commit-in-loop", "d35-commit-in-event-subscriber", "d46-commit-in-lifecycle", "d47-io-unsafe-txn", "d48-io-in-loop", "d49-uncommitted-write-before-ui"],
    "bcquality": [
        "d52-bulk-write-param-no-temp-guard", "d53-ignored-tryfunction-result", "d54-publish-in-tryfunction-cone", "d55-event-publish-in-loop", "d56-clone-before-write-in-loop", "d57-singleinstance-growing-state", "d58-query-filter-after-open",
        "d59-integrationevent-var-boolean-guard", "d60-upgrade-loop-should-be-datatransfer", "d61-ishandled-bypasses-critical-write", "d62-telemetry-before-success", "d63-html-concat-injection", "d64-api-page-write-surface",
    ],
    "record-safety": ["d4-repeated-lookup-in-loop", "d10-self-modifying-loop", "d11-modify-without-get", "d21-read-without-load", "d33-unfiltered-bulk-write", "d36-late-setloadfields", "d37-validate-without-persist"],
}


def detector(name: str, opt_in: bool = False):
    def add(fn):
        DETECTORS[name] = fn
        if opt_in:
            OPT_IN.add(name)
        return fn

    return add


def _found(df: DataFrame, name: str, severity: Column | str, confidence: str = "likely") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    table = F.col("table_id") if "table_id" in df.columns else F.lit(None).cast("string")
    op = F.col("op_id") if "op_id" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(name).alias("detector"), sev.alias("severity"), F.lit(confidence).alias("confidence"), "routine_id", op.alias("op_id"), table.alias("table_id"))


def _needs(facts: dict[str, DataFrame], *names: str) -> list[DataFrame]:
    """Fact tables by name, or by ``table.column`` where a column is asked for; MissingFacts if one is absent."""
    lost = []
    for n in names:
        table, _, column = n.partition(".")
        if table not in facts or (column and column not in facts[table].columns):
            lost.append(n)
    if lost:
        raise MissingFacts(lost)
    return [facts[n.partition(".")[0]] for n in names]


class MissingFacts(LookupError):
    """A detector's fact tables that were not given."""

    def __init__(self, names: list[str]):
        super().__init__(", ".join(names))
        self.names = names


def what_callees_do(facts: dict[str, DataFrame]) -> DataFrame | None:
    """Pseudo-operations at the calls that pass a record by reference: @loads, @filters, @resets or @persists, by the callee's roles.

    ``bindings(callsite_id, routine_id, var, callee, position, by_ref, anchor, loop_stack)``,
    ``roles(routine_id, position, loads, filters, resets, persists)``, which hold for whole call
    chains. What a callee may do counts like what it does.
    """
    if "bindings" not in facts or "roles" not in facts:
        return None
    r = facts["roles"].withColumnRenamed("routine_id", "callee")
    j = facts["bindings"].where("by_ref").join(r, ["callee", "position"])
    kinds = [F.when(F.coalesce(F.col(c) != "no", F.lit(False)), f"@{c}") for c in ("loads", "filters", "resets", "persists")]
    return j.select(F.col("callsite_id").alias("op_id"), "routine_id", F.explode(F.array_compact(F.array(*kinds))).alias("op"), "var", "anchor", "loop_stack")


def operations(facts: dict[str, DataFrame]) -> DataFrame:
    """Record operations of routines with a whole body, with the variable's key, whether it is a parameter, and their place.

    What callees do to a variable stands among them as pseudo-operations, and so does
    the platform's load of Rec in table and page triggers, before all others. Operations on virtual
    tables are left out.
    """
    routines, variables, recorded = _needs(facts, "routines", "record_variables", "record_operations")
    whole = routines.where("body_available and not coalesce(parse_incomplete, false)")
    v = variables.where("is_parameter").select("routine_id", ascii_lower(F.col("name")).alias("var_key")).distinct().withColumn("is_parameter", F.lit(True))
    called = what_callees_do(facts)
    ops = recorded if called is None else recorded.unionByName(called, allowMissingColumns=True)
    if {"kind", "object_id"} <= set(whole.columns) and "objects" in facts:
        on = facts["objects"].where("kind in ('Table', 'TableExtension', 'Page', 'PageExtension')").select("object_id")
        loaded = whole.where("kind = 'trigger'").join(on, "object_id", "left_semi").select(F.lit("@platform").alias("op_id"), "routine_id", F.lit("@loads").alias("op"), F.lit("Rec").alias("var"), F.struct(F.lit(-1).alias("start_line"), F.lit(0).alias("start_col")).alias("anchor"))
        ops = ops.withColumn("anchor", F.struct(F.col("anchor.start_line").cast("int").alias("start_line"), F.col("anchor.start_col").cast("int").alias("start_col"))).unionByName(loaded, allowMissingColumns=True)
    if "tables" in facts and "is_virtual" in facts["tables"].columns:
        ops = ops.join(facts["tables"].where("is_virtual").select("table_id").distinct(), "table_id", "left_anti")
    ops = ops.withColumn("var_key", ascii_lower(F.col("var"))).join(whole.select("routine_id"), "routine_id", "left_semi")
    ops = ops.join(v, ["routine_id", "var_key"], "left")
    guard = F.coalesce("temp_guard", F.lit(False)) if "temp_guard" in ops.columns else F.lit(False)
    return ops.withColumns(
        {
            "is_parameter": F.coalesce("is_parameter", F.lit(False)), "at": F.struct("anchor.start_line", "anchor.start_col"), "known_temp": F.coalesce((F.col("temp.kind") == "known") & F.col("temp.value"), F.lit(False)) | guard,
            "loop_stack": F.coalesce("loop_stack", F.array().cast("array<string>")), "loop_id": F.try_element_at("loop_stack", F.lit(-1)),
        }
    )


def _var() -> W:
    """A routine's operations on one variable in source order."""
    return W.partitionBy("routine_id", "var_key").orderBy("at")


#: Rows strictly before or after in source order; operations at one place are neither.
_BEFORE, _AFTER = "before", "after"


def _strictly(side: str, keep: Column) -> Column:
    """Whether an operation with ``keep`` stands strictly before (after) this one, on its variable."""
    w = _var().rangeBetween(W.unboundedPreceding, 0) if side == _BEFORE else _var().rangeBetween(0, W.unboundedFollowing)
    end = F.min(F.when(keep, F.col("at"))).over(w) if side == _BEFORE else F.max(F.when(keep, F.col("at"))).over(w)
    return F.coalesce(end < F.col("at") if side == _BEFORE else end > F.col("at"), F.lit(False))


def _last_before(value: Column) -> Column:
    """The last value that is not null on this variable in the rows before."""
    return F.last(value, True).over(_var().rowsBetween(W.unboundedPreceding, -1))


@detector("d4-repeated-lookup-in-loop")
def d4(facts):
    """Two lookups or more of one variable by one literal key in one loop."""
    ops = operations(facts).where(F.col("op").isin(LOOKUP_OPS) & ~F.col("known_temp") & F.coalesce(F.try_element_at("field_args", F.lit(1)).rlike("^'"), F.lit(False)))
    each = ops.select("*", F.explode("loop_stack").alias("loop"), F.try_element_at("field_args", F.lit(1)).alias("key"))
    return _found(each.groupBy("routine_id", "loop", "var_key", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("op_id", "at").alias("op_id"), F.min_by("table_id", "at").alias("table_id")).where("n >= 2"), "d4-repeated-lookup-in-loop", "medium")


@detector("d10-self-modifying-loop")
def d10(facts):
    """A write on the variable whose Next drives the loop; a loop's driver is its first Next's variable."""
    ops = operations(facts).where("loop_id is not null")
    drivers = ops.where("op = 'Next'").groupBy("routine_id", "loop_id").agg(F.min_by("var_key", "at").alias("var_key"))
    writes = ops.where(F.col("op").isin(SELF_WRITE_OPS) & ~F.col("known_temp"))
    return _found(writes.join(drivers, ["routine_id", "loop_id", "var_key"], "left_semi"), "d10-self-modifying-loop", "high")


@detector("d11-modify-without-get")
def d11(facts):
    ops = operations(facts).withColumn("loaded", _strictly(_BEFORE, F.col("op").isin(*LOAD_OPS, "@loads")))
    return _found(ops.where("op in ('Modify', 'Validate') and not loaded and not is_parameter"), "d11-modify-without-get", "medium")


@detector("d21-read-without-load")
def d21(facts):
    ops = operations(facts).withColumn("loaded", _strictly(_BEFORE, F.col("op").isin(*LOAD_OPS, "@loads")))
    return _found(ops.where("op in ('TestField', 'CalcFields', 'CalcSums') and not loaded and not is_parameter"), "d21-read-without-load", "medium")


@detector("d33-unfiltered-bulk-write")
def d33(facts):
    """A bulk write whose variable's last filter call before it is a Reset, or none."""
    filtered = F.coalesce(_last_before(F.when(F.col("op").isin(*FILTER_OPS, "@filters"), True).when(F.col("op").isin("Reset", "@resets"), False)), F.lit(False))
    ops = operations(facts).withColumn("filtered", filtered).where(F.col("op").isin(BULK_OPS) & ~F.col("filtered") & ~F.col("known_temp") & ~F.col("is_parameter") & F.col("table_id").isNotNull())
    return _found(ops, "d33-unfiltered-bulk-write", F.when(F.col("op") == "DeleteAll", "critical").otherwise("high"))


@detector("d36-late-setloadfields")
def d36(facts):
    load = F.col("op").isin(RETRIEVAL_OPS)
    ops = operations(facts).withColumn("prior", _strictly(_BEFORE, load)).withColumn("later", _strictly(_AFTER, load))
    return _found(ops.where("op in ('SetLoadFields', 'AddLoadFields') and prior and not later and not known_temp and not is_parameter"), "d36-late-setloadfields", "low")


@detector("d37-validate-without-persist")
def d37(facts):
    """A Validate whose variable is reset, or left, before it is stored."""
    step = F.when(F.col("op").isin("Modify", "Insert", "@persists"), True).when(F.col("op").isin(*RESET_OPS, "@resets"), False)
    nxt = F.coalesce(F.first(step, True).over(_var().rowsBetween(1, W.unboundedFollowing)), F.lit(False))
    ops = operations(facts).withColumn("stored", nxt)
    return _found(ops.where("op = 'Validate' and not stored and not known_temp and not is_parameter"), "d37-validate-without-persist", "medium", "possible")


@detector("d52-bulk-write-param-no-temp-guard")
def d52(facts):
    filtered = F.coalesce(_last_before(F.when(F.col("op").isin(*FILTER_OPS, "@filters"), True).when(F.col("op").isin("Reset", "@resets"), False)), F.lit(False))
    ops = operations(facts).withColumn("filtered", filtered).where(F.col("op").isin(BULK_OPS) & F.col("is_parameter") & ~F.col("filtered") & ~F.col("known_temp"))
    return _found(ops, "d52-bulk-write-param-no-temp-guard", F.when(F.col("op") == "DeleteAll", "high").otherwise("medium"), "possible")


@detector("d12-dead-integration-event")
def d12(facts):
    events, edges = _needs(facts, "events", "event_edges")
    dead = events.where("kind = 'integration'").join(edges.select("event_id").distinct(), "event_id", "left_anti")
    return _found(dead.select(F.col("publisher_routine_id").alias("routine_id")), "d12-dead-integration-event", "info")


@detector("d13-cross-app-internal-call")
def d13(facts):
    r, edges = _needs(facts, "routines", "combined_edges")
    callee = r.where("access = 'internal'").select(F.col("routine_id").alias("to"), F.col("app_guid").alias("callee_app"))
    caller = r.select("routine_id", "app_guid")
    edges = edges.withColumnRenamed("from", "routine_id").join(callee, "to").join(caller, "routine_id").where("app_guid <> callee_app")
    return _found(edges.select("routine_id", F.col("operation_id").alias("op_id")), "d13-cross-app-internal-call", "high", "confirmed")


@detector("d32-constant-boolean-parameter")
def d32(facts):
    """A local routine's parameter that gets one Boolean literal from every call, of which there are two or more."""
    args = _needs(facts, "arguments")[0].withColumn("value", boolean_literal(F.col("text")))
    local = _needs(facts, "routines")[0].where("access = 'local'").select("routine_id")
    same = args.groupBy("routine_id", "position").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n >= 2 and n = known and lo = hi")
    return _found(same.join(local, "routine_id", "left_semi"), "d32-constant-boolean-parameter", "info")


@detector("d59-integrationevent-var-boolean-guard")
def d59(facts):
    p = _needs(facts, "parameters")[0].where("is_var and lower(type) = 'boolean'").where(guard_name(F.col("name")))
    pub = _needs(facts, "events")[0].where("kind = 'integration'").select(F.col("publisher_routine_id").alias("routine_id")).distinct()
    return _found(p.join(pub, "routine_id", "left_semi"), "d59-integrationevent-var-boolean-guard", "medium", "possible")


def chosen_detectors(names: list[str] | None = None) -> list[str]:
    """Detector names of a list of names and presets; the default ones, in their order, without."""
    if names is None:
        return [n for n in DETECTORS if n not in OPT_IN]
    out = [n for x in names for n in PRESETS.get(x, [x])]
    for n in out:
        if n not in DETECTORS:
            raise ValueError(f"unknown detector {n}")
    return list(dict.fromkeys(out))


def run_detectors(facts: dict[str, DataFrame], names: list[str] | None = None, skipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """The union of the chosen detectors' findings.

    A default detector whose facts are absent is left out, and noted in ``skipped`` with
    what it lacks; a named one is an error. Other errors are never swallowed.
    """
    parts = []
    for n in chosen_detectors(names):
        try:
            parts.append(DETECTORS[n](facts))
        except MissingFacts as e:
            if names is not None:
                raise
            if skipped is not None:
                skipped.append((n, str(e)))
    if not parts:
        raise MissingFacts(["no detector has its facts"])
    return reduce(DataFrame.unionByName, parts)
