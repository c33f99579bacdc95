"""Detectors over calls, events, transactions and order, beside those of ``record_rules``.

Facts beyond the record rules': ``call_sites(callsite_id, routine_id, method, loop_stack,
anchor, in_statement, under_asserterror, result_used, args)``; ``combined_edges(from, to,
kind, callsite_id, operation_id, event_id)``; ``stage`` is the Stage that closures write to.
A closure over calls never makes all pairs: it starts from the few routines that a rule asks about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import posting_name, version_key
from graphloom.operators.capabilities import OP_CLASS, dead_routines, io_direction
from graphloom.operators.closure import components_of, reach_from
from graphloom.operators.ordering import EXTERNAL, hazard_grade, may_co_execute, ordering_labels
from graphloom.operators.predicates import ascii_lower
from graphloom.rules.record_rules import FILTER_OPS, _found, _needs, _var, detector, operations
from graphloom.storage import Stage

# fixed values: retrievals that read many rows or scan, and those that read one
HEAVY_READS = ["FindSet", "CalcFields", "CalcSums", "Count", "CountApprox"]
DB_OPS = [*OP_CLASS["db-read"], *OP_CLASS["db-write"], *OP_CLASS["db-lock"]]
WRITE_OPS = list(OP_CLASS["db-write"])
LEVELS = ["info", "low", "medium", "high", "critical"]


def _stage(facts: dict) -> Stage:
    df = facts["routines"]
    return facts.get("stage") or Stage(df.sparkSession, "rules")


def _edges(facts: dict, *kinds: str, but: tuple[str, ...] = ()) -> DataFrame:
    e = _needs(facts, "combined_edges")[0].where("to is not null")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    return e.where(~F.col("kind").isin(*but)) if but else e


def _primary(facts: dict) -> DataFrame:
    r = _needs(facts, "routines")[0]
    return r.where("not coalesce(is_dependency, false)") if "is_dependency" in r.columns else r


def _reach(facts: dict, roots: DataFrame, edges: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """(root, node, dist) from ``roots(routine_id)``, against the calls if ``reverse``."""
    a, b = ("to", "from") if reverse else ("from", "to")
    seeds = roots.select(F.col("routine_id").alias("root"), F.col("routine_id").alias("node")).distinct()
    return reach_from(seeds, edges.select(F.col(a).alias("src"), F.col(b).alias("dst")), _stage(facts), name=name)


def raised(severity: Column, by: Column) -> Column:
    """A severity some levels up."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), severity) + by.cast("int")
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(at, F.lit(len(LEVELS))).cast("int"))


def _db_severity(op: Column, depth: Column) -> Column:
    base = F.when(op.isin(*WRITE_OPS, *HEAVY_READS), "high").when(op == "LockTable", "low").otherwise("medium")
    return raised(base, (depth >= 2).cast("int"))


def _in_loop_targets(facts: dict) -> DataFrame:
    """(from, to, depth) of calls that stand in a loop."""
    calls = _needs(facts, "call_sites")[0].where(F.size("loop_stack") > 0).select("callsite_id", F.size("loop_stack").alias("depth"))
    return _edges(facts).join(calls, "callsite_id").groupBy("from", "to").agg(F.max("depth").alias("depth"))


def _reached_in_loop(facts: dict, terminals: DataFrame, name: str) -> DataFrame:
    """``terminals(routine_id, ...)`` that some in-loop call reaches, with the depth of the deepest such loop.

    Goes along the calls from what in-loop calls lead to; each depth is one root, so a routine is seen once for each depth.
    """
    seeds = _in_loop_targets(facts).select(F.col("depth").alias("root"), F.col("to").alias("node")).distinct()
    inside = reach_from(seeds, _edges(facts).select(F.col("from").alias("src"), F.col("to").alias("dst")), _stage(facts), name=name)
    return terminals.join(inside.groupBy(F.col("node").alias("routine_id")).agg(F.max("root").alias("loop_depth")), "routine_id")


@detector("d1-db-op-in-loop")
def d1(facts):
    """A database operation in a loop, or reached by a call in one; a Next that ends its loop is none. Temporaries and reads of setup tables are information."""
    ops = operations(facts).where(F.col("op").isin(DB_OPS))
    if "in_until" in ops.columns:
        ops = ops.where("not coalesce(in_until, false)")
    ops = ops.withColumn("own_depth", F.size("loop_stack"))
    far = _reached_in_loop(facts, ops.select("routine_id").distinct(), "d1")
    hit = ops.join(far, "routine_id", "left").withColumn("depth", F.col("own_depth") + F.coalesce("loop_depth", F.lit(0))).where("depth > 0")
    setup = F.lit(False)
    if "tables" in facts and "is_setup" in facts["tables"].columns:
        hit = hit.join(facts["tables"].where("is_setup").select("table_id").distinct().withColumn("setup", F.lit(True)), "table_id", "left")
        setup = F.coalesce("setup", F.lit(False)) & (F.col("op") == "Get")
    return _found(hit, "d1-db-op-in-loop", F.when(F.col("known_temp") | setup, "info").otherwise(_db_severity(F.col("op"), F.col("depth"))))


def _touches(facts: dict) -> DataFrame:
    """(routine_id) of routines with a database operation on no known temporary."""
    return operations(facts).where(F.col("op").isin(DB_OPS) & ~F.col("known_temp")).select("routine_id").distinct()


@detector("d2-event-fanout-in-loop")
def d2(facts):
    """A call in a loop to a publisher with a subscriber that touches the database, itself or through calls."""
    flow = _edges(facts, "event-dispatch").select(F.col("from").alias("publisher"), F.col("to").alias("node"))
    doing = _reach(facts, _touches(facts), _edges(facts), "d2", reverse=True).select("node").distinct()
    heavy = flow.join(doing, "node", "left_semi").select(F.col("publisher").alias("to")).distinct()
    calls = _needs(facts, "call_sites")[0].where(F.size("loop_stack") > 0).select("callsite_id")
    hit = _edges(facts, but=("event-dispatch",)).join(calls, "callsite_id", "left_semi").join(heavy, "to", "left_semi")
    return _found(hit.select(F.col("from").alias("routine_id"), F.col("callsite_id").alias("op_id")).distinct(), "d2-event-fanout-in-loop", "high")


@detector("d3-missing-setloadfields")
def d3(facts):
    """A retrieval whose loaded fields, since the last reset, lack a field read from the variable later on.

    Key fields are always loaded, flow fields never; a retrieval without later reads is a test of existence.
    """
    access, fields = _needs(facts, "field_accesses", "fields")
    ops = operations(facts)
    w = _var().rowsBetween(W.unboundedPreceding, W.currentRow)
    ops = ops.withColumn("era", F.sum(F.col("op").isin("Reset", "Copy", "Init").cast("int")).over(w))
    since = W.partitionBy("routine_id", "var_key", "era").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    ops = ops.withColumn("loaded", F.array_distinct(F.flatten(F.collect_list(F.when(F.col("op").isin("SetLoadFields", "AddLoadFields"), F.transform("field_args", lambda x: F.lower(x)))).over(since))))
    reads = ops.where(F.col("op").isin("FindSet", "FindFirst", "FindLast", "Get") & ~F.col("known_temp") & ~F.col("is_parameter"))
    a = access.select("routine_id", ascii_lower(F.col("var")).alias("var_key"), F.lower("field").alias("field"), F.struct("anchor.start_line", "anchor.start_col").alias("when"))
    f = fields.select("table_id", F.lower("name").alias("field"), F.coalesce("in_key", F.lit(False)).alias("in_key"), "field_class")
    later = reads.select("op_id", "routine_id", "var_key", "table_id", "loaded", "at").join(a, ["routine_id", "var_key"]).where("when > at").join(f, ["table_id", "field"], "left")
    lacks = later.where("not coalesce(in_key, false) and coalesce(field_class, 'Normal') = 'Normal'").where(~F.array_contains("loaded", F.col("field")))
    return _found(lacks.groupBy("op_id", "routine_id", "table_id").agg(F.count(F.lit(1)).alias("n")), "d3-missing-setloadfields", "medium")


@detector("d5-set-based-opportunity")
def d5(facts):
    """A loop whose only write is one Modify on the variable it walks, without calls and with nothing but filters and load state beside."""
    calls = _needs(facts, "call_sites")[0]
    ops = operations(facts).where("not op like '@%'").select("routine_id", F.explode("loop_stack").alias("loop"), "op", "var_key", "op_id", "table_id", "known_temp")
    quiet = [*FILTER_OPS, "SetLoadFields", "AddLoadFields", "SetCurrentKey", "Next", "Modify"]
    walked = F.min(F.when(F.col("op") == "Next", F.col("var_key")))
    one = ops.groupBy("routine_id", "loop").agg(
        walked.alias("walked"), F.count_if(F.col("op") == "Modify").alias("n"), F.min(F.when(F.col("op") == "Modify", F.struct("op_id", "table_id", "var_key", "known_temp"))).alias("m"), F.bool_and(F.col("op").isin(quiet)).alias("quiet")
    )
    busy = calls.select("routine_id", F.explode("loop_stack").alias("loop")).distinct()
    hit = one.where("n = 1 and quiet and m.var_key = walked and not m.known_temp").join(busy, ["routine_id", "loop"], "left_anti")
    return _found(hit.select("routine_id", "m.op_id", "m.table_id"), "d5-set-based-opportunity", "info", "possible")


@detector("d7-recursive-event-expansion")
def d7(facts):
    """A strong component of two routines or more with an event dispatch inside and a member of the primary application."""
    e = _edges(facts)
    comp = components_of(e.select(F.col("from").alias("src"), F.col("to").alias("dst")), _stage(facts)).where("size >= 2")
    a, b = comp.select(F.col("node").alias("from"), F.col("component").alias("c")), comp.select(F.col("node").alias("to"), F.col("component").alias("d"))
    inside = e.where("kind = 'event-dispatch'").join(a, "from").join(b, "to").where("c = d").select(F.col("c").alias("component")).distinct()
    own = comp.join(_primary(facts).select(F.col("routine_id").alias("node")), "node").groupBy("component").agg(F.min("node").alias("routine_id"))
    return _found(own.join(inside, "component", "left_semi"), "d7-recursive-event-expansion", "high")


def spans(facts: dict, kind: str = "explicit") -> DataFrame:
    """(seed, op_id, member, dist) of transactions that a commit (explicit) or a checked run (implicit) ends.

    Members are the callers, up to 50 calls away and not past another committing routine.
    """
    sites = _needs(facts, "operation_sites")[0]
    explicit = sites.where("kind = 'commit'").select("routine_id", "op_id")
    seeds = explicit if kind == "explicit" else sites.where("kind = 'checked-run'").select("routine_id", "op_id")
    stop = explicit.select(F.col("routine_id").alias("node")).distinct()
    back = _edges(facts).select(F.col("to").alias("src"), F.col("from").alias("dst"))
    start = seeds.select(F.col("routine_id").alias("root"), F.col("routine_id").alias("node")).distinct()
    got = reach_from(start, back, _stage(facts), stop, 50, f"span-{kind}")
    return got.join(seeds.groupBy(F.col("routine_id").alias("root")).agg(F.min("op_id").alias("op_id")), "root").select(F.col("root").alias("seed"), "op_id", F.col("node").alias("member"), "dist")


def _written(facts: dict) -> DataFrame:
    return operations(facts).where(F.col("op").isin(WRITE_OPS) & ~F.col("known_temp") & F.col("table_id").isNotNull() & (F.col("table_id") != "unknown")).select("routine_id", "table_id").distinct()


def span_payload(facts: dict, of: DataFrame) -> DataFrame:
    """(seed, op_id, members, tables, events, complete) of spans: what the members write and publish; a member whose coverage is not complete, or unknown, makes the span incomplete."""
    w = _written(facts).select(F.col("routine_id").alias("member"), "table_id")
    p = _needs(facts, "events")[0].select(F.col("publisher_routine_id").alias("member"), "event_id")
    t = of.join(w, "member").groupBy("seed").agg(F.array_sort(F.collect_set("table_id")).alias("tables"))
    v = of.join(p, "member").groupBy("seed").agg(F.array_sort(F.collect_set("event_id")).alias("events"))
    cover = facts.get("coverage")
    ok = F.lit(True)
    m = of
    if cover is not None:
        m = of.join(cover.select(F.col("routine_id").alias("member"), "status"), "member", "left")
        ok = F.coalesce(F.col("status") == "complete", F.lit(False))
    base = m.groupBy("seed", "op_id").agg(F.count_distinct("member").alias("members"), F.bool_and(ok).alias("complete"))
    none = F.array().cast("array<string>")
    return base.join(t, "seed", "left").join(v, "seed", "left").withColumn("tables", F.coalesce("tables", none)).withColumn("events", F.coalesce("events", none))


def _managing(facts: dict) -> DataFrame:
    """(routine_id) of routines whose name says that they post, or that write three tables or more."""
    many = _written(facts).groupBy("routine_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("routine_id")
    return _needs(facts, "routines.name")[0].where(posting_name(F.col("name"))).select("routine_id").union(many).distinct()


def _managed(facts: dict, kind: str) -> DataFrame:
    s = spans(facts, kind).where("member <> seed")
    return s.join(_managing(facts).select(F.col("routine_id").alias("member")), "member", "left_semi").groupBy("seed", "op_id").agg(F.min("dist").alias("near"))


@detector("d8-commit-in-transaction")
def d8(facts):
    """A commit that runs inside the transaction of a managing caller; one finding for each commit."""
    return _found(_managed(facts, "explicit").select(F.col("seed").alias("routine_id"), "op_id"), "d8-commit-in-transaction", "high")


@detector("d9-transaction-span-summary")
def d9(facts):
    """Transactions over two routines or more that write two tables or are not wholly known."""
    p = span_payload(facts, spans(facts)).where("members >= 2").where((F.size("tables") >= 2) | ~F.col("complete"))
    return _found(p.select(F.col("seed").alias("routine_id"), "op_id"), "d9-transaction-span-summary", "info", "possible")


@detector("d50-checked-run-implicit-commit", opt_in=True)
def d50(facts):
    """A checked Codeunit.Run, which commits, inside the transaction of a managing caller."""
    return _found(_managed(facts, "implicit").select(F.col("seed").alias("routine_id"), "op_id"), "d50-checked-run-implicit-commit", F.when(F.col("op_id").isNotNull(), "medium").otherwise("info"), "possible")


@detector("d14-dead-routine")
def d14(facts):
    """Local routines with a body (internal ones, too, if no friend may see them) that no root reaches."""
    _, objects, _ = _needs(facts, "routines.object_id", "objects.subtype", "combined_edges")
    return _found(dead_routines(facts["routines"], objects, _edges(facts), _stage(facts), bool(facts.get("internal_visible", True))), "d14-dead-routine", "info", "possible")


def _obsolete(state: str) -> Column:
    return F.when(F.col(state) == "removed", "high").otherwise("info")


@detector("d16-obsolete-routine-call")
def d16(facts):
    r = _needs(facts, "routines.obsolete")[0]
    callee = r.where("obsolete in ('pending', 'removed')").select(F.col("routine_id").alias("to"), "obsolete")
    hit = _edges(facts, but=("event-dispatch",)).join(callee, "to").withColumnRenamed("from", "routine_id").join(_primary(facts).select("routine_id"), "routine_id", "left_semi")
    return _found(hit.withColumn("op_id", F.coalesce("operation_id", "callsite_id")), "d16-obsolete-routine-call", _obsolete("obsolete"), "confirmed")


@detector("d17-min-version-drift")
def d17(facts):
    """Dependencies that are there in a higher version than the least declared one, and are called."""
    declared, apps, r = _needs(facts, "declared_dependencies", "apps", "routines.app_guid")
    have = apps.select(F.col("app_guid").alias("dep_guid"), F.col("version").alias("resolved"))
    drift = declared.join(have, "dep_guid").where(version_key(F.col("resolved")) > version_key(F.col("min_version")))
    app = r.select("routine_id", "app_guid")
    called = _edges(facts).join(app.select(F.col("routine_id").alias("from"), "app_guid"), "from").join(app.select(F.col("routine_id").alias("to"), F.col("app_guid").alias("dep_guid")), "to").select("app_guid", "dep_guid", "from")
    hit = called.join(drift, ["app_guid", "dep_guid"], "left_semi").groupBy("app_guid", "dep_guid").agg(F.min("from").alias("routine_id"))
    return _found(hit.withColumn("op_id", F.col("dep_guid")), "d17-min-version-drift", "info", "possible")


@detector("d18-constant-filter-in-loop")
def d18(facts):
    """A filter in a loop whose values are all literals; one for each variable, field and loop."""
    literal = lambda x: F.coalesce(x.rlike(r"^\s*('.*'|-?[0-9][0-9.]*|true|false)\s*$"), F.lit(False))
    ops = operations(facts).where(F.col("op").isin(FILTER_OPS) & (F.size("loop_stack") > 0) & ~F.col("known_temp") & (F.size("field_args") >= 2))
    ops = ops.where(F.forall(F.slice("field_args", 2, 100), literal))
    one = ops.groupBy("routine_id", "loop_id", "var_key", F.lower(F.col("field_args")[0]).alias("field")).agg(F.min_by("op_id", "at").alias("op_id"), F.min_by("table_id", "at").alias("table_id"))
    return _found(one, "d18-constant-filter-in-loop", "low")


@detector("d19-unused-parameter")
def d19(facts):
    """Parameters of procedures that nothing in the body names; triggers and subscribers have no choice."""
    p, refs, r = _needs(facts, "parameters", "identifier_refs", "routines.kind")
    whole = r.where("body_available and not coalesce(parse_incomplete, false) and kind = 'procedure'").select("routine_id")
    named = refs.select("routine_id", ascii_lower(F.col("name")).alias("key")).distinct()
    hit = p.where("coalesce(name, '') <> ''").withColumn("key", ascii_lower(F.col("name"))).join(whole, "routine_id", "left_semi").join(named, ["routine_id", "key"], "left_anti")
    return _found(hit.select("routine_id", F.col("name").alias("op_id")), "d19-unused-parameter", "info")


@detector("d20-unreachable-after-exit")
def d20(facts):
    """The statement right after an exit, error or quit of its block; a break ends its loop only."""
    s = _needs(facts, "statements")[0]
    before = F.lag("kind").over(W.partitionBy("routine_id", "block_id").orderBy("place"))
    hit = s.withColumn("before", before).where("before in ('exit', 'error', 'quit')")
    return _found(hit.select("routine_id", F.col("statement_id").alias("op_id")), "d20-unreachable-after-exit", "low")


@detector("d22-flowfield-without-calcfields")
def d22(facts):
    """A flow field that is read with no CalcFields of it on the variable before; record parameters may come calculated."""
    access, fields = _needs(facts, "field_accesses", "fields")
    flow = fields.where("field_class = 'FlowField'").select("table_id", F.lower("name").alias("field"))
    a = access.where("not coalesce(is_parameter, false)").select("access_id", "routine_id", "table_id", ascii_lower(F.col("var")).alias("var_key"), F.lower("field").alias("field"), F.struct("anchor.start_line", "anchor.start_col").alias("when"))
    calc = operations(facts).where("op = 'CalcFields'").select("routine_id", "var_key", F.explode(F.transform("field_args", lambda x: F.lower(F.trim(F.regexp_replace(x, '"', ""))))).alias("field"), "at")
    first = calc.groupBy("routine_id", "var_key", "field").agg(F.min("at").alias("at"))
    hit = a.join(flow, ["table_id", "field"], "left_semi").join(first, ["routine_id", "var_key", "field"], "left").where("at is null or not at < when")
    return _found(hit.select("routine_id", F.col("access_id").alias("op_id"), "table_id"), "d22-flowfield-without-calcfields", "medium")


@detector("d29-subscriber-modify-on-event-record")
def d29(facts):
    """A subscriber of a modify or delete event that changes the record it is given, with triggers."""
    e, r = _needs(facts, "event_edges", "routines.kind")
    named = e.where(F.lower("event_name").rlike("modify|delete")).select(F.col("subscriber_routine_id").alias("routine_id")).distinct()
    ops = operations(facts).where(F.col("op").isin("Modify", "ModifyAll", "Insert", "Delete", "DeleteAll", "Validate") & F.col("is_parameter") & ~F.col("known_temp"))
    if "run_trigger" in ops.columns:
        ops = ops.where("coalesce(run_trigger, true)")
    subs = r.where("kind = 'event-subscriber'").select("routine_id")
    return _found(ops.join(named, "routine_id", "left_semi").join(subs, "routine_id", "left_semi"), "d29-subscriber-modify-on-event-record", "medium")


def _may_commit(facts: dict, name: str, but: tuple[str, ...] = ()) -> DataFrame:
    """(routine_id, dist) of routines that commit, themselves at 0 or through calls."""
    seeds = _needs(facts, "operation_sites")[0].where("kind = 'commit'").select(F.lit(0).alias("root"), F.col("routine_id").alias("node")).distinct()
    back = _edges(facts, but=but).select(F.col("to").alias("src"), F.col("from").alias("dst"))
    return reach_from(seeds, back, _stage(facts), name=name).select(F.col("node").alias("routine_id"), "dist")


@detector("d34-commit-in-loop")
def d34(facts):
    """Commits inside a loop, and calls inside one whose callee may commit."""
    sites, calls = _needs(facts, "operation_sites", "call_sites")
    own = sites.where((F.col("kind") == "commit") & (F.size("loop_stack") > 0))
    direct = _found(own, "d34-commit-in-loop", F.when(F.size("loop_stack") >= 2, "critical").otherwise("high"))
    inside = calls.where(F.size("loop_stack") > 0).select("callsite_id")
    far = _edges(facts).join(inside, "callsite_id", "left_semi").join(_may_commit(facts, "d34").select(F.col("routine_id").alias("to")), "to", "left_semi")
    return direct.unionByName(_found(far.select(F.col("from").alias("routine_id"), F.col("callsite_id").alias("op_id")).distinct(), "d34-commit-in-loop", "medium", "possible"))


@detector("d35-commit-in-event-subscriber")
def d35(facts):
    """Subscribers that commit: likely where they do it themselves, possible through calls."""
    subs = _needs(facts, "routines.kind")[0].where("kind = 'event-subscriber'").select("routine_id")
    hit = _may_commit(facts, "d35").join(subs, "routine_id", "left_semi")
    one = _found(hit.where("dist = 0"), "d35-commit-in-event-subscriber", "high")
    return one.unionByName(_found(hit.where("dist > 0"), "d35-commit-in-event-subscriber", "high", "possible"))


@detector("d38-subscriber-to-obsolete-event")
def d38(facts):
    e, r = _needs(facts, "event_edges", "routines.obsolete")
    gone = r.where("obsolete in ('pending', 'removed')").select(F.col("routine_id").alias("publisher_routine_id"), "obsolete")
    hit = e.join(gone, "publisher_routine_id").select(F.col("subscriber_routine_id").alias("routine_id"), "obsolete", F.col("event_id").alias("op_id"))
    return _found(hit, "d38-subscriber-to-obsolete-event", _obsolete("obsolete"), "confirmed")


def _passed(facts: dict, *columns: str) -> DataFrame:
    """Calls that pass a record by reference, with the callee's roles and the place of the call."""
    b, roles, *_ = _needs(facts, "bindings", "roles", *(f"roles.{c}" for c in columns))
    r = roles.select(F.col("routine_id").alias("callee"), "position", *columns)
    return b.where("by_ref").join(r, ["callee", "position"]).withColumn("var_key", ascii_lower(F.col("var"))).withColumn("call_at", F.struct("anchor.start_line", "anchor.start_col"))


def _beside(facts: dict, calls: DataFrame, kind: str, later: bool) -> DataFrame:
    """``calls`` without those that an operation of a class follows (or comes before) on the variable in the caller."""
    ops = operations(facts)
    sets = {"persist": ["Modify", "Insert", "Delete", "@persists"], "load": ["Get", "FindFirst", "FindLast", "FindSet", "Find", "Next", "Init", "Insert", "Copy", "@loads"]}[kind]
    o = ops.where(F.col("op").isin(sets)).select("routine_id", "var_key", F.col("op_id").alias("_o"), "at")
    if kind == "load":  # the call itself is no load before itself
        o = o.where("_o is not null")
    hit = calls.join(o, ["routine_id", "var_key"]).where("at > call_at" if later else "at < call_at").select("callsite_id", "var_key").distinct()
    return calls.join(hit, ["callsite_id", "var_key"], "left_anti")


@detector("d39-record-left-dirty-across-chain")
def d39(facts):
    """A callee leaves a record changed and not stored, and the caller does not store it after the call."""
    calls = _passed(facts, "dirty_at_exit").where("dirty_at_exit = 'yes' and not coalesce(known_temp, false)")
    hit = _beside(facts, calls, "persist", True)
    params = operations(facts).where("is_parameter").select("routine_id", "var_key").distinct()
    hit = hit.join(params, ["routine_id", "var_key"], "left_anti")
    return _found(hit.select("routine_id", F.col("callsite_id").alias("op_id")), "d39-record-left-dirty-across-chain", "medium")


@detector("d40-transitive-load-missing", opt_in=True)
def d40(facts):
    """A callee needs its record loaded, and the caller did not load it."""
    calls = _passed(facts, "requires_loaded", "mutates").where("requires_loaded = 'yes'")
    hit = _beside(facts, calls, "load", False)
    params = operations(facts).where("is_parameter").select("routine_id", "var_key").distinct()
    hit = hit.join(params, ["routine_id", "var_key"], "left_anti")
    return _found(hit.select("routine_id", F.col("callsite_id").alias("op_id"), "mutates"), "d40-transitive-load-missing", F.when(F.col("mutates") == "yes", "high").otherwise("medium"))


@detector("d41-transitive-filter-loss")
def d41(facts):
    """The caller filters, a callee resets the filters, and the caller goes on without filtering again."""
    ops = operations(facts)
    calls = _passed(facts, "resets").where("resets = 'yes'").select("callsite_id", "routine_id", "var_key", "call_at")
    filters = ops.where(F.col("op").isin(FILTER_OPS)).select("routine_id", "var_key", F.col("at").alias("f"))
    uses = ops.where(F.col("op").isin("FindSet", "FindFirst", "FindLast", "Find", "Count", "IsEmpty", "ModifyAll", "DeleteAll", "CalcSums")).select("routine_id", "var_key", "op_id", "table_id", F.col("at").alias("u"))
    key = ["routine_id", "var_key"]
    before = calls.join(filters, key).where("f < call_at").select("callsite_id", *key, "call_at").distinct()
    after = before.join(uses, key).where("u > call_at")
    again = after.join(filters, key).where("f > call_at and f < u").select("callsite_id", "op_id").distinct()
    hit = after.join(again, ["callsite_id", "op_id"], "left_anti").groupBy("callsite_id", "routine_id").agg(F.min_by("op_id", "u").alias("op_id"), F.min_by("table_id", "u").alias("table_id"))
    return _found(hit, "d41-transitive-filter-loss", "high")


@detector("d42-cross-call-wrong-setloadfields")
def d42(facts):
    """A callee needs fields that the caller's SetLoadFields before the call leaves out."""
    needs = _passed(facts, "required_fields").where(F.size("required_fields") > 0)
    loads = operations(facts).where("op in ('SetLoadFields', 'AddLoadFields')").select("routine_id", "var_key", F.transform("field_args", lambda x: F.lower(x)).alias("fields"), "at")
    j = needs.join(loads, ["routine_id", "var_key"]).where("at < call_at").groupBy("callsite_id", "routine_id", "required_fields").agg(F.array_distinct(F.flatten(F.collect_list("fields"))).alias("loaded"))
    lacks = F.size(F.array_except(F.transform("required_fields", lambda x: F.lower(x)), "loaded")) > 0
    return _found(j.where(lacks).select("routine_id", F.col("callsite_id").alias("op_id")), "d42-cross-call-wrong-setloadfields", "low")


def _handled_guards(facts: dict) -> DataFrame:
    """Writes that a handled flag guards, with the subscribers that set it and do not write the table: ``handled_guards(routine_id, event_id, op_id, table_id, straight)``, ``handled_setters(routine_id, certain)``."""
    guards, setters, edges = _needs(facts, "handled_guards", "handled_setters", "event_edges")
    subs = edges.select("event_id", F.col("subscriber_routine_id").alias("sub"))
    j = guards.join(subs, "event_id").join(setters.select(F.col("routine_id").alias("sub"), "certain"), "sub")
    writes = _written(facts).select(F.col("routine_id").alias("sub"), "table_id")
    return j.join(writes, ["sub", "table_id"], "left_anti").groupBy("routine_id", "op_id", "table_id").agg(F.bool_or("certain").alias("certain"), F.bool_or("straight").alias("straight"))


@detector("d43-event-ishandled-skip")
def d43(facts):
    """A subscriber may skip a guarded write and does not do it itself."""
    hit = _handled_guards(facts)
    sev = F.when(F.col("certain") & F.col("straight"), "high").when(F.col("certain"), "medium").otherwise("low")
    return _found(hit.where("certain"), "d43-event-ishandled-skip", sev).unionByName(_found(hit.where("not certain"), "d43-event-ishandled-skip", sev, "possible"))


@detector("d61-ishandled-bypasses-critical-write", opt_in=True)
def d61(facts):
    """The sure cases of d43: the flag is provably set."""
    hit = _handled_guards(facts).where("certain")
    return _found(hit.where("straight"), "d61-ishandled-bypasses-critical-write", "high").unionByName(_found(hit.where("not straight"), "d61-ishandled-bypasses-critical-write", "high", "possible"))


def _event_tables(facts: dict) -> DataFrame:
    """(event_id, sub, table_id, w, r) of what each subscriber itself writes and reads; operations of others, and those that do neither, are left out first."""
    edges, recorded = _needs(facts, "event_edges", "record_operations")
    e = edges.select("event_id", F.col("subscriber_routine_id").alias("sub")).distinct()
    heard = recorded.where(F.col("op").isin(*WRITE_OPS, *OP_CLASS["db-read"])).join(edges.select(F.col("subscriber_routine_id").alias("routine_id")), "routine_id", "left_semi")
    ops = operations({**facts, "record_operations": heard}).where(~F.col("known_temp") & F.col("table_id").isNotNull() & (F.col("table_id") != "unknown"))
    one = ops.groupBy(F.col("routine_id").alias("sub"), "table_id").agg(F.bool_or(F.col("op").isin(WRITE_OPS)).alias("w"), F.bool_or(F.col("op").isin(*OP_CLASS["db-read"])).alias("r"))
    return e.join(one, "sub")


@detector("d44-event-multi-subscriber-overlap")
def d44(facts):
    """Two subscribers of one event that write one table, or of which one reads what another writes."""
    g = _event_tables(facts).groupBy("event_id", "table_id").agg(F.count_if("w").alias("writers"), F.count_if(F.col("r") & ~F.col("w")).alias("readers"), F.min(F.when(F.col("w"), F.col("sub"))).alias("routine_id"))
    hit = g.where("writers >= 2 or (writers >= 1 and readers >= 1)").withColumn("op_id", F.col("event_id"))
    return _found(hit, "d44-event-multi-subscriber-overlap", F.when(F.col("writers") >= 2, "medium").otherwise("low"))


@detector("d45-event-transitive-table-exposure")
def d45(facts):
    """Tables that something an event sets off writes, through any chain of subscribers and calls."""
    pubs = _needs(facts, "events")[0].select(F.col("publisher_routine_id").alias("routine_id")).distinct()
    starts = _edges(facts, "event-dispatch").join(pubs.withColumnRenamed("routine_id", "from"), "from", "left_semi").select(F.col("from").alias("root"), F.col("to").alias("node")).distinct()
    got = reach_from(starts, _edges(facts).select(F.col("from").alias("src"), F.col("to").alias("dst")), _stage(facts), name="d45")
    hit = got.join(_written(facts).withColumnRenamed("routine_id", "node"), "node").select(F.col("root").alias("routine_id"), "table_id").distinct()
    return _found(hit, "d45-event-transitive-table-exposure", "info")


@detector("d46-commit-in-lifecycle", opt_in=True)
def d46(facts):
    """Install and upgrade triggers that reach a commit without an event between."""
    r, o = _needs(facts, "routines.object_id", "objects.subtype")
    life = o.where("kind = 'Codeunit' and lower(subtype) in ('install', 'upgrade')").select("object_id")
    roots = r.where("kind = 'trigger'").join(life, "object_id", "left_semi").select("routine_id")
    return _found(_may_commit(facts, "d46", ("event-dispatch",)).join(roots, "routine_id", "left_semi"), "d46-commit-in-lifecycle", "high")


def _labelled(facts: dict, *labels: str) -> DataFrame:
    ops = _needs(facts, "ordered_operations")[0]
    keep = ops.select("op_id", "effect", F.col("method") if "method" in ops.columns else F.lit(None).cast("string").alias("method"))
    return ordering_labels(ops).where(F.col("label").isin(*labels)).join(keep, "op_id")


@detector("d47-io-unsafe-txn", opt_in=True)
def d47(facts):
    """Calls outside with a write pending, or before the commit."""
    hit = _labelled(facts, "WRITE_PENDING_AT_EXTERNAL_IO", "EXTERNAL_IO_BEFORE_COMMIT")
    way = io_direction(F.col("effect"), F.col("method"), F.col("method"))
    hit = hit.withColumn("grade", hazard_grade(F.col("label"), F.col("effect"), way, F.lit(True), F.lit(None).cast("string"))).where("grade not in ('suppressed', 'none')")
    worst = hit.groupBy("routine_id", "op_id").agg(F.max_by("grade", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("grade"))).alias("grade"))
    return _found(worst, "d47-io-unsafe-txn", F.col("grade"))


@detector("d48-io-in-loop", opt_in=True)
def d48(facts):
    """Calls outside in a loop, directly or through calls in one."""
    ops = _needs(facts, "ordered_operations")[0].where(F.col("effect").isin(*EXTERNAL))
    own = ops.withColumn("inside", F.exists("frames", lambda f: f["kind"] == "loop"))
    far = _reached_in_loop(facts, own.select("routine_id").distinct(), "d48")
    hit = own.join(far, "routine_id", "left").where("inside or loop_depth is not null")
    return _found(hit, "d48-io-in-loop", F.when(F.col("effect") == "HTTP", "high").otherwise("medium"))


@detector("d49-uncommitted-write-before-ui", opt_in=True)
def d49(facts):
    return _found(_labelled(facts, "WRITE_PENDING_AT_UI"), "d49-uncommitted-write-before-ui", "high")


@detector("d51-retry-side-effect-duplication", opt_in=True)
def d51(facts):
    """A call outside that changes something, before an error that leaves the routine: a retry does it again."""
    ops = _needs(facts, "ordered_operations")[0]
    io = ops.where(F.col("effect").isin(*EXTERNAL)).where(io_direction(F.col("effect"), F.col("method"), F.col("method")) != "read")
    err = ops.where("effect = 'ERROR_THROW'").select("routine_id", F.struct("op_id", "order_id", "frames").alias("e"))
    trying = _needs(facts, "routines.is_try")[0].where("coalesce(is_try, false)").select("routine_id")
    pairs = io.join(err, "routine_id").where(F.col("order_id") < F.col("e.order_id")).where(may_co_execute(F.col("op_id"), F.col("frames"), F.col("e.op_id"), F.col("e.frames"))).join(trying, "routine_id", "left_anti")
    commit = ops.where("effect = 'COMMIT'").select("routine_id", F.col("order_id").alias("c"))
    sure = pairs.join(commit, "routine_id", "left").groupBy("routine_id", "op_id").agg(F.coalesce(F.bool_or((F.col("c") > F.col("order_id")) & (F.col("c") < F.col("e.order_id"))), F.lit(False)).alias("kept"))
    return _found(sure, "d51-retry-side-effect-duplication", F.when(F.col("kept"), "medium").otherwise("low"))


@detector("d53-ignored-tryfunction-result")
def d53(facts):
    """A TryFunction called as a statement, its result used nowhere and not under asserterror: errors vanish."""
    calls, r = _needs(facts, "call_sites", "routines.is_try")
    tries = r.where("coalesce(is_try, false)").select(F.col("routine_id").alias("to"))
    bare = calls.where("in_statement and not coalesce(under_asserterror, false) and not coalesce(result_used, false)").select("callsite_id")
    hit = _edges(facts).join(tries, "to", "left_semi").join(bare, "callsite_id", "left_semi")
    return _found(hit.select(F.col("from").alias("routine_id"), F.col("callsite_id").alias("op_id")).distinct(), "d53-ignored-tryfunction-result", "high")


@detector("d54-publish-in-tryfunction-cone")
def d54(facts):
    """Publishers that a TryFunction reaches without events or dynamic calls between."""
    tries = _needs(facts, "routines.is_try")[0].where("coalesce(is_try, false)").select("routine_id")
    pubs = _needs(facts, "events")[0].select(F.col("publisher_routine_id").alias("node"), "event_id")
    got = _reach(facts, tries, _edges(facts, but=("event-dispatch", "dynamic")), "d54").join(pubs, "node")
    one = got.groupBy(F.col("root").alias("routine_id"), F.col("event_id").alias("op_id")).agg(F.min("dist").alias("dist"))
    return _found(one.where("dist <= 1"), "d54-publish-in-tryfunction-cone", "medium").unionByName(_found(one.where("dist > 1"), "d54-publish-in-tryfunction-cone", "medium", "possible"))


@detector("d55-event-publish-in-loop")
def d55(facts):
    calls, events = _needs(facts, "call_sites", "events")
    inside = calls.where(F.size("loop_stack") > 0).select("callsite_id", F.size("loop_stack").alias("depth"))
    pubs = events.select(F.col("publisher_routine_id").alias("to")).distinct()
    hit = _edges(facts, but=("event-dispatch",)).join(inside, "callsite_id").join(pubs, "to", "left_semi").select(F.col("from").alias("routine_id"), F.col("callsite_id").alias("op_id"), "depth").distinct()
    return _found(hit, "d55-event-publish-in-loop", F.when(F.col("depth") >= 2, "high").otherwise("medium"))


@detector("d56-clone-before-write-in-loop")
def d56(facts):
    """The loop's record is copied to another variable, and that one is written in the same loop."""
    assign = _needs(facts, "var_assignments")[0].withColumn("loop_id", F.try_element_at("loop_stack", F.lit(-1))).where("loop_id is not null")
    ops = operations(facts).where("loop_id is not null")
    cursor = ops.where("op = 'Next'").select("routine_id", "loop_id", F.col("var_key").alias("source_key")).distinct()
    copies = assign.select("routine_id", "loop_id", ascii_lower(F.col("target")).alias("var_key"), ascii_lower(F.col("source")).alias("source_key"), F.struct("anchor.start_line", "anchor.start_col").alias("copied")).join(cursor, ["routine_id", "loop_id", "source_key"], "left_semi")
    writes = ops.where(F.col("op").isin("Modify", "Delete", "Insert") & ~F.col("known_temp"))
    hit = writes.join(copies, ["routine_id", "loop_id", "var_key"]).where("copied < at").dropDuplicates(["op_id"])
    return _found(hit, "d56-clone-before-write-in-loop", "medium")


@detector("d57-singleinstance-growing-state")
def d57(facts):
    """A subscriber in a single-instance object that grows a global collection which nothing in the object clears."""
    r, o, g = _needs(facts, "routines.object_id", "objects.single_instance", "global_mutations")
    single = o.where("coalesce(single_instance, false)").select("object_id")
    m = g.withColumn("key", ascii_lower(F.col("variable")))
    grows = m.where("kind = 'grow'").join(r.where("kind = 'event-subscriber'").select("routine_id", "object_id"), "routine_id").join(single, "object_id", "left_semi")
    clears = m.where("kind = 'clear'").join(r.select("routine_id", "object_id"), "routine_id").select("object_id", "key").distinct()
    hit = grows.join(clears, ["object_id", "key"], "left_anti").select("routine_id", F.col("variable").alias("op_id")).distinct()
    return _found(hit, "d57-singleinstance-growing-state", "medium", "possible")


@detector("d58-query-filter-after-open")
def d58(facts):
    """A query that is filtered while it is open; Close arms it again."""
    q = _needs(facts, "query_operations")[0].withColumn("key", ascii_lower(F.col("var")))
    w = W.partitionBy("routine_id", "key").orderBy(F.struct("anchor.start_line", "anchor.start_col")).rowsBetween(W.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") == "Open", True).when(F.col("op") == "Close", False), True).over(w)
    return _found(q.withColumn("open", F.coalesce(state, F.lit(False))).where("open and op in ('SetFilter', 'SetRange')"), "d58-query-filter-after-open", "medium")


@detector("d60-upgrade-loop-should-be-datatransfer")
def d60(facts):
    """An install or upgrade loop that does nothing but modify row by row."""
    r, o, calls = _needs(facts, "routines.object_id", "objects.subtype", "call_sites")
    life = r.join(o.where("kind = 'Codeunit' and lower(subtype) in ('install', 'upgrade')").select("object_id"), "object_id", "left_semi").select("routine_id")
    ops = operations(facts).where("not op like '@%'").join(life, "routine_id", "left_semi").select("routine_id", F.explode("loop_stack").alias("loop"), "op", "op_id", "table_id", "known_temp")
    g = ops.groupBy("routine_id", "loop").agg(F.count_if(F.col("op") == "Modify").alias("n"), F.bool_and(F.col("op").isin("Modify", "Next")).alias("pure"), F.min(F.when(F.col("op") == "Modify", F.struct("op_id", "table_id", "known_temp"))).alias("m"))
    busy = calls.select("routine_id", F.explode("loop_stack").alias("loop")).distinct()
    hit = g.where("n >= 1 and pure and not m.known_temp").join(busy, ["routine_id", "loop"], "left_anti").select("routine_id", "m.op_id", "m.table_id")
    return _found(hit, "d60-upgrade-loop-should-be-datatransfer", "medium")


@detector("d62-telemetry-before-success", opt_in=True)
def d62(facts):
    """Usage is logged before a write or an error that may still follow on the same run."""
    ops = _needs(facts, "ordered_operations")[0]
    log = ops.where("effect = 'TELEMETRY' and lower(coalesce(method, '')) = 'logusage'")
    more = ops.where(F.col("effect").isin("DB_INSERT", "DB_MODIFY", "DB_DELETE", "ERROR_THROW")).select("routine_id", F.struct("op_id", "order_id", "frames").alias("x"))
    hit = log.join(more, "routine_id").where(F.col("order_id") < F.col("x.order_id")).where(may_co_execute(F.col("op_id"), F.col("frames"), F.col("x.op_id"), F.col("x.frames"))).select("routine_id", "op_id").distinct()
    return _found(hit, "d62-telemetry-before-success", "low", "possible")


def html_concat(text: Column) -> Column:
    """Whether an expression joins a literal with markup and something that is no literal."""
    return text.rlike(r"'[^']*<[a-zA-Z/][^']*'\s*\+") & F.regexp_replace(text, "'[^']*'", "").rlike("[A-Za-z_]")


@detector("d63-html-concat-injection", opt_in=True)
def d63(facts):
    calls = _needs(facts, "call_sites")[0]
    return _found(calls.where(F.exists("args", lambda a: F.coalesce(html_concat(a["text"]), F.lit(False)))).select("routine_id", F.col("callsite_id").alias("op_id")), "d63-html-concat-injection", "low", "possible")


@detector("d64-api-page-write-surface", opt_in=True)
def d64(facts):
    """An API page that is not editable but lets rows be inserted, changed or deleted; or that says nothing of it."""
    o = _needs(facts, "objects.page_type")[0].where("kind = 'Page' and lower(page_type) = 'api'")
    writes = [F.col(c) for c in ("insert_allowed", "modify_allowed", "delete_allowed")]
    silent = writes[0].isNull() & writes[1].isNull() & writes[2].isNull()
    open_ = (F.col("editable") == F.lit(False)) & (F.coalesce(writes[0], F.lit(True)) | F.coalesce(writes[1], F.lit(True)) | F.coalesce(writes[2], F.lit(True)))
    hit = o.withColumn("open", F.coalesce(open_ & ~silent, F.lit(False))).where(F.col("open") | (silent & F.col("editable").isNull()))
    return _found(hit.select(F.lit(None).cast("string").alias("routine_id"), F.col("object_id").alias("op_id"), "open"), "d64-api-page-write-surface", F.when(F.col("open"), "low").otherwise("info"), "possible")
