"""Name resolution as joins over program facts.

Every lookup declines rather than guesses: the caller's own application shadows
its dependencies, then exactly one visible match counts, more are ambiguous.
``sites`` always come back whole, with an outcome each, so coverage can be
asserted by set equality. Names are compared by ``folded`` keys.

Facts: ``apps(app_guid)``, ``app_deps(app_guid, dep_guid)``, ``objects(object_id, app_guid,
kind, number, name, extends, implements, source_table)``, ``routines(routine_id,
object_id, name, kind, access, arity)``, ``parameters(routine_id, position, type, by_ref,
length)``, ``fields(table_id, field_id, name)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import folded, strip_quotes
from graphloom.operators.closure import reach_from
from graphloom.storage import Stage


def dependency_topology(manifests: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_guid, dep_guid) of declared dependencies ``manifests(app_guid, dependencies)`` that are there, by guid in any case."""
    want = manifests.select("app_guid", F.explode("dependencies").alias("d")).select("app_guid", F.lower("d.id").alias("k"))
    return want.join(apps.select(F.col("app_guid").alias("dep_guid"), F.lower("app_guid").alias("k")).distinct(), "k").select("app_guid", "dep_guid").distinct()


def friend_apps(manifests: DataFrame, apps: DataFrame) -> DataFrame:
    """(app_guid, friend_guid): applications that may see the internals of ``manifests(app_guid, internals_visible_to)``."""
    want = manifests.select("app_guid", F.explode("internals_visible_to").alias("d")).select("app_guid", F.lower("d.id").alias("k"))
    return want.join(apps.select(F.col("app_guid").alias("friend_guid"), F.lower("app_guid").alias("k")).distinct(), "k").select("app_guid", "friend_guid").distinct()


def app_closure(apps: DataFrame, app_deps: DataFrame, stage: Stage) -> DataFrame:
    """(app_guid, visible_guid): each application and all that it depends on, through any number of steps."""
    seeds = apps.select(F.col("app_guid").alias("root"), F.col("app_guid").alias("node")).distinct()
    edges = app_deps.select(F.col("app_guid").alias("src"), F.col("dep_guid").alias("dst"))
    return reach_from(seeds, edges, stage, name="apps").select(F.col("root").alias("app_guid"), F.col("node").alias("visible_guid"))


def _pick(sites: DataFrame, key: Column, found: DataFrame, closure: DataFrame, target: str) -> DataFrame:
    """``sites(site_id, app_guid, kind, ...)`` with target and outcome, by a key, from ``found(visible_guid, kind, key, <target>)``.

    What an application sees under a key is found once, however many of its sites ask for it: sites
    are never joined by their application, of which there are few.
    """
    asks = ["app_guid", "kind", "key"]
    keyed = sites.select("site_id", "app_guid", "kind", key.alias("key"))
    seen = keyed.select(*asks).distinct().join(closure.select("app_guid", "visible_guid").distinct(), "app_guid").join(found, ["visible_guid", "kind", "key"])
    own = F.when(F.col("app_guid") == F.col("visible_guid"), F.col(target))
    seen = seen.groupBy(*asks).agg(F.min(own).alias("own"), F.min(target).alias("one"), F.max(target).alias("last"))
    got = keyed.join(seen, asks).groupBy("site_id").agg(F.min("own").alias("own"), F.min("one").alias("one"), F.max("last").alias("last"))
    out = sites.join(got, "site_id", "left")
    return out.withColumn(target, F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("one") == F.col("last"), F.col("one"))).withColumn(
        "outcome", F.when(F.col("own").isNotNull(), "own").when(F.col("one") == F.col("last"), "dependency").when(F.col("one").isNotNull(), "ambiguous").otherwise("not-found")
    ).drop("own", "one", "last")


def resolve_object(sites: DataFrame, objects: DataFrame, closure: DataFrame) -> DataFrame:
    """``sites(site_id, app_guid, kind, name)`` with ``object_id`` and ``outcome``: own, dependency, ambiguous or not-found.

    Several own objects of one name count as the least id, as a same-app duplicate is one declaration.
    """
    per_app = objects.groupBy(F.col("app_guid").alias("visible_guid"), "kind", folded(F.col("name")).alias("key")).agg(F.min("object_id").alias("object_id"))
    return _pick(sites, folded(strip_quotes(F.col("name"))), per_app, closure, "object_id")


def object_by_number(sites: DataFrame, objects: DataFrame, closure: DataFrame) -> DataFrame:
    """``sites(site_id, app_guid, kind, number)`` resolved by declared number, by the same rule."""
    per_app = objects.where("number is not null").groupBy(F.col("app_guid").alias("visible_guid"), "kind", F.col("number").alias("key")).agg(F.min("object_id").alias("object_id"))
    return _pick(sites, F.col("number"), per_app, closure, "object_id")


def resolve_object_ref(sites: DataFrame, objects: DataFrame, closure: DataFrame) -> DataFrame:
    """``sites(site_id, app_guid, kind, ref)`` by number where the text is one, else by name: Resolved, Ambiguous or NotFound."""
    number = F.expr("try_cast(ref as bigint)")
    by_number = object_by_number(sites.where(number.isNotNull()).withColumn("number", number), objects, closure).drop("number")
    by_name = resolve_object(sites.where(number.isNull()).withColumn("name", F.col("ref")), objects, closure).drop("name")
    status = F.when(F.col("object_id").isNotNull(), "Resolved").when(F.col("outcome") == "ambiguous", "Ambiguous").otherwise("NotFound")
    return by_number.unionByName(by_name).withColumn("outcome", status)


def extensions_of(objects: DataFrame, base_kind: str) -> DataFrame:
    """(base_id, extension_id) of objects of ``base_kind`` and those that extend them by name."""
    base = objects.where(F.col("kind") == base_kind).select(F.col("object_id").alias("base_id"), folded(F.col("name")).alias("key"))
    ext = objects.where((F.col("kind") == base_kind + "Extension") & F.col("extends").isNotNull()).select(F.col("object_id").alias("extension_id"), folded(strip_quotes(F.col("extends"))).alias("key"))
    return base.join(ext, "key").select("base_id", "extension_id")


def object_extends(pairs: DataFrame, objects: DataFrame, base_kinds: list[str]) -> DataFrame:
    """The ``pairs(from_id, target_id)`` whose first object extends the second; protected members are visible to it."""
    known = None
    for k in base_kinds:
        one = extensions_of(objects, k)
        known = one if known is None else known.unionByName(one)
    return pairs.join(known.select(F.col("extension_id").alias("from_id"), F.col("base_id").alias("target_id")), ["from_id", "target_id"], "left_semi")


def implementers_of(objects: DataFrame) -> DataFrame:
    """(interface_key, object_id) of every object that implements an interface."""
    one = objects.select("object_id", F.explode("implements").alias("i"))
    return one.select(folded(strip_quotes(F.col("i"))).alias("interface_key"), "object_id").distinct()


def field_in_table(sites: DataFrame, fields: DataFrame, objects: DataFrame, closure: DataFrame) -> DataFrame:
    """``sites(site_id, app_guid, table_id, field)`` with ``field_id``: the table's own field first, else one of a visible extension."""
    ext = extensions_of(objects, "Table").join(objects.select(F.col("object_id").alias("extension_id"), "app_guid"), "extension_id")
    key = folded(F.col("name"))
    own = fields.select("table_id", key.alias("key"), "field_id", F.lit(None).cast("string").alias("visible_guid"), F.lit(0).alias("tier"))
    more = fields.join(ext, fields["table_id"] == ext["extension_id"]).select(ext["base_id"].alias("table_id"), key.alias("key"), "field_id", ext["app_guid"].alias("visible_guid"), F.lit(1).alias("tier"))
    hit = sites.select("site_id", "app_guid", "table_id", folded(strip_quotes(F.col("field"))).alias("key")).join(own.unionByName(more), ["table_id", "key"])
    seen = closure.select("app_guid", "visible_guid")
    hit = hit.where("tier = 0").drop("visible_guid").unionByName(hit.where("tier = 1").join(seen, ["app_guid", "visible_guid"]).drop("visible_guid"))
    best = hit.groupBy("site_id").agg(F.min("tier").alias("tier"), F.min_by("field_id", F.struct("tier", "field_id")).alias("field_id"), F.count_if(F.col("tier") == 1).alias("n"))
    ok = (F.col("tier") == 0) | (F.col("n") == 1)
    return sites.join(best.select("site_id", F.when(ok, F.col("field_id")).alias("field_id")), "site_id", "left")


#: Types whose values convert into one another, so that a mismatch proves nothing.
SOFT_FAMILIES = (("text", "code", "char", "label"), ("integer", "decimal", "biginteger"))
#: Target types that a literal may mean without proof.
LITERAL_FORBIDDEN = {"text": ("code", "char"), "integer": ("decimal", "biginteger")}
_ANY = ("variant", "any")


def same_soft_family(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for family in SOFT_FAMILIES:
        out = out | (a.isin(*family) & b.isin(*family))
    return out


def _position_terms(arg: str, par: str) -> tuple[Column, Column]:
    """(exact match, provably incompatible) of one argument and one parameter: structs (type, length, var_passable) and (type, length, by_ref)."""
    a, p = F.lower(F.col(f"{arg}.type")), F.lower(F.col(f"{par}.type"))
    same = F.coalesce(a == p, F.lit(False))
    by_ref = F.coalesce(F.col(f"{par}.by_ref"), F.lit(False))
    length = F.col(f"{arg}.length").eqNullSafe(F.col(f"{par}.length"))
    binds = F.coalesce(F.col(f"{arg}.var_passable"), F.lit(False)) & length
    exact = same & (~by_ref | binds)
    clash = a.isNotNull() & F.when(same, by_ref & ~binds).otherwise(~same_soft_family(a, p))
    return exact, F.coalesce(clash, F.lit(False))


def pick_overload(arguments: DataFrame, candidates: DataFrame, parameters: DataFrame) -> DataFrame:
    """(site_id, routine_id, outcome): the one candidate that matches exactly while all others are provably incompatible.

    ``arguments(site_id, position, type, length, var_passable, literal)``,
    ``candidates(site_id, routine_id)`` of equal arity, ``parameters(routine_id, position,
    type, length, by_ref)``. A single candidate is exact as it is. An untyped
    argument, a Variant where candidates differ, or a literal that one of several
    families could take leave the site ambiguous.
    """
    a = arguments.select("site_id", "position", F.struct("type", "length", "var_passable").alias("arg"), F.lower("literal").alias("literal"))
    p = parameters.select("routine_id", "position", F.struct("type", "length", "by_ref").alias("par"))
    pos = candidates.distinct().join(p, "routine_id").join(a, ["site_id", "position"])
    exact, clash = _position_terms("arg", "par")
    t = F.lower(F.col("par.type"))
    at = W.partitionBy("site_id", "position")
    differ = (F.min(t).over(at) != F.max(t).over(at)) | (F.min(F.col("par.by_ref")).over(at) != F.max(F.col("par.by_ref")).over(at))
    wild = differ & (F.max(t.isin(*_ANY).cast("int")).over(at) == 1)
    unsure = F.lit(False)
    for kind, families in LITERAL_FORBIDDEN.items():
        unsure = unsure | ((F.col("literal") == kind) & (F.max(t.isin(*families).cast("int")).over(at) == 1))
    stop = F.col("arg.type").isNull() | wild | F.coalesce(unsure, F.lit(False))
    each = pos.select("site_id", "routine_id", exact.alias("exact"), clash.alias("clash"), stop.alias("stop"))
    each = each.groupBy("site_id", "routine_id").agg(F.bool_and("exact").alias("exact"), F.bool_or("clash").alias("clash"), F.bool_or("stop").alias("stop"))
    judged = candidates.distinct().join(each, ["site_id", "routine_id"], "left")
    e, c = F.coalesce("exact", F.lit(False)), F.coalesce("clash", F.lit(False))
    by_site = judged.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e).alias("n_exact"), F.count_if(~e & ~c).alias("undecided"), F.coalesce(F.bool_or("stop"), F.lit(False)).alias("stop"),
        F.min(F.when(e, F.col("routine_id"))).alias("exact_id"), F.min("routine_id").alias("only_id"),
    )
    picked = (F.col("n_exact") == 1) & (F.col("undecided") == 0) & ~F.col("stop")
    # an exact match may clash with nothing, so the others must clash
    return by_site.select("site_id", F.when(F.col("n") == 1, F.col("only_id")).when(picked, F.col("exact_id")).alias("routine_id"), F.when(F.col("n") == 1, "exact").when(picked, "picked").otherwise("ambiguous").alias("outcome"))


def by_name_and_arity(sites: DataFrame, routines: DataFrame) -> DataFrame:
    """``sites(site_id, object_id, method, arity)`` with every routine of that object and name; of the arity if any has it, else all."""
    r = routines.select("object_id", folded(F.col("name")).alias("key"), "routine_id", F.col("arity").alias("has"))
    hit = sites.withColumn("key", folded(strip_quotes(F.col("method")))).join(r, ["object_id", "key"])
    fits = F.max((F.col("has") == F.col("arity")).cast("int")).over(W.partitionBy("site_id"))
    tier = F.when(fits == 1, "arity").otherwise("name")
    return hit.withColumn("tier", tier).where("tier = 'name' or has = arity").select("site_id", "routine_id", "tier")


def interface_dispatch(sites: DataFrame, objects: DataFrame, routines: DataFrame) -> DataFrame:
    """One route for every implementer of ``sites(site_id, interface, method, arity)``: its routine, or none where the member is absent or ambiguous."""
    imp = implementers_of(objects)
    each = sites.withColumn("interface_key", folded(strip_quotes(F.col("interface")))).join(imp, "interface_key", "left")
    r = routines.where("coalesce(access, 'public') <> 'local'").select("object_id", folded(F.col("name")).alias("key"), "arity", "routine_id")
    hit = each.withColumn("key", folded(strip_quotes(F.col("method")))).join(r, ["object_id", "key", "arity"], "left")
    one = hit.groupBy("site_id", "object_id").agg(F.count("routine_id").alias("n"), F.min("routine_id").alias("routine_id"))
    return one.select("site_id", "object_id", F.when(F.col("n") == 1, F.col("routine_id")).alias("routine_id"), F.when(F.col("object_id").isNull(), "no-implementer").when(F.col("n") == 1, "routine").when(F.col("n") > 1, "ambiguous").otherwise("absent").alias("outcome"))


#: The trigger that an operation runs, and how sure it is.
TRIGGERS = {"Validate": ("OnValidate", "resolved"), "Insert": ("OnInsert", "maybe"), "Modify": ("OnModify", "maybe"), "Delete": ("OnDelete", "maybe"), "Rename": ("OnRename", "maybe")}


def implicit_trigger_edges(operations: DataFrame, triggers: DataFrame, objects: DataFrame, legacy: bool = False) -> DataFrame:
    """(from, to, operation_id, resolution): triggers of the operation's table and its extensions.

    ``operations(operation_id, routine_id, op, table_id, run_trigger, field)``,
    ``triggers(routine_id, object_id, name, member)``. RunTrigger false runs none; a
    Validate runs its field's. The legacy map has no Rename.
    """
    known = {k: v for k, v in TRIGGERS.items() if not legacy or k != "Rename"}
    trigger = F.create_map(*(F.lit(x) for k, (t, _) in known.items() for x in (k, t)))
    sure = F.create_map(*(F.lit(x) for k, (_, s) in known.items() for x in (k, s)))
    ops = operations.where(F.col("op").isin(*known) & F.coalesce("run_trigger", F.lit(True)) & F.col("table_id").isNotNull())
    ops = ops.where("op <> 'Validate' or field is not null").withColumn("key", folded(trigger[F.col("op")])).withColumn("member_key", F.when(F.col("op") == "Validate", folded(strip_quotes(F.col("field")))).otherwise(""))
    ext = extensions_of(objects, "Table").select(F.col("base_id").alias("table_id"), F.col("extension_id").alias("object_id"))
    own = ops.select("table_id").distinct().withColumn("object_id", F.col("table_id"))
    where = own.unionByName(ext.join(own.select("table_id"), "table_id", "left_semi")).distinct()
    t = triggers.select("object_id", folded(F.col("name")).alias("key"), F.coalesce(folded(strip_quotes(F.col("member"))), F.lit("")).alias("member_key"), F.col("routine_id").alias("to"))
    hit = ops.join(where, "table_id").join(t, ["object_id", "key", "member_key"])
    return hit.select(F.col("routine_id").alias("from"), "to", "operation_id", sure[F.col("op")].alias("resolution"))


#: What an object runs when it is run.
ENTRY_TRIGGERS = {"Codeunit": "OnRun", "Page": "OnOpenPage", "Report": "OnPreReport"}


def object_run(sites: DataFrame, objects: DataFrame, closure: DataFrame, routines: DataFrame) -> DataFrame:
    """``sites(site_id, app_guid, kind, ref)`` of X.Run with the entry trigger; no static target is dynamic, a missing object opaque."""
    static = resolve_object_ref(sites.where("ref is not null"), objects, closure)
    entry = F.create_map(*(F.lit(x) for k, v in ENTRY_TRIGGERS.items() for x in (k, v.lower())))
    r = routines.select("object_id", folded(F.col("name")).alias("key"), "routine_id")
    out = static.withColumn("key", entry[F.col("kind")]).join(r, ["object_id", "key"], "left").select("site_id", "object_id", "routine_id", F.when(F.col("object_id").isNull(), "opaque").when(F.col("routine_id").isNull(), "no-entry").otherwise("routine").alias("outcome"))
    none = F.lit(None).cast("string")
    return out.unionByName(sites.where("ref is null").select("site_id", none.alias("object_id"), none.alias("routine_id"), F.lit("dynamic").alias("outcome")))


def resolve_bare(sites: DataFrame, objects: DataFrame, routines: DataFrame, builtins: DataFrame) -> DataFrame:
    """``sites(site_id, object_id, method, arity, under_with)`` of calls without a receiver.

    Tiers: own object, the object it extends, its implicit record's table and that
    table's extensions, the global builtins ``builtins(name)``. The first tier with
    a routine of name and arity decides; several there are ambiguous. A call
    under ``with`` may bind elsewhere and is declined.
    """
    base_of = None
    for k in ("Table", "Page", "Report", "Enum"):
        one = extensions_of(objects, k).select(F.col("extension_id").alias("object_id"), F.col("base_id").alias("scope_id"))
        base_of = one if base_of is None else base_of.unionByName(one)
    table = objects.where("source_table is not null").select("object_id", folded(strip_quotes(F.col("source_table"))).alias("key"))
    tables = objects.where("kind = 'Table'").select(F.col("object_id").alias("scope_id"), folded(F.col("name")).alias("key"))
    rec = table.join(tables, "key").select("object_id", "scope_id")
    rec_ext = rec.join(extensions_of(objects, "Table"), F.col("scope_id") == F.col("base_id")).select("object_id", F.col("extension_id").alias("scope_id"))
    scope = objects.select("object_id", F.col("object_id").alias("scope_id"), F.lit(0).alias("tier"))
    scope = scope.unionByName(base_of.withColumn("tier", F.lit(1))).unionByName(rec.unionByName(rec_ext).withColumn("tier", F.lit(2)))
    keyed = sites.withColumn("key", folded(strip_quotes(F.col("method"))))
    r = routines.select(F.col("object_id").alias("scope_id"), F.col("object_id").alias("home"), folded(F.col("name")).alias("key"), "arity", "routine_id", "access")
    hit = keyed.select("site_id", "object_id", "key", "arity").join(scope, "object_id").join(r, ["scope_id", "key", "arity"])
    hit = hit.where("home = object_id or coalesce(access, 'public') <> 'local'")
    hit = hit.withColumn("best", F.min("tier").over(W.partitionBy("site_id"))).where("tier = best")
    one = hit.groupBy("site_id").agg(F.count_distinct("routine_id").alias("n"), F.min("routine_id").alias("routine_id"), F.min("tier").alias("tier"))
    known = builtins.select(folded(F.col("name")).alias("key")).distinct().withColumn("builtin", F.lit(True))
    out = keyed.join(one, "site_id", "left").join(known, "key", "left")
    guarded = F.coalesce("under_with", F.lit(False))
    outcome = F.when(guarded, "declined").when(F.col("n") == 1, "routine").when(F.col("n") > 1, "ambiguous").when(F.col("builtin"), "builtin").otherwise("unknown")
    return out.select("site_id", F.when(outcome == "routine", F.col("routine_id")).alias("routine_id"), outcome.alias("outcome"), F.when(F.col("n") > 0, F.element_at(F.array(*map(F.lit, ("own", "base", "record"))), (F.col("tier") + 1).cast("int"))).alias("tier"))


def resolve_member(sites: DataFrame, objects: DataFrame, routines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``sites(site_id, receiver_kind, object_id, method, arity)`` of calls on a typed receiver.

    Record: the catalog ``catalog(receiver_kind, method)`` first, then the table and
    its extensions. Object and SelfObject: routines of the object, a codeunit's
    Run its entry trigger. Other kinds know the catalog alone; Dynamic has no target.
    """
    key = folded(strip_quotes(F.col("method")))
    keyed = sites.withColumn("key", key)
    cat = catalog.select("receiver_kind", folded(F.col("method")).alias("key")).distinct().withColumn("builtin", F.lit(True))
    keyed = keyed.join(cat, ["receiver_kind", "key"], "left")
    ext = extensions_of(objects, "Table").select(F.col("base_id").alias("object_id"), F.col("extension_id").alias("scope_id"))
    own = objects.select("object_id", F.col("object_id").alias("scope_id"))
    wants = keyed.where("(receiver_kind = 'Record' and builtin is null) or receiver_kind in ('Object', 'SelfObject')")
    kinds = objects.select("object_id", F.col("kind").alias("object_kind"))
    wants = wants.join(kinds, "object_id", "left")
    run = (F.col("object_kind") == "Codeunit") & (F.col("key") == "run")
    wants = wants.withColumn("any_arity", F.coalesce(run, F.lit(False))).withColumn("key", F.when(F.col("any_arity"), "onrun").otherwise(F.col("key")))
    scope = own.unionByName(ext)
    r = routines.select(F.col("object_id").alias("scope_id"), folded(F.col("name")).alias("key"), F.col("arity").alias("has"), "routine_id", "access")
    hit = wants.join(scope, "object_id").join(r, ["scope_id", "key"]).where("(any_arity or has = arity) and (receiver_kind = 'SelfObject' or coalesce(access, 'public') <> 'local')")
    one = hit.groupBy("site_id").agg(F.count_distinct("routine_id").alias("n"), F.min("routine_id").alias("routine_id"))
    out = keyed.join(one, "site_id", "left")
    outcome = F.when(F.col("receiver_kind") == "Dynamic", "dynamic").when(F.col("n") == 1, "routine").when(F.col("n") > 1, "ambiguous").when(F.col("builtin"), "builtin").otherwise("unknown")
    return out.select("site_id", F.when(outcome == "routine", F.col("routine_id")).alias("routine_id"), outcome.alias("outcome"))


def argument_bindings(calls: DataFrame, arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """(site_id, position, routine_id, by_ref, source_kind, source, arity_ok) of resolved calls ``calls(site_id, routine_id)``; arguments beyond the parameters are left unbound."""
    p = parameters.select("routine_id", "position", "by_ref", F.col("name").alias("parameter"))
    size = parameters.groupBy("routine_id").agg((F.max("position") + 1).alias("takes"))
    bound = calls.join(arguments, "site_id").join(p, ["routine_id", "position"], "left").join(size, "routine_id", "left")
    return bound.select("site_id", "position", "routine_id", "parameter", "by_ref", "source_kind", "source", (F.col("position") < F.coalesce("takes", F.lit(0))).alias("bound"))


def event_graph(publishers: DataFrame, subscribers: DataFrame, objects: DataFrame) -> DataFrame:
    """(event_id, subscriber_routine_id, subscriber_app_id, publisher_routine_id, resolution) of ``subscribers(routine_id, app_guid, target_kind, target_name, event, arity)``.

    ``publishers(routine_id, object_id, name, arity, include_sender)``. Object found
    and its publisher known: resolved (also with too many parameters: the arity
    shows in ``arity_ok``); publisher not known: maybe, under an event id of its
    own; object not found: unknown, under a sentinel.
    """
    target = objects.groupBy(F.col("kind").alias("target_kind"), folded(F.col("name")).alias("target_key")).agg(F.min("object_id").alias("object_id"))
    pub = publishers.groupBy("object_id", folded(F.col("name")).alias("event_key")).agg(F.min(F.struct(F.col("routine_id").alias("id"), (F.col("arity") + F.coalesce("include_sender", F.lit(False)).cast("int")).alias("takes"))).alias("p"))
    s = subscribers.withColumn("target_key", folded(strip_quotes(F.col("target_name")))).withColumn("event_key", folded(strip_quotes(F.col("event"))))
    j = s.join(target, ["target_kind", "target_key"], "left").join(pub, ["object_id", "event_key"], "left")
    resolution = F.when(F.col("object_id").isNull(), "unknown").when(F.col("p").isNull(), "maybe").otherwise("resolved")
    home = F.coalesce("object_id", F.concat(F.lit("?"), F.col("target_kind"), F.lit("/"), F.col("target_key")))
    return j.select(F.concat_ws("#", home, "event_key").alias("event_id"), F.col("routine_id").alias("subscriber_routine_id"), F.col("app_guid").alias("subscriber_app_id"), F.col("p.id").alias("publisher_routine_id"), resolution.alias("resolution"), F.coalesce(F.col("arity") <= F.col("p.takes"), F.lit(False)).alias("arity_ok"))


def event_flow(edges: DataFrame) -> DataFrame:
    """Resolved edges of an event graph, as (publisher_routine_id, subscriber_routine_id, event_id)."""
    return edges.where("resolution = 'resolved'").select("publisher_routine_id", "subscriber_routine_id", "event_id").distinct()


def cross_app_subscribers(edges: DataFrame, routines: DataFrame) -> DataFrame:
    """Resolved event edges whose subscriber lives in another application than the publisher."""
    pub = routines.select(F.col("routine_id").alias("publisher_routine_id"), F.col("app_guid").alias("publisher_app_id"))
    return edges.where("resolution = 'resolved'").join(pub, "publisher_routine_id").where("subscriber_app_id <> publisher_app_id")


def combined_graph(calls: DataFrame, events: DataFrame, implicit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, uncertainties): call edges, event dispatch hops and implicit triggers; what has no target is an uncertainty.

    ``calls(from, to, kind, callsite_id, operation_id, resolution)``.
    """
    cols = ["from", "to", "kind", "callsite_id", "operation_id", "event_id", "resolution"]
    none = F.lit(None).cast("string")
    a = calls.withColumn("event_id", none).select(cols)
    b = event_flow(events).select(F.col("publisher_routine_id").alias("from"), F.col("subscriber_routine_id").alias("to"), F.lit("event-dispatch").alias("kind"), none.alias("callsite_id"), none.alias("operation_id"), "event_id", F.lit("resolved").alias("resolution"))
    c = implicit.select("from", "to", F.lit("implicit-trigger").alias("kind"), none.alias("callsite_id"), "operation_id", none.alias("event_id"), "resolution")
    every = a.unionByName(b).unionByName(c)
    return every.where("to is not null"), every.where("to is null").drop("to")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Edges dealt by their target, each target's sources in order."""
    return edges.repartition("to").sortWithinPartitions("to", "from")


def classify(edges: DataFrame) -> DataFrame:
    """``edges(edge_id, shape, partial, routes array<struct<target, evidence, conditions>>)`` with ``outcome`` and ``evidence``.

    A route is real if its evidence is known and its target resolved. A set of
    overloads is AmbiguousResolved only if every route is real and marked so.
    """
    real = lambda r: (r["evidence"] != "unknown") & (r["target"] != "unresolved")
    default = lambda r: real(r) & ~F.array_contains(r["conditions"], "ManualBinding")
    routes = F.coalesce("routes", F.array().cast("array<struct<target:string,evidence:string,conditions:array<string>>>"))
    some, overload = F.size(routes) > 0, F.col("shape") == "AmbiguousOverload"
    whole = F.forall(routes, lambda r: real(r) & F.array_contains(r["conditions"], "AmbiguousDispatch"))
    outcome = (
        F.when(overload & some & whole, "AmbiguousResolved")
        .when(overload & some, "Unknown")
        .when(F.exists(routes, default), "Resolved")
        .when(F.exists(routes, real), "ConditionalResolved")
        .when(F.col("shape") == "DynamicOpen", "HonestDynamic")
        .when(~some & F.col("shape").isin("Polymorphic", "Multicast") & F.col("partial"), "HonestEmpty")
        .otherwise("Unknown")
    )
    rank = F.array_min(F.transform(F.filter(routes, default), lambda r: F.when(r["evidence"] == "source", 0).when(r["evidence"] == "catalog", 1).otherwise(2)))
    return edges.withColumn("outcome", outcome).withColumn("evidence", F.when(F.col("outcome") == "Resolved", F.element_at(F.array(*map(F.lit, ("source", "catalog", "abi_external"))), rank + 1)))


#: Counters of a histogram, in their order.
COUNTERS = {"resolved_source": "evidence = 'source'", "resolved_catalog": "evidence = 'catalog'", "resolved_abi_external": "evidence = 'abi_external'", "conditional_resolved": "outcome = 'ConditionalResolved'", "ambiguous_resolved": "outcome = 'AmbiguousResolved'", "honest_dynamic": "outcome = 'HonestDynamic'", "honest_empty": "outcome = 'HonestEmpty'", "unknown": "outcome = 'Unknown'"}


def histogram(classified: DataFrame, *by: str) -> DataFrame:
    """Counters of classified edges and the rate of unknown ones (null without edges)."""
    counts = [F.count_if(F.expr(test)).alias(name) for name, test in COUNTERS.items()]
    return classified.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.expr("try_divide(count_if(outcome = 'Unknown'), count(1))").alias("unknown_rate"))


def unknown_breakdown(classified: DataFrame, column: str) -> DataFrame:
    """Unknown edges by reason, receiver tier or what else a column holds."""
    return classified.where("outcome = 'Unknown'").groupBy(F.coalesce(F.col(column), F.lit("none")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def legacy_class(resolution: Column, dispatch: Column) -> Column:
    """The four older classes of a call edge."""
    return F.when(resolution.isin("resolved", "builtin"), "resolved").when(dispatch.isin("dynamic", "interface"), "dynamic").when(resolution == "maybe", "maybe").otherwise("unresolved")


def match_sites(fresh: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, targets of each side, verdict) of two edge sets met on their canonical site keys."""
    sides = [df.groupBy(*keys).agg(F.array_sort(F.collect_set("target")).alias(name)) for df, name in ((fresh, "a"), (other, "b"))]
    verdict = F.when(F.col("b").isNull(), "only-fresh").when(F.col("a").isNull(), "only-other").when(F.col("a") == F.col("b"), "same").when(F.size(F.array_except("b", "a")) == 0, "wider").otherwise("differs")
    return sides[0].join(sides[1], keys, "full").withColumn("verdict", verdict)


def innermost_declaration(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """``positions(file, line, col)`` with the id of the shortest of ``spans(file, id, start_line, start_col, end_line, end_col)`` that holds each."""
    at, a, z = F.struct("line", "col"), F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col")), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"))
    hit = positions.join(spans, "file").where((at >= a) & (at < z))
    size = F.struct(F.col("end_line") - F.col("start_line"), F.when(F.col("end_line") == F.col("start_line"), F.col("end_col") - F.col("start_col")).otherwise(F.col("end_col")), "id")
    best = hit.groupBy("file", "line", "col").agg(F.min_by("id", size).alias("id"))
    return positions.join(best, ["file", "line", "col"], "left")


def resolve_selector(selectors: DataFrame, forms: list[DataFrame]) -> DataFrame:
    """``selectors(selector)`` with the ids of the first form, each (selector_key, id), that knows the text: Found, Ambiguous or NotFound."""
    every = None
    for tier, form in enumerate(forms):
        one = form.select(folded(F.col("selector_key")).alias("key"), "id", F.lit(tier).alias("tier"))
        every = one if every is None else every.unionByName(one)
    keyed = selectors.withColumn("key", folded(strip_quotes(F.trim("selector"))))
    hit = keyed.join(every, "key").withColumn("best", F.min("tier").over(W.partitionBy("selector"))).where("tier = best")
    got = hit.groupBy("selector").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("tier").alias("tier"))
    return selectors.join(got, "selector", "left").withColumn("outcome", F.when(F.col("ids").isNull(), "NotFound").when(F.size("ids") == 1, "Found").otherwise("Ambiguous"))


def unlisted_abi_routes(routes: DataFrame, raw_abi: DataFrame) -> DataFrame:
    """Routes to symbols of a package that its raw symbol table lacks."""
    return routes.where("evidence = 'abi'").join(raw_abi.select("abi_key").distinct(), "abi_key", "left_anti")


def default_reach_edges(edges: DataFrame, may: bool = False) -> DataFrame:
    """Edges that run by default; ``may`` keeps those with conditions that are not met by themselves."""
    return edges if may else edges.where(F.size(F.coalesce("conditions", F.array().cast("array<string>"))) == 0)
