"""Differences between two versions of a program's contracts, as findings of a few kinds.

Relations of a version: ``abi(routine_id, visibility, signature, obsolete)``,
``schema(field_id, shape, classification)``, ``enums(value_id, ordinal)``, ``events(event_id,
signature)``, ``capabilities(routine_id, capability, class)``, ``permissions(object_id, rights
array<string>)``. Every pass is one full outer join on keys that renames have been applied to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: from least to most
VISIBILITY = ("local", "internal", "protected", "public")
OBSOLETE = ("no", "pending", "removed")
CLASSIFICATION = ("SystemMetadata", "OrganizationIdentifiableInformation", "AccountData", "EndUserPseudonymousIdentifiers", "EndUserIdentifiableInformation", "CustomerContent")
# fixed values: category and severity of each kind
KINDS = {
    "routine-removed": ("abi", "high"), "visibility-narrowed": ("abi", "high"), "signature-changed": ("abi", "high"), "obsoletion-progressed": ("abi", "low"), "obsoletion-regressed": ("abi", "info"), "routine-added": ("abi", "info"),
    "table-field-removed": ("schema", "high"), "table-field-type-narrowed": ("schema", "high"), "table-field-added": ("schema", "info"), "data-classification-weakened": ("schema", "medium"), "data-classification-strengthened": ("schema", "info"),
    "enum-value-removed": ("schema", "high"), "enum-value-renumbered": ("schema", "high"), "enum-value-added": ("schema", "info"),
    "event-removed": ("event", "high"), "event-signature-changed": ("event", "high"), "event-added": ("event", "info"), "event-capability-gained": ("event", "medium"), "event-capability-lost": ("event", "info"),
    "capability-gained": ("capability", "medium"), "capability-lost": ("capability", "info"), "capability-lost-under-coverage": ("capability", "info"),
    "permission-expanded": ("permission", "medium"), "permission-contracted": ("permission", "medium"), "permission-target-added": ("permission", "info"), "permission-target-removed": ("permission", "medium"),
}
SEVERITIES = ("critical", "high", "medium", "low", "info")
OUT = ["category", "kind", "severity", "id", "secondary"]


def compatible(old: dict, new: dict) -> list[str]:
    """Fatal differences of two versions' headers (schema, driver major, application); empty if they can be compared."""
    out = []
    if old.get("schema_version") != new.get("schema_version"):
        out.append("schema-version-mismatch")
    if str(old.get("driver_version", "")).split(".")[0] != str(new.get("driver_version", "")).split(".")[0]:
        out.append("driver-major-mismatch")
    if old.get("app_guid") != new.get("app_guid"):
        out.append("app-identity-mismatch")
    return out


def check_renames(renames: DataFrame, old_ids: DataFrame, new_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable renames, diagnostics) of ``renames(from_id, to_id)``: overlaps (an id renamed twice, or two to one), chains (a target renamed on) and stale ones are reported and left out."""
    r = renames.distinct()
    twice = r.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("from_id").withColumn("overlap_a", F.lit(True))
    merged = r.groupBy("to_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("to_id").withColumn("overlap_b", F.lit(True))
    onward = r.select(F.col("from_id").alias("to_id")).distinct().withColumn("chain_a", F.lit(True))
    into = r.select(F.col("to_id").alias("from_id")).distinct().withColumn("chain_b", F.lit(True))
    j = r.join(twice, "from_id", "left").join(merged, "to_id", "left").join(onward, "to_id", "left").join(into, "from_id", "left")
    j = j.join(old_ids.select(F.col("id").alias("from_id")).distinct().withColumn("was", F.lit(True)), "from_id", "left").join(new_ids.select(F.col("id").alias("to_id")).distinct().withColumn("is", F.lit(True)), "to_id", "left")
    problem = F.when(F.col("overlap_a") | F.col("overlap_b"), "rename-overlap").when(F.col("chain_a") | F.col("chain_b"), "rename-chain").when(F.col("was").isNull() | F.col("is").isNull(), "rename-stale")
    j = j.select("from_id", "to_id", problem.alias("problem"))
    return j.where("problem is null").drop("problem"), j.where("problem is not null")


def renamed(old: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """``old`` with its key as the new version names it."""
    r = renames.select(F.col("from_id").alias(key), F.col("to_id").alias("_to"))
    return old.join(r, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")


def _sides(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    a, b = (df.select(*keys, F.struct(*values).alias(n)) for df, n in ((old, "a"), (new, "b")))
    return a.join(b, keys, "full")


def _rank(order: tuple[str, ...], c: str) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(c))


def _rows(df: DataFrame, key: str, kinds: list[Column], secondary: Column | None = None) -> DataFrame:
    each = df.select(F.col(key).cast("string").alias("id"), (F.lit(None).cast("string") if secondary is None else secondary.cast("string")).alias("secondary"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    table = lambda at: F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[at])))[F.col("kind")]
    return each.select(table(0).alias("category"), "kind", table(1).alias("severity"), "id", "secondary")



def _there() -> Column:
    return F.col("a").isNotNull() & F.col("b").isNotNull()


def abi_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed, narrowed, changed, obsoleted and added routines; a routine may have several kinds. Only what others could see counts."""
    j = _sides(old, new, ["routine_id"], ["visibility", "signature", "obsolete"])
    seen = lambda side: _rank(VISIBILITY, f"{side}.visibility") > 1
    o = lambda side: F.coalesce(F.nullif(_rank(OBSOLETE, f"{side}.obsolete"), F.lit(0)), F.lit(1))
    kinds = [
        F.when(F.col("b").isNull() & seen("a"), "routine-removed"),
        F.when(_there() & (_rank(VISIBILITY, "b.visibility") < _rank(VISIBILITY, "a.visibility")), "visibility-narrowed"),
        F.when(_there() & seen("a") & ~F.col("a.signature").eqNullSafe(F.col("b.signature")), "signature-changed"),
        F.when(_there() & (o("b") > o("a")), "obsoletion-progressed"),
        F.when(_there() & (o("b") < o("a")), "obsoletion-regressed"),
        F.when(F.col("a").isNull() & seen("b"), "routine-added"),
    ]
    return _rows(j, "routine_id", kinds)


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields: any other shape counts as narrowed; classifications by rank."""
    j = _sides(old, new, ["field_id"], ["shape", "classification"])
    rank = lambda side: _rank(CLASSIFICATION, f"{side}.classification")
    both = _there() & (rank("a") > 0) & (rank("b") > 0)
    kinds = [
        F.when(F.col("b").isNull(), "table-field-removed"), F.when(F.col("a").isNull(), "table-field-added"),
        F.when(_there() & ~F.col("a.shape").eqNullSafe(F.col("b.shape")), "table-field-type-narrowed"),
        F.when(both & (rank("b") < rank("a")), "data-classification-weakened"), F.when(both & (rank("b") > rank("a")), "data-classification-strengthened"),
    ]
    return _rows(j, "field_id", kinds)


def enum_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    j = _sides(old, new, ["value_id"], ["ordinal"])
    kinds = [F.when(F.col("b").isNull(), "enum-value-removed"), F.when(F.col("a").isNull(), "enum-value-added"), F.when(_there() & (F.col("a.ordinal") != F.col("b.ordinal")), "enum-value-renumbered")]
    return _rows(j, "value_id", kinds)


def event_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    j = _sides(old, new, ["event_id"], ["signature"])
    kinds = [F.when(F.col("b").isNull(), "event-removed"), F.when(F.col("a").isNull(), "event-added"), F.when(_there() & ~F.col("a.signature").eqNullSafe(F.col("b.signature")), "event-signature-changed")]
    return _rows(j, "event_id", kinds)


def capability_changes(old: DataFrame, new: DataFrame, coverage: DataFrame) -> DataFrame:
    """Gained and lost capabilities; one that is lost where the new cone (``coverage(routine_id, status)``) is not complete may only be unseen."""
    keys = ["routine_id", "capability"]
    gained = new.select(keys).distinct().join(old.select(keys).distinct(), keys, "left_anti")
    lost = old.select(keys).distinct().join(new.select(keys).distinct(), keys, "left_anti").join(coverage.select("routine_id", "status"), "routine_id", "left")
    kind = F.when(F.coalesce("status", F.lit("complete")) == "complete", "capability-lost").otherwise("capability-lost-under-coverage")
    return _rows(gained, "routine_id", [F.lit("capability-gained")], F.col("capability")).unionByName(_rows(lost, "routine_id", [kind], F.col("capability")))


def event_capability_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Capabilities that subscribers bring to an event, ``(event_id, capability)``."""
    keys = ["event_id", "capability"]
    a, b = old.select(keys).distinct(), new.select(keys).distinct()
    return _rows(b.join(a, keys, "left_anti"), "event_id", [F.lit("event-capability-gained")], F.col("capability")).unionByName(_rows(a.join(b, keys, "left_anti"), "event_id", [F.lit("event-capability-lost")], F.col("capability")))


def permission_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rights gained and lost on each object; both may hold at once."""
    j = _sides(old, new, ["object_id"], ["rights"])
    more, less = F.size(F.array_except("b.rights", "a.rights")) > 0, F.size(F.array_except("a.rights", "b.rights")) > 0
    kinds = [F.when(F.col("a").isNull(), "permission-target-added"), F.when(F.col("b").isNull(), "permission-target-removed"), F.when(_there() & more, "permission-expanded"), F.when(_there() & less, "permission-contracted")]
    return _rows(j, "object_id", kinds)


COVERAGE_SENSITIVE = ("capability-gained", "capability-lost", "capability-lost-under-coverage", "event-capability-gained", "event-capability-lost")


def apply_coverage(findings: DataFrame, old: DataFrame, new: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings with old and new cone status, diagnostics). Strict drops sensitive findings without a complete cone on both sides and says so; loose turns a loss there into one under coverage."""
    s = lambda df, name: df.select(F.col("routine_id").alias("id"), F.col("status").alias(name))
    j = findings.join(s(old, "old_cone"), "id", "left").join(s(new, "new_cone"), "id", "left")
    sensitive = F.col("kind").isin(*COVERAGE_SENSITIVE)
    partial = sensitive & ~(F.coalesce(F.col("old_cone") == "complete", F.lit(False)) & F.coalesce(F.col("new_cone") == "complete", F.lit(False)))
    if strict:
        dropped = j.where(partial).select(F.lit("coverage-incomplete").alias("diagnostic"), "id", "kind")
        return j.where(~partial), dropped
    kind = F.when(partial & (F.col("kind") == "capability-lost"), "capability-lost-under-coverage").otherwise(F.col("kind"))
    return j.withColumn("kind", kind), findings.select(F.lit("").alias("diagnostic"), "id", "kind").where("false")


def finding_key(df: DataFrame) -> DataFrame:
    """With the fingerprint of category, kind, id and secondary."""
    return df.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "category", "kind", "id", F.coalesce("secondary", F.lit(""))), 256), 1, 16))


def diff_order() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("category"), F.col("kind"), F.col("id"), F.col("secondary")]


_PASSES = {"abi": ("routine_id", abi_changes), "schema": ("field_id", schema_changes), "enums": ("value_id", enum_changes), "events": ("event_id", event_changes), "permissions": ("object_id", permission_changes)}


def compare(old: dict[str, DataFrame], new: dict[str, DataFrame], renames: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings with fingerprints, diagnostics) of two versions, each a mapping of relations with ``coverage`` and ``capabilities``."""
    ids = lambda side: reduce(DataFrame.unionByName, [side[k].select(F.col(key).cast("string").alias("id")) for k, (key, _) in _PASSES.items()])
    good, bad = check_renames(renames, ids(old), ids(new))
    parts = [fn(renamed(old[k], key, good), new[k]) for k, (key, fn) in _PASSES.items()]
    parts.append(capability_changes(renamed(old["capabilities"], "routine_id", good), new["capabilities"], new["coverage"]))
    found, notes = apply_coverage(reduce(DataFrame.unionByName, parts), old["coverage"], new["coverage"], strict)
    return finding_key(found), bad.select(F.col("problem").alias("diagnostic"), F.col("from_id").alias("id"), F.lit("rename").alias("kind")).unionByName(notes)


def summary(findings: DataFrame) -> DataFrame:
    """Counts by category and severity."""
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def publish_or_clear(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, action) of ``(file, hash)``: published where a file's diagnostics are new or other, cleared where it has none any more."""
    j = before.select("file", F.col("hash").alias("a")).join(now.select("file", F.col("hash").alias("b")), "file", "full")
    return j.select("file", F.when(F.col("b").isNull(), "clear").when(~F.col("a").eqNullSafe(F.col("b")), "publish").alias("action")).where("action is not null")
