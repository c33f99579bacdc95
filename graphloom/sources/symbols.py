"""Symbols of packages without source, implicit dependencies, roots and caches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: list of each kind in a symbol file, and the kind's name
SYMBOL_LISTS = {"Tables": "Table", "Codeunits": "Codeunit", "Pages": "Page", "Reports": "Report", "Queries": "Query", "XmlPorts": "XmlPort", "Interfaces": "Interface", "EnumTypes": "Enum", "ControlAddIns": "ControlAddIn", "PageExtensions": "PageExtension", "TableExtensions": "TableExtension", "EnumExtensionTypes": "EnumExtension", "ReportExtensions": "ReportExtension", "PermissionSets": "PermissionSet"}
_ROWS = "package string, namespace string, kind string, number long, name string, routine string, access string, parameters array<struct<name:string,type:string,by_ref:boolean>>, return_type string, problem string"


def _type(t) -> str | None:
    if not isinstance(t, dict):
        return None
    sub = t.get("Subtype") or {}
    return f"{t.get('Name')} {sub['Name']}" if sub.get("Name") else t.get("Name")


def _walk(space: dict, path: tuple):
    for key, kind in SYMBOL_LISTS.items():
        for o in space.get(key) or []:
            base = (".".join(path), kind, o.get("Id"), o.get("Name"))
            yield (*base, None, None, None, None)
            for m in o.get("Methods") or []:
                params = [{"name": p.get("Name"), "type": _type(p.get("TypeDefinition")), "by_ref": bool(p.get("IsVar"))} for p in m.get("Parameters") or []]
                access = "local" if m.get("IsLocal") else "internal" if m.get("IsInternal") else "protected" if m.get("IsProtected") else None
                yield (*base, m.get("Name"), access, params, _type(m.get("ReturnTypeDefinition")))
    for inner in space.get("Namespaces") or []:
        yield from _walk(inner, (*path, inner.get("Name") or ""))


def _symbols(batches):
    for b in batches:
        rows = []
        for package, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                rows += [(package, *r, None) for r in _walk(json.loads(text), ())]
            except (ValueError, AttributeError, TypeError) as e:
                rows.append((package, *[None] * 8, f"no symbols: {e}"))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("by_ref", pa.bool_())])), pa.string(), pa.string()]
        cols = list(zip(*rows)) if rows else [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _ROWS.replace("array<struct<name:string,type:string,by_ref:boolean>>", "a").split(", ")])


def package_symbols(entries: DataFrame) -> DataFrame:
    """Objects (routine null) and routines of every symbol file among package ``entries``, nested namespaces at any depth."""
    files = entries.where("lower(entry) like '%symbolreference.json' and text is not null").select("package", F.regexp_replace("text", "\\x00+$", "").alias("text"))
    return files.mapInArrow(_symbols, _ROWS)


def symbol_objects(symbols: DataFrame) -> DataFrame:
    """Object rows for resolution; ids by package, kind and number or name."""
    o = symbols.where("routine is null and problem is null")
    return o.select(F.concat_ws("/", "package", "kind", F.coalesce(F.col("number").cast("string"), F.col("name"))).alias("object_id"), F.col("package").alias("app_guid"), "kind", "number", "name")


def symbol_routines(symbols: DataFrame) -> DataFrame:
    r = symbols.where("routine is not null")
    home = F.concat_ws("/", "package", "kind", F.coalesce(F.col("number").cast("string"), F.col("name")))
    return r.select(F.concat_ws("#", home, F.lower("routine"), F.size("parameters")).alias("routine_id"), home.alias("object_id"), F.col("routine").alias("name"), F.lit("procedure").alias("kind"), "access", F.size("parameters").alias("arity"), F.lit(False).alias("body_available"))


def symbol_only(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """Packages that give symbols but no source."""
    return packages.join(sources.select("package").distinct(), "package", "left_anti")


def with_implicit(declared: DataFrame, apps: DataFrame, tiers: DataFrame) -> DataFrame:
    """Declared dependencies and those that an application's platform and application versions stand for.

    ``declared(app_guid, dep_guid, name, publisher, version)``, ``apps(app_guid, application, platform)``,
    ``tiers(tier, dep_guid, name, publisher)`` with tier application or platform. No application depends on itself.
    """
    versions = apps.select("app_guid", F.explode(F.array(F.struct(F.lit("application").alias("tier"), F.col("application").alias("version")), F.struct(F.lit("platform").alias("tier"), F.col("platform").alias("version")))).alias("v")).select("app_guid", "v.*").where("coalesce(version, '') <> ''")
    more = versions.join(F.broadcast(tiers), "tier").where("app_guid <> dep_guid").select("app_guid", "dep_guid", "name", "publisher", "version")
    return declared.select("app_guid", "dep_guid", "name", "publisher", "version").unionByName(more)


def verified(checkouts: DataFrame, expected: DataFrame) -> DataFrame:
    """Local checkouts whose id, name, publisher and version are those expected; anything unknown does not pass."""
    keys = ["id", "name", "publisher", "version"]
    return checkouts.join(expected.select(keys).distinct(), keys, "left_semi")


def friend_manifest(entries: DataFrame) -> DataFrame:
    """(package, friends) named in the manifests' InternalsVisibleTo."""
    xml = entries.where("lower(entry) like '%navxmanifest.xml' and text is not null").select("package", F.regexp_replace("text", r'\sxmlns="[^"]*"', "").alias("xml"))
    at = lambda a: F.xpath("xml", F.lit(f"/Package/InternalsVisibleTo/Module/@{a}"))
    return xml.select("package", F.arrays_zip(at("Id").alias("id"), at("Name").alias("name")).alias("friends"))


def roots_config(files: DataFrame) -> DataFrame:
    """(selector, kind) of every ``roots.config.json`` among ``files(path, text)``; a malformed one gives a row with a problem."""
    schema = "struct<roots:array<struct<selector:string,kind:string>>>"
    f = files.where("path like '%roots.config.json'").select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("c"))
    good = f.where("c.roots is not null").select("path", F.explode("c.roots").alias("r")).select("path", "r.selector", "r.kind", F.lit(None).cast("string").alias("problem"))
    return good.unionByName(f.where("c.roots is null").select("path", F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("kind"), F.lit("no list of roots").alias("problem")))


def prune_status(artifacts: DataFrame, live: DataFrame, schema_version: int) -> DataFrame:
    """``artifacts(path, hash, schema_version)`` as keep, stale (no input has its hash) or outdated (another schema)."""
    j = artifacts.join(live.select("hash").distinct().withColumn("live", F.lit(True)), "hash", "left")
    return j.select("path", "hash", F.when(F.col("schema_version").isNull() | (F.col("schema_version") != schema_version), "outdated").when(F.col("live"), "keep").otherwise("stale").alias("status"))


def merged_fields(fields: DataFrame, extensions: DataFrame) -> DataFrame:
    """(table_id, fields): a table's fields and those of its extensions, in the order of assembly: own first, then by extension and place."""
    own = fields.select("table_id", F.struct(F.lit(0).alias("tier"), F.lit("").alias("ext"), "place", "field_id", "name").alias("f"))
    more = fields.join(extensions, fields["table_id"] == extensions["extension_id"]).select(F.col("base_id").alias("table_id"), F.struct(F.lit(1).alias("tier"), F.col("extension_id").alias("ext"), "place", "field_id", "name").alias("f"))
    return own.unionByName(more).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: F.struct(x["field_id"], x["name"])).alias("fields"))


def real_tables(tables: DataFrame) -> DataFrame:
    """One row a table id, a real one before a stub."""
    cols = [c for c in tables.columns if c != "table_id"]
    return tables.groupBy("table_id").agg(F.min_by(F.struct(*cols), F.struct(F.col("is_stub").cast("int"), *cols)).alias("t")).select("table_id", "t.*")
