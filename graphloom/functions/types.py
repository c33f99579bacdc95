"""Types, signatures, attributes and places of declarations, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.names import folded, strip_quotes

#: Kinds that a declared type may name an object of.
OBJECT_KINDS = ("record", "codeunit", "page", "report", "query", "xmlport", "enum", "interface", "controladdin", "requestpage", "testpage")


def canonical_type(text: Column) -> Column:
    """A type's text in lower case, with single spaces, none around brackets, and without ``temporary``."""
    c = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*([\[\](),])\s*", "$1"), r" temporary$", ""))


def base_type(text: Column) -> Column:
    """The type without its length: Text[50] is text."""
    return F.regexp_replace(canonical_type(text), r"\[[^\]]*\]$", "")


def type_length(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(canonical_type(text), r"\[(\d{1,9})\]$", 1), F.lit("")), F.lit("999999999")).cast("int")


def object_reference(text: Column) -> Column:
    """``Codeunit "Sales Post"`` as struct(kind, ref), null for types that name no object."""
    kind = F.lower(F.regexp_extract(F.trim(text), r"^(\w+)\s+\S", 1))
    ref = strip_quotes(F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w+\s+", ""), r"(?i)\s+temporary$", "")))
    return F.when(kind.isin(*OBJECT_KINDS), F.struct(kind.alias("kind"), ref.alias("ref")))


def parsed_type(text: Column) -> Column:
    """struct(kind, object_kind, ref, length): object, generic, array, primitive or unknown."""
    c, obj = canonical_type(text), object_reference(text)
    kind = F.when(text.isNull() | (F.trim(text) == ""), "unknown").when(c.startswith("array["), "array").when(c.rlike("^(list|dictionary) of"), "generic").when(obj.isNotNull(), "object").otherwise("primitive")
    return F.struct(kind.alias("kind"), obj["kind"].alias("object_kind"), obj["ref"].alias("ref"), F.when(kind == "primitive", type_length(text)).alias("length"))


def dispatch_type(text: Column) -> Column:
    """The key under which argument and parameter types are the same: objects by kind and folded name, others by base type."""
    obj = object_reference(text)
    return F.when(obj.isNotNull(), F.concat_ws(":", obj["kind"], folded(obj["ref"]))).otherwise(base_type(text))


def without_quoted(text: Column) -> Column:
    return F.regexp_replace(text, "\"[^\"]*\"|'[^']*'", "")


def has_unquoted_dot(text: Column) -> Column:
    return without_quoted(text).contains(".")


def receiver_name(text: Column) -> Column:
    """The one name that a receiver is, without quotes; null for a chain, a call or an index."""
    t = F.trim(text)
    return F.when(t.rlike('^("[^"]+"|[A-Za-z_][A-Za-z0-9_]*)$'), strip_quotes(t))


def field_argument(text: Column) -> Column:
    """A field's name as written in an argument: without record prefix and quotes, folded."""
    t = F.trim(text)
    bare = F.when(t.rlike('^[A-Za-z_"][^.]*\\.'), F.regexp_replace(t, '^("[^"]*"|[A-Za-z_][A-Za-z0-9_]*)\\.', "")).otherwise(t)
    return folded(F.regexp_replace(strip_quotes(bare), '""', '"'))


def signature(parameters: Column) -> Column:
    """A 64-bit hash of ``array<struct<type, by_ref>>``; every part is led by its length, so no two lists read alike."""
    part = lambda p: F.concat_ws(":", F.length(dispatch_type(p["type"])), dispatch_type(p["type"]), F.coalesce(p["by_ref"], F.lit(False)).cast("string"))
    return F.xxhash64(F.size(parameters), F.concat_ws("|", F.transform(parameters, part)))


def attribute(attributes: Column, name: str) -> Column:
    """The first of ``array<struct<name, args>>`` with a name in any case; null if there is none."""
    return F.try_element_at(F.filter(attributes, lambda a: F.lower(a["name"]) == name.lower()), F.lit(1))


def has_attribute(attributes: Column, name: str) -> Column:
    return F.coalesce(F.exists(attributes, lambda a: F.lower(a["name"]) == name.lower()), F.lit(False))


def attribute_text(a: Column, at: int) -> Column:
    """An argument of an attribute without quotes and qualifier: ``ObjectType::Codeunit`` is Codeunit."""
    t = F.trim(F.try_element_at(a["args"], F.lit(at)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^'(.*)'$", "$1"), r"^\w+::", ""), '^"(.*)"$', "$1")


def routine_flags(attributes: Column) -> Column:
    """struct(obsolete, is_try, internal): obsolete is no, pending or removed."""
    state = F.lower(F.coalesce(attribute_text(attribute(attributes, "Obsolete"), 3), F.lit("pending")))
    obsolete = F.when(~has_attribute(attributes, "Obsolete"), "no").when(state == "removed", "removed").otherwise("pending")
    return F.struct(obsolete.alias("obsolete"), has_attribute(attributes, "TryFunction").alias("is_try"), has_attribute(attributes, "InternalProc").alias("internal"))


def subscription(attributes: Column) -> Column:
    """struct(target_kind, target, event, element) of an EventSubscriber attribute; null without one."""
    a = attribute(attributes, "EventSubscriber")
    return F.when(a.isNotNull(), F.struct(attribute_text(a, 1).alias("target_kind"), attribute_text(a, 2).alias("target"), attribute_text(a, 3).alias("event"), F.nullif(attribute_text(a, 4), F.lit("")).alias("element")))


def publisher_kind(attributes: Column) -> Column:
    return F.when(has_attribute(attributes, "IntegrationEvent"), "integration").when(has_attribute(attributes, "BusinessEvent"), "business").when(has_attribute(attributes, "InternalEvent"), "internal")


def arity_bound(arity: Column, attributes: Column) -> Column:
    """Most parameters that a subscriber may take: the publisher's, and one for the sender if it is included."""
    sends = F.lower(F.coalesce(attribute_text(attribute(attributes, "IntegrationEvent"), 1), F.lit("false"))) == "true"
    return arity + sends.cast("int")


def table_name(name: Column, number: Column, table_id: Column) -> Column:
    """What to call a table: its name, else its number, else its id; unknown stays unknown."""
    return F.when(table_id == "unknown", "unknown table").otherwise(F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Table "), number.cast("string")), table_id))


def stable_ids(text: Column, ids: Column) -> Column:
    """A text with internal ids, the keys of a map, replaced by stable ones; longer keys first, so none is part of another."""
    keys = F.array_sort(F.map_keys(ids), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(keys, text, lambda t, k: F.replace(t, k, ids[k]))


def anonymised(key: str, domain: str, value: Column) -> Column:
    """A keyed hash; equal values of different domains do not show as equal."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(domain), value), 256), 1, 32)


def path_of_uri(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), r"\+", "%2B")), r"^/([A-Za-z]:)", "$1"), r"\\", "/")


def uri_of_path(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    p = F.when(p.rlike("^[A-Za-z]:"), F.concat(F.lit("/"), p)).otherwise(p)
    coded = F.regexp_replace(F.url_encode(p), r"\+", "%20")
    return F.concat(F.lit("file://"), F.regexp_replace(F.regexp_replace(coded, "%2F", "/"), "%3A", ":"))


def utf16_column(line: Column, byte_column: Column) -> Column:
    """The place in UTF-16 units of a byte of a line in UTF-8."""
    head = F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_column.cast("int")), "UTF-8")
    return (F.octet_length(F.encode(head, "UTF-16BE")) / 2).cast("int")


def complexity(nodes: Column) -> Column:
    """1 and one for each branch, loop, case branch and Boolean connective of ``array<string>`` node kinds."""
    return F.lit(1) + F.size(F.filter(nodes, lambda k: k.isin("if", "if-else", "for", "foreach", "while", "repeat", "case-branch", "and", "or")))
