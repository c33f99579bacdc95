"""Three-valued policy predicates compiled to Columns; SQL NULL is Unknown."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob; ``*`` and ``?`` do not cross line ends."""
    body = "".join({"*": "[^\n\r  ]*", "?": "[^\n\r  ]"}.get(c, re.escape(c)) for c in pattern)
    return f"^{body}$"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def glob(c: Column, pattern: str) -> Column:
    return ascii_lower(c).rlike(glob_regex(pattern.translate(str.maketrans(_UPPER, _LOWER))))


def compile_predicate(node: dict, fields: dict[str, Column]) -> Column:
    """``{all|any: [...]}``, ``{not: {...}}`` or ``{field: {equals|in|glob|min|max: value}}`` as one Column.

    An unknown field's Column is NULL; AND, OR and NOT over NULL follow Kleene's tables.
    """
    if len(node) != 1:
        raise ValueError("one key a predicate")
    ((key, arg),) = node.items()
    if key in ("all", "any"):
        parts = [compile_predicate(x, fields) for x in arg]
        return reduce((lambda a, b: a & b) if key == "all" else (lambda a, b: a | b), parts, F.lit(key == "all")) if parts else F.lit(key == "all")
    if key == "not":
        return ~compile_predicate(arg, fields)
    if key not in fields:
        raise ValueError(f"unknown field {key}")
    c = fields[key]
    ((op, value),) = arg.items()
    ops = {"equals": lambda: c == F.lit(value), "in": lambda: c.isin(value), "glob": lambda: glob(c, value), "min": lambda: c >= F.lit(value), "max": lambda: c <= F.lit(value)}
    if op not in ops:
        raise ValueError(f"unknown test {op}")
    return ops[op]()
