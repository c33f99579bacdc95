"""Declarative policies: rules compiled to three-valued Columns, and one plan that runs them all.

A document is ``{"defaults": {"coverage", "on_unknown"}, "rules": [{"id", "severity",
"when", "except", "coverage", "on_unknown"}]}``; ``load`` takes it as a mapping, JSON or YAML.
Predicates are ``all``, ``any``, ``not`` and field tests; a test is a value (equals, or
membership for a list), or ``{"in"|"glob"|"min"|"max": value}``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.predicates import glob

# fixed values: the fields of a predicate, by scope; true marks those that hold lists
ROUTINE_FIELDS = {"routine.kind": False, "routine.name": False, "routine.access": False, "object.type": False, "object.name": False, "object.id": False, "app.name": False, "app.publisher": False, "root.kinds": True}
FACT_FIELDS = {"capability.op": False, "capability.resourceKind": False, "capability.resourceId": False, "capability.resourceName": False, "capability.confidence": False, "capability.provenance": False, "capability.via": False}
GATES, ON_UNKNOWN = ("any", "partial", "complete"), ("fail-closed", "skip")
SEVERITIES = ("info", "low", "medium", "high", "critical")


class PolicyError(ValueError):
    """Carries every problem of a document, each with its path."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def load(text: str | dict) -> dict:
    """The document, checked; raises PolicyError with all problems found."""
    if isinstance(text, str):
        try:
            doc = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise PolicyError(["not JSON, and no YAML reader is installed"]) from e
            try:
                doc = yaml.safe_load(text)
            except yaml.YAMLError as e:
                raise PolicyError([f"not YAML: {e}"]) from e
    else:
        doc = text
    problems: list[str] = []
    if not isinstance(doc, dict) or not isinstance(doc.get("rules"), list):
        raise PolicyError(["rules: a list is missing"])
    seen = set()
    for i, rule in enumerate(doc["rules"]):
        at = f"rules[{i}]"
        if not isinstance(rule, dict) or not isinstance(rule.get("id"), str):
            problems.append(f"{at}.id: a text is missing")
            continue
        if rule["id"] in seen:
            problems.append(f"{at}.id: {rule['id']} stands twice")
        seen.add(rule["id"])
        if rule.get("severity", "medium") not in SEVERITIES:
            problems.append(f"{at}.severity: unknown {rule['severity']}")
        for key, known in (("coverage", GATES), ("on_unknown", ON_UNKNOWN)):
            if rule.get(key, known[0]) not in known:
                problems.append(f"{at}.{key}: unknown {rule[key]}")
        if "when" not in rule:
            problems.append(f"{at}.when: missing")
        for key in ("when", "except"):
            if key in rule:
                problems += _check(rule[key], f"{at}.{key}")
    if problems:
        raise PolicyError(problems)
    return doc


def _check(node, at: str) -> list[str]:
    if not isinstance(node, dict) or not node:
        return [f"{at}: a mapping is missing"]
    out = []
    for key, arg in node.items():
        if key in ("all", "any"):
            if not isinstance(arg, list) or not arg:
                out.append(f"{at}.{key}: a list is missing")
            else:
                out += [x for i, a in enumerate(arg) for x in _check(a, f"{at}.{key}[{i}]")]
        elif key == "not":
            out += _check(arg, f"{at}.not")
        elif key not in ROUTINE_FIELDS and key not in FACT_FIELDS:
            out.append(f"{at}: unknown field {key}")
        elif isinstance(arg, dict) and (len(arg) != 1 or next(iter(arg)) not in ("equals", "in", "glob", "min", "max")):
            out.append(f"{at}.{key}: unknown test {sorted(arg)}")
    return out


def _test(c: Column, is_list: bool, arg) -> Column:
    op, value = next(iter(arg.items())) if isinstance(arg, dict) else ("in" if isinstance(arg, list) else "equals", arg)
    values = value if isinstance(value, list) else [value]
    if op == "glob":
        one = lambda x: reduce(lambda a, b: a | b, [glob(x, str(v)) for v in values])
        return F.exists(c, one) if is_list else one(c)
    if op in ("equals", "in"):
        if is_list:  # a list of values meets a list field if they share one; one value must stand in it
            return F.arrays_overlap(c, F.array(*map(F.lit, values)))
        return c.isin(*values)
    return c >= F.lit(value) if op == "min" else c <= F.lit(value)


def compile_rule(node: dict, fields: dict[str, Column]) -> Column:
    """A predicate as a Column; fields that are not given are unknown. Several keys of one mapping must all hold."""
    parts = []
    for key, arg in node.items():
        if key in ("all", "any"):
            parts.append(reduce((lambda a, b: a & b) if key == "all" else (lambda a, b: a | b), [compile_rule(x, fields) for x in arg]))
        elif key == "not":
            parts.append(~compile_rule(arg, fields))
        else:
            c = fields.get(key)
            parts.append(F.lit(None).cast("boolean") if c is None else _test(c, ROUTINE_FIELDS.get(key, False), arg))
    return reduce(lambda a, b: a & b, parts)


def passes_gate(status: Column, gate: str) -> Column:
    """partial lets a missing status pass, complete does not."""
    return {"any": F.lit(True), "partial": F.coalesce(status != "unknown", F.lit(True))}.get(gate, F.coalesce(status == "complete", F.lit(False)))


def run_policy(doc: dict, routines: DataFrame, facts: DataFrame, coverage: DataFrame, routine_fields: dict[str, Column], fact_fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(findings, rule summaries).

    Findings: (rule_id, severity, routine_id, kind, facts), kind match, coverage or unknown.
    A rule whose ``when`` is False for a routine, facts unknown, does not apply; nor
    if ``except`` is True. The coverage gate comes before facts. Any fact that is True
    and not excepted is a match; else an Unknown one fails closed, if the rule does.
    The facts are read once for all rules.
    """
    defaults, rules = doc.get("defaults") or {}, sorted(doc["rules"], key=lambda r: r["id"])
    known = {k: v for k, v in routine_fields.items()}
    both = {**known, **fact_fields}
    yes = lambda c: F.coalesce(c, F.lit(False))
    base = routines.join(coverage.select("routine_id", "status"), "routine_id", "left")
    states, verdicts = [], []
    for i, rule in enumerate(rules):
        gate = rule.get("coverage") or defaults.get("coverage") or "any"
        applies = ~yes(~compile_rule(rule["when"], known))
        if "except" in rule:
            applies = applies & ~yes(compile_rule(rule["except"], known))
        states.append(F.when(~applies, "off").when(~passes_gate(F.col("status"), gate), "coverage").otherwise("on").alias(f"s{i}"))
        when = compile_rule(rule["when"], both)
        hit = yes(when)
        if "except" in rule:
            hit = hit & ~yes(compile_rule(rule["except"], both))
        verdicts.append(F.when(hit, 2).when(when.isNull(), 1).otherwise(0).alias(f"v{i}"))
    each = base.join(facts, "routine_id").select("routine_id", F.col("fact_id"), *verdicts)
    per = each.groupBy("routine_id").agg(*(F.struct(F.max(f"v{i}").alias("v"), F.array_sort(F.collect_set(F.when(F.col(f"v{i}") == 2, F.col("fact_id")))).alias("facts")).alias(f"r{i}") for i in range(len(rules))))
    judged = base.select("routine_id", *states).join(per, "routine_id", "left")
    rows = []
    for i, rule in enumerate(rules):
        closed = (rule.get("on_unknown") or defaults.get("on_unknown") or "fail-closed") == "fail-closed"
        state = F.when(F.col(f"s{i}") != "on", F.col(f"s{i}")).when(F.col(f"r{i}.v") == 2, "match").when(F.col(f"r{i}.v") == 1, "unknown").otherwise("pass")
        rows.append(F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("severity", "medium")).alias("severity"), F.lit(closed).alias("closed"), state.alias("state"), F.when(state == "match", F.col(f"r{i}.facts")).alias("facts")))
    flat = judged.select("routine_id", F.explode(F.array(*rows)).alias("x")).select("routine_id", "x.*")
    findings = flat.where("state = 'match' or (closed and state in ('coverage', 'unknown'))").select("rule_id", "severity", "routine_id", F.col("state").alias("kind"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))
    n = lambda s: F.count_if(F.col("state") == s)
    summary = flat.groupBy("rule_id").agg(F.count(F.lit(1)).alias("evaluated"), n("match").alias("matched"), n("coverage").alias("skipped_coverage"), n("unknown").alias("skipped_unknown"), n("pass").alias("passed"))
    return findings, summary


def explain(doc: dict) -> list[dict]:
    """Rules with their defaults filled in and predicates in one normal form, by id."""
    d = doc.get("defaults") or {}

    def normal(node):
        parts = []
        for key, arg in sorted(node.items()):
            if key in ("all", "any"):
                parts.append({key: [normal(x) for x in arg]})
            elif key == "not":
                parts.append({"not": normal(arg)})
            else:
                parts.append({key: arg if isinstance(arg, dict) else {"in" if isinstance(arg, list) else "equals": arg}})
        return parts[0] if len(parts) == 1 else {"all": parts}

    out = []
    for r in sorted(doc["rules"], key=lambda r: r["id"]):
        row = {"id": r["id"], "severity": r.get("severity", "medium"), "coverage": r.get("coverage") or d.get("coverage") or "any", "on_unknown": r.get("on_unknown") or d.get("on_unknown") or "fail-closed", "when": normal(r["when"])}
        out.append({**row, "except": normal(r["except"])} if "except" in r else row)
    return out
