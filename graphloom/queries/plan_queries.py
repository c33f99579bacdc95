"""Registered queries of plans and summaries over the driver tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.carrier import FINDINGS, sql
from graphloom.operators import summaries
from graphloom.plans import answers, editor, gate, reports
from graphloom.queries.engine_queries import _P, PROGRAM, _program

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


def _findings(spark, sf_dir):
    return sql(spark, sf_dir, f"WITH {FINDINGS} SELECT * FROM findings")


@_query(f"WITH {FINDINGS} SELECT detector, count(*) AS n FROM findings GROUP BY detector")
def findings_by_group(spark, sf_dir):
    return reports.grouped_counts(_findings(spark, sf_dir), "detector")


@_query(f"WITH {FINDINGS}, r AS (SELECT detector, tab, routine, line, row_number() OVER (PARTITION BY detector, tab ORDER BY line, CAST(routine AS VARCHAR)) AS rn FROM findings) SELECT f.detector, f.tab, min(CASE WHEN rn = 1 THEN CAST(f.routine AS VARCHAR) END) AS witness, count(*) AS path_count, count(DISTINCT f.routine) AS objects FROM r f GROUP BY 1, 2")
def merge_by_terminal(spark, sf_dir):
    """One finding for each detector and table: the shortest path's, with the number of paths."""
    f = _findings(spark, sf_dir).select("detector", "tab", F.col("routine").cast("string").alias("id"), "severity", F.lit("likely").alias("confidence"), F.col("line").alias("path_length"), F.array(F.col("tab").cast("string")).alias("tables"), F.array(F.col("routine").cast("string")).alias("objects"))
    return reports.merged_by_cause(f, ["detector", "tab"]).select("detector", "tab", F.col("id").alias("witness"), "path_count", F.size("objects").cast("long").alias("objects"))


_RANKED = "CASE severity WHEN 'info' THEN 'info' WHEN 'warning' THEN 'medium' ELSE 'high' END"


@_query(f"WITH {FINDINGS} SELECT CAST(routine AS VARCHAR) AS file, line, max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 2 ELSE 3 END) AS worst, count(*) AS n FROM findings GROUP BY 1, 2")
def findings_rollup(spark, sf_dir):
    """Findings of one place together, under the worst severity."""
    f = _findings(spark, sf_dir).select("detector", F.expr(_RANKED).alias("severity"), F.col("routine").cast("string").alias("file"), "line")
    return reports.rolled_up(f).select("file", "line", gate.severity_rank(F.col("severity")).cast("int").alias("worst"), F.size("by").cast("long").alias("n"))


@_query(f"WITH {FINDINGS}, k AS (SELECT *, concat(detector, '|', CAST(routine AS VARCHAR)) AS fp FROM findings) SELECT detector, routine, tab, severity FROM k WHERE fp NOT IN (SELECT fp FROM k WHERE part % 3 = 0)")
def baseline_anti(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("fingerprint", F.concat_ws("|", "detector", "routine"))
    return gate.without_baseline(f, f.where("part % 3 = 0")).select("detector", "routine", "tab", "severity")


@_query(f"WITH {FINDINGS}, s AS (SELECT detector, CAST(routine AS VARCHAR) AS file, line, concat(CAST(part AS VARCHAR), '/', CAST(tab AS VARCHAR)) AS fingerprint FROM findings WHERE severity <> 'info') SELECT * FROM s ORDER BY CAST(substr(detector, 2) AS INT), file, line, fingerprint LIMIT 100")
def limit_natural_sort(spark, sf_dir):
    """The first hundred findings of some weight in the report's order, in which d2 comes before d10."""
    f = _findings(spark, sf_dir).select("detector", F.expr(_RANKED).alias("severity"), F.col("routine").cast("string").alias("file"), "line", F.concat_ws("/", "part", "tab").alias("fingerprint"))
    return gate.first_findings(gate.select_findings(f, "low"), 100).select("detector", "file", "line", "fingerprint")


@_query("WITH m AS (SELECT doc_id, source, n_chars % 13 AS c, length(text) - length(replace(text, chr(10), '')) + 1 AS l, n_chars % 9 AS p FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, source, 'complexity' AS metric, c AS value, 5 AS w, 10 AS e FROM m UNION ALL SELECT doc_id, source, 'lines', l, 20, 50 FROM m UNION ALL SELECT doc_id, source, 'parameters', p, 4, 7 FROM m) SELECT CAST(doc_id AS VARCHAR) AS routine_id, source AS file, metric, CAST(value AS BIGINT) AS value, CASE WHEN value >= e THEN 'error' ELSE 'warning' END AS severity FROM v WHERE value >= w")
def threshold_findings(spark, sf_dir):
    """Measures at or over their thresholds; a document stands for a routine."""
    return editor.threshold_findings(_metrics(spark, sf_dir))


def _metrics(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select(F.col("doc_id").cast("string").alias("routine_id"), F.col("source").alias("file"), (F.col("n_chars") % 13).alias("complexity"), F.size(F.split("text", "\n")).alias("lines"), (F.col("n_chars") % 9).alias("parameters"))


@_query("WITH m AS (SELECT n_chars % 13 AS c, length(text) - length(replace(text, chr(10), '')) + 1 AS l, n_chars % 9 AS p FROM documents WHERE text IS NOT NULL) SELECT count(*) AS routines, avg(c) AS average_complexity, avg(l) AS average_lines, max(c) AS most_complex, CAST(sum((c >= 10)::INT + (l >= 50)::INT + (p >= 7)::INT) AS BIGINT) AS errors, CAST(sum((c >= 5 AND c < 10)::INT + (l >= 20 AND l < 50)::INT + (p >= 4 AND p < 7)::INT) AS BIGINT) AS warnings FROM m")
def metrics_summary(spark, sf_dir):
    return editor.quality_report(_metrics(spark, sf_dir))


@_query(f"WITH {PROGRAM}, x AS (SELECT routine_id, ord - 1 AS line FROM places WHERE routine_id IN (SELECT routine_id FROM own)) SELECT DISTINCT routine_id FROM x WHERE line >= 1 AND line < 4 AND routine_id IN (SELECT routine_id FROM own WHERE kind = 'procedure')")
def diff_hunk_lines(spark, sf_dir):
    """Routines with an operation in the lines that a change touches; each procedure's file changes in lines 2 to 4."""
    f = _program(spark, sf_dir)
    hunks = f["routines"].where("kind = 'procedure'").select(F.col("routine_id").alias("path"), F.lit("modified").alias("change"), F.lit(2).alias("new_start"), F.lit(3).alias("new_count"))
    at = lambda df: df.select(F.col("routine_id").alias("path"), "routine_id", "line")
    places = sql(spark, sf_dir, f"WITH {PROGRAM} SELECT routine_id, ord - 1 AS line FROM places").join(f["routines"].select("routine_id"), "routine_id", "left_semi")
    return answers.changed_routines(hunks, at(places))


@_query(f"WITH {PROGRAM} SELECT o.routine_id, count(l.src) AS fan_in FROM own o LEFT JOIN links l ON l.dst = o.routine_id GROUP BY o.routine_id")
def fan_in(spark, sf_dir):
    f = _program(spark, sf_dir)
    return editor.code_lenses(f["routines"].select("routine_id"), f["combined_edges"])


@_query(f"WITH {PROGRAM} SELECT l.dst AS routine_id, l.src AS caller, count(*) AS places FROM links l JOIN own o ON o.routine_id = l.dst WHERE o.kind = 'trigger' GROUP BY 1, 2")
def incoming_calls(spark, sf_dir):
    f = _program(spark, sf_dir)
    return editor.incoming_calls(f["combined_edges"], f["routines"].where("kind = 'trigger'")).withColumn("places", F.size("places").cast("long"))


@_query(f"WITH {PROGRAM}, e AS (SELECT s.object_id AS event_id, l.dst AS sub, d.obsolete, d.access FROM links l JOIN own s ON s.routine_id = l.src JOIN own d ON d.routine_id = l.dst WHERE l.kind = 'event-dispatch'), g AS (SELECT event_id, count(DISTINCT CASE WHEN access IS DISTINCT FROM 'internal' THEN sub END) AS n, bool_or(coalesce(access = 'internal', false)) AS op, count(*) FILTER (WHERE access IS DISTINCT FROM 'internal' AND obsolete = 'removed') AS blank, count(*) FILTER (WHERE access IS DISTINCT FROM 'internal' AND obsolete = 'pending') AS part FROM e GROUP BY event_id), v AS (SELECT object_id AS event_id FROM own GROUP BY object_id) SELECT v.event_id, coalesce(n, 0) AS subscribers, coalesce(n, 0) > 5 AS hot, CASE WHEN op THEN 'partial' ELSE 'complete' END AS dispatch_edges, CASE WHEN coalesce(n, 0) = 0 OR blank > 0 THEN 'unknown' WHEN part > 0 THEN 'partial' ELSE 'complete' END AS composition FROM v LEFT JOIN g USING (event_id)")
def event_fanout(spark, sf_dir):
    """Subscribers of each object's event, whether it is hot, and how far its coverage goes."""
    return _fanout(spark, sf_dir).select("event_id", "subscribers", "hot", "dispatch_edges", "composition")


def _fanout(spark, sf_dir):
    f = _program(spark, sf_dir)
    r = f["routines"]
    events = r.groupBy(F.col("object_id").alias("event_id")).agg(F.min("routine_id").alias("publisher_routine_id"))
    edges = f["event_edges"].join(r.select(F.col("routine_id").alias("subscriber_routine_id"), "access"), "subscriber_routine_id").select("event_id", "subscriber_routine_id", F.when(F.col("access") == "internal", "maybe").otherwise("resolved").alias("resolution"))
    cover = r.where("obsolete is null or obsolete = 'pending'").select("routine_id", F.when(F.col("obsolete") == "pending", "partial").otherwise("complete").alias("status"))
    return answers.fanout(events, edges, cover)


@_query(f"WITH {PROGRAM}, e AS (SELECT s.object_id AS event_id, l.dst AS sub, d.obsolete, d.access FROM links l JOIN own s ON s.routine_id = l.src JOIN own d ON d.routine_id = l.dst WHERE l.kind = 'event-dispatch'), g AS (SELECT event_id, count(DISTINCT CASE WHEN access IS DISTINCT FROM 'internal' THEN sub END) AS n, bool_or(coalesce(access = 'internal', false)) AS op, count(*) FILTER (WHERE access IS DISTINCT FROM 'internal' AND obsolete = 'removed') AS blank, count(*) FILTER (WHERE access IS DISTINCT FROM 'internal' AND obsolete = 'pending') AS part FROM e GROUP BY event_id), v AS (SELECT object_id AS event_id FROM own GROUP BY object_id) SELECT count(*) AS publishers, count(*) AS events, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS silent, count(*) FILTER (WHERE n > 5) AS hot, count(*) FILTER (WHERE op OR (n > 0 AND blank = 0 AND part > 0)) AS partial FROM v LEFT JOIN g USING (event_id)")
def event_fanout_totals(spark, sf_dir):
    return answers.fanout_totals(_fanout(spark, sf_dir))


@_query(f"{_P}, bad AS (SELECT routine_id, obsolete FROM own WHERE obsolete IS NOT NULL), r AS (SELECT routine_id, obsolete FROM bad UNION SELECT f.src, b.obsolete FROM far f JOIN bad b ON b.routine_id = f.dst) SELECT o.routine_id, count(DISTINCT r.obsolete) > 0 AS unresolved, coalesce(string_agg(DISTINCT r.obsolete, ',' ORDER BY r.obsolete), '') AS reasons FROM own o LEFT JOIN r ON r.routine_id = o.routine_id GROUP BY o.routine_id")
def propagated_uncertainty(spark, sf_dir):
    """Uncertainties of each routine and of all that it reaches."""
    f = _program(spark, sf_dir, True)
    base = summaries.base_facts(f["routines"], f["routines"].where("obsolete is not null").select(F.col("routine_id").alias("from"), F.col("obsolete").alias("kind")))
    return summaries.propagated_uncertainty(base, f["combined_edges"], f["stage"]).withColumn("reasons", F.array_join("reasons", ","))


@_query(f"{_P}, t AS (SELECT DISTINCT routine_id FROM places WHERE op = 'Modify' AND routine_id IN (SELECT routine_id FROM own)), c AS (SELECT routine_id, routine_id AS node FROM t UNION SELECT t.routine_id, f.src FROM far f JOIN t ON f.dst = t.routine_id) SELECT c.routine_id, count(DISTINCT l.src) AS loops, min(l.src) AS least FROM c JOIN links l ON l.dst = c.node WHERE l.loops GROUP BY c.routine_id")
def loops_reaching(spark, sf_dir):
    """The loops whose calls reach each routine that modifies a table."""
    f = _program(spark, sf_dir, True)
    inside = f["call_sites"].where(F.size("loop_stack") > 0).select("callsite_id").join(f["combined_edges"], "callsite_id").select(F.col("from").alias("loop_id"), "to")
    ends = f["record_operations"].where("op = 'Modify'").select("routine_id").distinct().join(f["routines"].select("routine_id"), "routine_id", "left_semi")
    return summaries.loops_reaching(inside, f["combined_edges"], ends, f["stage"]).select("routine_id", F.size("loops").cast("long").alias("loops"), F.col("loops")[0].alias("least"))


@_query("SELECT p_type AS value, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part) t")
def dense_ids(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("value"))
    return summaries.dense_ids(p, "value")
