"""Registered queries of the rule, function, text and incremental operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.carrier import sql
from graphloom.functions.names import natural_key, quality_score, version_key
from graphloom.plans.gate import without_suppressed
from graphloom.rules.record_rules import DETECTORS
from graphloom.sources.text_facts import lines
from graphloom.storage import Stage
from graphloom.streaming.incremental import FactTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Record operations carried by order lines: a routine is an order, a variable one of three, an operation by line number.
RECORD_OPS = """rec AS (SELECT l_orderkey AS routine_id, concat('V', CAST(l_suppkey % 3 AS STRING)) AS var, l_suppkey AS table_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS ord,
  CASE l_partkey % 8 WHEN 0 THEN 'Get' WHEN 1 THEN 'Modify' WHEN 2 THEN 'SetRange' WHEN 3 THEN 'Reset' WHEN 4 THEN 'DeleteAll' WHEN 5 THEN 'SetLoadFields' WHEN 6 THEN 'Validate' ELSE 'ModifyAll' END AS op FROM lineitem)"""


def _facts(spark, sf_dir):
    rec = sql(spark, sf_dir, f"WITH {RECORD_OPS} SELECT * FROM rec")
    cast = rec.select(F.col("routine_id").cast("string").alias("routine_id"), "var", "op", F.col("table_id").cast("string").alias("table_id"), F.concat_ws("#", "routine_id", "ord").alias("op_id"), F.struct(F.col("ord").alias("start_line"), F.lit(0).alias("start_col")).alias("anchor"))
    ops = cast.withColumns({"temp": F.lit(None).cast("struct<kind:string,value:boolean>"), "loop_stack": F.array().cast("array<string>"), "field_args": F.array().cast("array<string>")})
    routines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("routine_id"), F.lit(True).alias("body_available"), F.lit(False).alias("parse_incomplete"))
    none = spark.createDataFrame([], "routine_id string, name string, is_parameter boolean")
    return {"record_operations": ops, "routines": routines, "record_variables": none}


_HEAD = f"WITH {RECORD_OPS}, own AS (SELECT rec.* FROM rec WHERE routine_id IN (SELECT o_orderkey FROM orders))"
_OUT = "CAST(a.routine_id AS VARCHAR) AS routine_id, concat(CAST(a.routine_id AS VARCHAR), '#', CAST(a.ord AS VARCHAR)) AS op_id, CAST(a.table_id AS VARCHAR) AS table_id"
_SAME = "b.routine_id = a.routine_id AND b.var = a.var"


def _rule(key: str, name: str, where: str, severity: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: DETECTORS[name](_facts(spark, sf_dir)).select("severity", "routine_id", "op_id", "table_id")
    ORACLES[key] = f"{_HEAD} SELECT {severity} AS severity, {_OUT} FROM own a WHERE {where}"


_rule("rule_modify_without_get", "d11-modify-without-get", f"a.op IN ('Modify', 'Validate') AND NOT EXISTS (SELECT 1 FROM own b WHERE {_SAME} AND b.ord < a.ord AND b.op = 'Get')", "'medium'")
_rule("rule_late_load_fields", "d36-late-setloadfields", f"a.op = 'SetLoadFields' AND EXISTS (SELECT 1 FROM own b WHERE {_SAME} AND b.ord < a.ord AND b.op = 'Get') AND NOT EXISTS (SELECT 1 FROM own b WHERE {_SAME} AND b.ord > a.ord AND b.op = 'Get')", "'low'")
_rule("rule_unfiltered_bulk_write", "d33-unfiltered-bulk-write", f"a.op IN ('DeleteAll', 'ModifyAll') AND coalesce((SELECT max(CASE WHEN b.op = 'SetRange' THEN b.ord END) FROM own b WHERE {_SAME} AND b.ord < a.ord), 0) <= coalesce((SELECT max(CASE WHEN b.op = 'Reset' THEN b.ord END) FROM own b WHERE {_SAME} AND b.ord < a.ord), 0)", "CASE a.op WHEN 'DeleteAll' THEN 'critical' ELSE 'high' END")
_rule("rule_validate_without_persist", "d37-validate-without-persist", f"a.op = 'Validate' AND coalesce((SELECT min(CASE WHEN b.op = 'Modify' THEN b.ord END) FROM own b WHERE {_SAME} AND b.ord > a.ord), 1000000) >= coalesce((SELECT min(CASE WHEN b.op IN ('Get', 'Reset') THEN b.ord END) FROM own b WHERE {_SAME} AND b.ord > a.ord), 1000000)", "'medium'")


def _query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


@_query("SELECT p_partkey, round(least(10.0, greatest(0.0, 10.0 - CASE WHEN p_size > 4 THEN 1.6 + (p_size - 4) * 1.2 WHEN p_size > 2 THEN (p_size - 2) * 0.8 ELSE 0 END - CASE WHEN p_partkey % 40 > 15 THEN 1.5 + (p_partkey % 40 - 15) * 0.15 WHEN p_partkey % 40 > 10 THEN (p_partkey % 40 - 10) * 0.3 ELSE 0 END - CASE WHEN p_partkey % 9 > 4 THEN 1.0 + (p_partkey % 9 - 4) * 0.8 WHEN p_partkey % 9 > 2 THEN (p_partkey % 9 - 2) * 0.5 ELSE 0 END)), 6)::DOUBLE AS score FROM part")
def quality_score_linear(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(quality_score(F.col("p_size"), F.col("p_partkey") % 40, F.col("p_partkey") % 9).cast("double"), 6).alias("score"))


@_query("WITH v AS (SELECT p_partkey AS id, p_brand AS b, [p_size, p_partkey % 12, 0, 0] AS k FROM part) SELECT b AS p_brand, max(k)[1] AS major, max(k)[2] AS minor FROM v GROUP BY b")
def version_highest(spark, sf_dir):
    """The highest version of each brand; texts compare by number, so 9.10 is over 9.9."""
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.max(version_key(v)).alias("k"))
    return p.select("p_brand", F.col("k")[0].alias("major"), F.col("k")[1].alias("minor"))


@_query("SELECT c.c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13, c_custkey) AS INTEGER) AS place FROM customer c")
def natural_order(spark, sf_dir):
    """Places by detector name with numbers by value, then by id."""
    from pyspark.sql import Window as W

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("name", F.concat(F.lit("d"), (F.col("c_custkey") % 13).cast("string")))
    return c.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(natural_key(F.col("name")), "c_custkey")).alias("place"))


@_query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS lines, max(CASE WHEN body LIKE '%license%' THEN line END)::INTEGER AS last_license FROM l GROUP BY doc_id")
def line_facts(spark, sf_dir):
    d = lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.when(F.col("body").contains("license"), F.col("line"))).alias("last_license"))


_FOUND = "SELECT concat('d', CAST(l_suppkey % 12 AS STRING)) AS detector, CAST(l_orderkey % 500 AS STRING) AS file, l_linenumber * 3 + l_partkey % 3 AS line, l_orderkey AS routine FROM lineitem"
_DIRECTIVES = "SELECT concat('d', CAST(o_custkey % 12 AS STRING)) AS detector, CAST(o_orderkey % 500 AS STRING) AS file, CAST(o_custkey % 20 AS INT) AS line FROM orders"


@_query(f"WITH f AS ({_FOUND}), s AS ({_DIRECTIVES}) SELECT f.file, f.detector, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file = f.file AND s.detector = f.detector AND f.line - s.line BETWEEN 0 AND 1) GROUP BY f.file, f.detector")
def findings_not_suppressed(spark, sf_dir):
    f, s = sql(spark, sf_dir, _FOUND), sql(spark, sf_dir, _DIRECTIVES)
    return without_suppressed(f, s).groupBy("file", "detector").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS name FROM customer WHERE c_custkey % 5 <> 0")
def incremental_equals_batch(spark, sf_dir):
    """Facts after three batches of saves, resaves and removals are those of the files as they are then."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_name").alias("text"), "c_custkey")
    event = lambda df, seq, kind, text: df.select("path", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    saved = event(c, 1, "saved", F.col("text"))
    stale = event(c.where("c_custkey % 3 = 1"), 0, "saved", F.lit("stale"))
    again = event(c.where("c_custkey % 3 = 1"), 2, "saved", F.upper("text"))
    gone = event(c.where("c_custkey % 5 = 0"), 3, "removed", F.lit(None).cast("string"))
    table = FactTable(spark, Stage(spark, "facts").root, lambda files: files.select("path", F.col("text").alias("name")), "path string, name string")
    for k, batch in enumerate((saved.union(stale), again, gone)):
        table.apply(batch, k)
    return table.current()
