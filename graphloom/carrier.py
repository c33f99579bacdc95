"""Program facts carried by the driver tables, as SQL common to Spark and other engines."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SEQ = """seq AS (SELECT o_orderkey AS k, o_custkey AS c, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS f
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
ACYCLIC = SEQ + ", calls AS (SELECT k AS src, nxt AS dst FROM seq WHERE nxt IS NOT NULL)"
CALLS = SEQ + ", calls AS (SELECT k AS src, nxt AS dst FROM seq WHERE nxt IS NOT NULL UNION ALL SELECT k AS src, f AS dst FROM seq WHERE nxt IS NULL AND c % 5 = 0)"
ROUTINES = """routines AS (SELECT o_orderkey AS id, o_custkey AS object,
  CASE o_orderstatus WHEN 'O' THEN 'procedure' WHEN 'F' THEN 'trigger' ELSE 'event-subscriber' END AS kind,
  CASE o_orderpriority WHEN '5-LOW' THEN 'local' WHEN '4-NOT SPECIFIED' THEN 'internal' ELSE 'public' END AS access, o_orderdate AS made FROM orders)"""
OPS = """ops AS (SELECT l_orderkey AS routine, l_suppkey AS tab, l_partkey AS part, l_linenumber >= 6 AS in_loop,
  CASE WHEN l_returnflag = 'R' THEN 'read' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'insert' WHEN l_returnflag = 'A' THEN 'modify'
       WHEN l_linestatus = 'O' THEN 'lock' ELSE 'commit' END AS op,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS ord
  FROM lineitem)"""
STEPS = """steps AS (SELECT user_id AS routine, event_id AS step, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
  CASE event_type WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'io' WHEN 'view' THEN 'commit' WHEN 'error' THEN 'error' ELSE 'ui' END AS op FROM events)"""
FACTS = """old_facts AS (SELECT p_partkey AS id, p_brand AS owner, p_type AS kind, p_size AS rank FROM part WHERE p_partkey % 10 <> 0),
 new_facts AS (SELECT p_partkey AS id, p_brand AS owner, CASE WHEN p_partkey % 17 = 0 THEN concat(p_type, ' X') ELSE p_type END AS kind,
   CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 WHEN p_partkey % 11 = 0 THEN p_size - 1 ELSE p_size END AS rank FROM part WHERE p_partkey % 10 <> 1)"""
FINDINGS = """findings AS (SELECT concat('d', CAST(l_suppkey % 12 AS STRING)) AS detector, l_orderkey AS routine, l_suppkey AS tab,
  CASE l_returnflag WHEN 'R' THEN 'info' WHEN 'A' THEN 'warning' ELSE 'error' END AS severity,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS sev_rank, l_linenumber AS line, l_partkey AS part FROM lineitem)"""


_NAMED = re.compile(rf"\b(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b", re.IGNORECASE)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the driver tables that it names after FROM or JOIN, under view names of its own."""
    mark = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    for t in {m[2].lower() for m in _NAMED.findall(text)}:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"graphloom_{mark}_{t}")
    return spark.sql(_NAMED.sub(lambda m: f"{m[1]}{m[2]}graphloom_{mark}_{m[3].lower()}", text))
