"""Registered queries over the driver tables, each with the SQL that must give the same rows.

Recursive queries run on the DataFrame operators (closure, spans, ...); their
oracle is a recursive CTE. Queries without recursion are one declarative plan,
given as SQL that both engines understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.carrier import ACYCLIC, CALLS, FACTS, OPS, ROUTINES, STEPS, sql
from graphloom.operators.closure import reach_from, reach_summary, strong_components, transaction_spans, transitive_closure
from graphloom.operators.diff import keyed_diff, set_difference
from graphloom.operators.predicates import compile_predicate, glob
from graphloom.storage import Stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: (src, dst, d) of every reachable pair, as a recursive CTE.
REACH = "reach(src, dst, d) AS (SELECT src, dst, 1 FROM calls UNION SELECT r.src, c.dst, r.d + 1 FROM reach r JOIN calls c ON r.dst = c.src WHERE r.d < 60), closure AS (SELECT src, dst, min(d) AS dist FROM reach GROUP BY src, dst)"


def _plan(name: str, ctes: str, body: str, spark_body: str | None = None) -> None:
    """A query that both engines run as SQL."""
    text = f"WITH {ctes} {body}" if ctes else body
    QUERIES[name] = lambda spark, sf_dir, t=(f"WITH {ctes} {spark_body}" if spark_body and ctes else spark_body or text): sql(spark, sf_dir, t)
    ORACLES[name] = text


def _query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _rel(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {ctes} SELECT * FROM {name}")


def _closure(spark: SparkSession, sf_dir: str, ctes: str = CALLS) -> DataFrame:
    return transitive_closure(_rel(spark, sf_dir, ctes, "calls"), Stage(spark, "closure"))


def _rec(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}, {REACH} {body}"


@_query(_rec(CALLS, "SELECT src, count(*) AS reached, min(dst) AS least, max(dst) AS most FROM closure GROUP BY src"))
def closure_reach(spark, sf_dir):
    return _closure(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("reached"), F.min("dst").alias("least"), F.max("dst").alias("most"))


@_query(_rec(ACYCLIC, "SELECT src, dst, dist FROM closure"))
def closure_min_distance(spark, sf_dir):
    return _closure(spark, sf_dir, ACYCLIC)


@_query(_rec(CALLS, "SELECT o.o_orderkey AS node, coalesce(m.component, o.o_orderkey) AS component, coalesce(m.size, 1) AS size, m.src IS NOT NULL AS recursive FROM orders o LEFT JOIN (SELECT a.src, min(a.dst) AS component, count(*) AS size FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) m ON o.o_orderkey = m.src"))
def scc_components(spark, sf_dir):
    return strong_components(_rel(spark, sf_dir, CALLS, "calls"), _rel(spark, sf_dir, ROUTINES, "routines").select(F.col("id").alias("node")), Stage(spark, "scc"))


_BOTH = "pairs AS (SELECT src, dst, dist FROM closure UNION ALL SELECT o_orderkey, o_orderkey, 0 FROM orders)"


def _own_ops(spark, sf_dir):
    """Operations of the routines that are there."""
    return _rel(spark, sf_dir, OPS, "ops").join(_rel(spark, sf_dir, ROUTINES, "routines").select(F.col("id").alias("routine")), "routine", "left_semi")


@_query(_rec(ACYCLIC, "").rstrip() + f", {_BOTH}, {OPS} SELECT p.src AS routine, count(DISTINCT o.tab) AS tables_touched, count(*) FILTER (WHERE o.op = 'read') AS reads, count(*) FILTER (WHERE o.op IN ('insert', 'modify')) AS writes, min(p.dist) AS nearest FROM pairs p JOIN ops o ON p.dst = o.routine GROUP BY p.src")
def table_touch_down(spark, sf_dir):
    """What each routine touches, itself and through its calls."""
    facts = _own_ops(spark, sf_dir).select(F.col("routine").alias("node"), F.col("tab").alias("key"), (F.col("op") == "read").cast("int").alias("reads"), F.col("op").isin("insert", "modify").cast("int").alias("writes"))
    got = reach_summary(_rel(spark, sf_dir, ACYCLIC, "calls"), facts, ["reads", "writes"], Stage(spark, "touch"))
    return got.select(F.col("root").alias("routine"), F.col("keys").alias("tables_touched"), "reads", "writes", "nearest")


@_query(_rec(ACYCLIC, "").rstrip() + f", {_BOTH}, {OPS} SELECT o.tab, p.src AS routine, min(p.dist) AS nearest, count(*) AS places FROM pairs p JOIN ops o ON p.dst = o.routine WHERE o.op = 'modify' AND o.tab <= 7 GROUP BY o.tab, p.src")
def table_touch_up_scoped(spark, sf_dir):
    """Routines from which a modification of one of the scoped tables is reached."""
    ops = _own_ops(spark, sf_dir).where("op = 'modify' and tab <= 7").select("routine", "tab")
    seeds = ops.select(F.col("routine").alias("root"), F.col("routine").alias("node"))
    up = reach_from(seeds, _rel(spark, sf_dir, ACYCLIC, "calls").select(F.col("dst").alias("src"), F.col("src").alias("dst")), Stage(spark, "touch"))
    return up.join(ops, F.col("root") == F.col("routine")).groupBy("tab", "node").agg(F.min("dist").alias("nearest"), F.count(F.lit(1)).alias("places")).withColumnRenamed("node", "routine")


@_query(_rec(ACYCLIC, "SELECT dst AS node, src AS ancestor, dist FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS rn FROM closure) t WHERE rn <= 3"))
def ancestors_nearest(spark, sf_dir):
    from pyspark.sql import Window as W

    c = _closure(spark, sf_dir, ACYCLIC).withColumn("rn", F.row_number().over(W.partitionBy("dst").orderBy("dist", "src")))
    return c.where("rn <= 3").select(F.col("dst").alias("node"), F.col("src").alias("ancestor"), "dist")


_ROOTED = "roots AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), live AS (SELECT id FROM roots UNION SELECT dst FROM closure JOIN roots ON src = id)"


def _live(spark, sf_dir):
    roots = _rel(spark, sf_dir, ROUTINES, "routines").where("kind = 'trigger'").select(F.lit(0).alias("root"), F.col("id").alias("node"))
    return reach_from(roots, _rel(spark, sf_dir, CALLS, "calls"), Stage(spark, "live")).select("node")


@_query(_rec(CALLS, f", {_ROOTED} SELECT id AS node FROM live").replace(" ,", ","))
def reachable_from_roots(spark, sf_dir):
    return _live(spark, sf_dir)


@_query(_rec(CALLS, f", {_ROOTED}, {ROUTINES} SELECT r.id, r.kind, r.access FROM routines r WHERE r.kind = 'procedure' AND r.access <> 'public' AND r.id NOT IN (SELECT id FROM live)").replace(" ,", ","))
def dead_routines(spark, sf_dir):
    """Procedures that are not public and that no trigger reaches."""
    r = _rel(spark, sf_dir, ROUTINES, "routines").where("kind = 'procedure' and access <> 'public'")
    return r.join(_live(spark, sf_dir), F.col("id") == F.col("node"), "left_anti").select("id", "kind", "access")


_SPAN = f"{OPS}, commits AS (SELECT DISTINCT routine AS id FROM ops WHERE op = 'commit'), span(seed, member, d) AS (SELECT id, id, 0 FROM commits UNION SELECT s.seed, c.src, s.d + 1 FROM span s JOIN calls c ON c.dst = s.member WHERE s.d < 50 AND (s.d = 0 OR s.member NOT IN (SELECT id FROM commits)))"


@_query(f"WITH RECURSIVE {ACYCLIC}, {_SPAN}, m AS (SELECT seed, member, min(d) AS d FROM span GROUP BY seed, member) SELECT m.seed, count(DISTINCT m.member) AS members, max(m.d) AS depth, count(DISTINCT CASE WHEN o.op IN ('insert', 'modify') THEN o.tab END) AS tables_written FROM m LEFT JOIN ops o ON m.member = o.routine GROUP BY m.seed")
def transaction_span_payload(spark, sf_dir):
    """Members, depth and tables written of each span that an explicit commit ends."""
    ops = _rel(spark, sf_dir, OPS, "ops")
    spans = transaction_spans(ops.where("op = 'commit'").select(F.col("routine").alias("node")).distinct(), _rel(spark, sf_dir, ACYCLIC, "calls"), Stage(spark, "spans"))
    j = spans.join(ops, F.col("member") == F.col("routine"), "left")
    return j.groupBy("seed").agg(F.countDistinct("member").alias("members"), F.max("dist").alias("depth"), F.countDistinct(F.when(F.col("op").isin("insert", "modify"), F.col("tab"))).alias("tables_written"))


@_query(_rec(ACYCLIC, "").rstrip() + f", {OPS}, {ROUTINES} SELECT r.id AS subscriber, count(DISTINCT c.dst) AS committing, min(c.dist) AS nearest FROM routines r JOIN closure c ON r.id = c.src JOIN ops o ON c.dst = o.routine WHERE r.kind = 'event-subscriber' AND o.op = 'commit' GROUP BY r.id")
def commit_reachable_from_subscriber(spark, sf_dir):
    subs = _rel(spark, sf_dir, ROUTINES, "routines").where("kind = 'event-subscriber'").select(F.col("id").alias("node"))
    commits = _rel(spark, sf_dir, OPS, "ops").where("op = 'commit'").select(F.col("routine").alias("node")).distinct().withColumn("key", F.col("node"))
    got = reach_summary(_rel(spark, sf_dir, ACYCLIC, "calls"), commits, [], Stage(spark, "commits"), subs, True)
    return got.select(F.col("root").alias("subscriber"), F.col("keys").alias("committing"), "nearest")


_OLD_NEW = ["owner", "kind", "rank"]


@_query(f"WITH {FACTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old_facts a FULL JOIN new_facts b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.owner IS DISTINCT FROM b.owner OR a.kind IS DISTINCT FROM b.kind OR a.rank IS DISTINCT FROM b.rank")
def diff_schema(spark, sf_dir):
    return keyed_diff(_rel(spark, sf_dir, FACTS, "old_facts"), _rel(spark, sf_dir, FACTS, "new_facts"), ["id"], _OLD_NEW)


@_query(f"WITH {FACTS}, d AS (SELECT a.owner AS o1, b.owner AS o2, a.id AS i1, b.id AS i2, a.kind AS k1, b.kind AS k2, a.rank AS r1, b.rank AS r2 FROM old_facts a FULL JOIN new_facts b ON a.id = b.id) SELECT CASE WHEN i1 IS NULL THEN 'added' WHEN i2 IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM d WHERE i1 IS NULL OR i2 IS NULL OR k1 <> k2 OR r1 <> r2 GROUP BY 1")
def diff_summary(spark, sf_dir):
    return diff_schema(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {FACTS}, a AS (SELECT DISTINCT owner, kind FROM old_facts), b AS (SELECT DISTINCT owner, kind FROM new_facts) SELECT owner, kind, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT owner, kind, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y")
def coverage_set_equality(spark, sf_dir):
    return set_difference(_rel(spark, sf_dir, FACTS, "old_facts"), _rel(spark, sf_dir, FACTS, "new_facts"), ["owner", "kind"])


_POLICY = {"any": [{"all": [{"lang": {"equals": "en"}}, {"not": {"toxic": {"equals": 1}}}]}, {"all": [{"quality": {"min": 1}}, {"source": {"in": ["src1", "src2"]}}]}]}


@_query("SELECT d.doc_id, ((d.lang = 'en' AND NOT (l.toxic = 1)) OR (l.quality >= 1 AND d.source IN ('src1', 'src2'))) AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def policy_kleene(spark, sf_dir):
    """A policy over facts of which some are unknown: true, false or null."""
    d, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    j = d.select("doc_id", "lang", "source").join(n, "doc_id", "left")
    return j.select("doc_id", compile_predicate(_POLICY, {c: F.col(c) for c in ("lang", "source", "quality", "toxic")}).alias("verdict"))


@_query("SELECT p_partkey, p_name, regexp_matches(lower(p_type), '^.*st.e.*$') AS hit FROM part")
def policy_glob(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", glob(F.col("p_type"), "*ST?E*").alias("hit"))


_plan("coverage_gate", "", "SELECT d.source, count(*) AS docs, count(l.doc_id) AS covered, CASE WHEN count(l.doc_id) = count(*) THEN 'complete' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'unknown' END AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
_plan("commit_in_loop", OPS, "SELECT routine, count(*) AS commits, min(ord) AS first_ord FROM ops WHERE op = 'commit' AND in_loop GROUP BY routine")
_plan("write_pending_at_io", STEPS, """, s AS (SELECT routine, step, op, ord, max(CASE WHEN op = 'write' THEN ord END) OVER w AS last_write, max(CASE WHEN op = 'commit' THEN ord END) OVER w AS last_commit
  FROM steps WINDOW w AS (PARTITION BY routine ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT routine, step, ord, last_write FROM s WHERE op = 'io' AND last_write > coalesce(last_commit, 0)""".lstrip())
_plan("io_before_commit", STEPS, "SELECT a.routine, a.step, a.ord, min(b.ord) AS commit_ord FROM steps a JOIN steps b ON a.routine = b.routine AND b.op = 'commit' AND b.ord > a.ord WHERE a.op = 'io' GROUP BY a.routine, a.step, a.ord",
      ", s AS (SELECT *, min(CASE WHEN op = 'commit' THEN ord END) OVER (PARTITION BY routine ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS commit_ord FROM steps) SELECT routine, step, ord, commit_ord FROM s WHERE op = 'io' AND commit_ord IS NOT NULL")
_plan("commit_dominates_return", STEPS, "SELECT routine, max(CASE WHEN op = 'commit' THEN ord END) AS last_commit, max(CASE WHEN op = 'write' THEN ord END) AS last_write, coalesce(max(CASE WHEN op = 'commit' THEN ord END) > max(CASE WHEN op = 'write' THEN ord END), false) AS write_committed FROM steps GROUP BY routine")
_plan("load_before_modify_asof", OPS, ", s AS (SELECT *, max(CASE WHEN op = 'read' THEN ord END) OVER (PARTITION BY routine ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS loaded FROM ops) SELECT routine, ord, tab, loaded FROM s WHERE op = 'modify'")
_plan("bulk_write_unfiltered", OPS, "SELECT routine, tab, count(*) AS writes FROM ops o WHERE op IN ('modify', 'insert') AND NOT EXISTS (SELECT 1 FROM ops r WHERE r.routine = o.routine AND r.op = 'read' AND r.ord < o.ord) GROUP BY routine, tab",
      ", s AS (SELECT *, min(CASE WHEN op = 'read' THEN ord END) OVER (PARTITION BY routine) AS first_read FROM ops) SELECT routine, tab, count(*) AS writes FROM s WHERE op IN ('modify', 'insert') AND (first_read IS NULL OR first_read >= ord) GROUP BY routine, tab")
_plan("validate_without_persist", OPS, "SELECT routine, count(*) AS locks FROM ops WHERE op = 'lock' GROUP BY routine HAVING routine NOT IN (SELECT routine FROM ops WHERE op IN ('insert', 'modify'))",
      "SELECT routine, count_if(op = 'lock') AS locks FROM ops GROUP BY routine HAVING count_if(op = 'lock') > 0 AND count_if(op IN ('insert', 'modify')) = 0")
_plan("repeated_lookup", OPS, "SELECT routine, op, count(*) AS n, count(DISTINCT tab) AS tabs FROM ops WHERE op = 'read' GROUP BY routine, op HAVING count(*) > 1")
_plan("cross_app_edges", CALLS, ", apps AS (SELECT o.o_orderkey AS id, c.c_nationkey AS app, o.o_orderpriority AS pr FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) SELECT a.app, b.pr AS callee_priority, count(*) AS edges FROM calls e JOIN apps a ON e.src = a.id JOIN apps b ON e.dst = b.id GROUP BY a.app, b.pr")
_plan("suppression_window", OPS, "SELECT f.routine, f.ord, count(*) AS directives FROM ops f JOIN ops s ON f.routine = s.routine AND s.op = 'lock' AND f.ord - s.ord BETWEEN 0 AND 1 WHERE f.op <> 'lock' GROUP BY f.routine, f.ord")
_plan("diff_capabilities", FACTS, ", lost AS (SELECT owner, kind, rank FROM old_facts EXCEPT SELECT owner, kind, rank FROM new_facts), gained AS (SELECT owner, kind, rank FROM new_facts EXCEPT SELECT owner, kind, rank FROM old_facts) SELECT owner, kind, rank, 'lost' AS what FROM lost UNION ALL SELECT owner, kind, rank, 'gained' FROM gained")
_plan("presence_lattice", OPS, "SELECT routine, max(CASE op WHEN 'modify' THEN 2 WHEN 'lock' THEN 1 ELSE 0 END) AS modifies, max(CASE op WHEN 'read' THEN 2 WHEN 'lock' THEN 1 ELSE 0 END) AS loads FROM ops GROUP BY routine")
_plan("via_precedence", OPS, ", s AS (SELECT *, CASE op WHEN 'modify' THEN 4 WHEN 'insert' THEN 3 WHEN 'read' THEN 2 WHEN 'lock' THEN 1 ELSE 0 END AS via, row_number() OVER (PARTITION BY routine, tab ORDER BY CASE op WHEN 'modify' THEN 4 WHEN 'insert' THEN 3 WHEN 'read' THEN 2 WHEN 'lock' THEN 1 ELSE 0 END DESC, ord) AS rn FROM ops) SELECT routine, tab, via, ord FROM s WHERE rn = 1")
_plan("fingerprint_sha256", "", "SELECT p_partkey, substr(sha256(concat(p_brand, '|', p_type, '|', CAST(p_size AS STRING))), 1, 16) AS fingerprint FROM part", "SELECT p_partkey, substr(sha2(concat(p_brand, '|', p_type, '|', CAST(p_size AS STRING)), 256), 1, 16) AS fingerprint FROM part")
_plan("identifier_fold", "", "SELECT lower(p_type) AS folded, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY lower(p_type)")
_plan("version_compare", "v AS (SELECT p_partkey AS id, p_size AS major, p_partkey % 7 AS minor FROM part)", "SELECT a.id, CASE WHEN a.major > b.major OR (a.major = b.major AND a.minor > b.minor) THEN 'newer' WHEN a.major = b.major AND a.minor = b.minor THEN 'same' ELSE 'older' END AS verdict FROM v a JOIN v b ON a.id + 1 = b.id")


@_query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), chain(conv_id, turn, d) AS (
  SELECT conv_id, min(turn), 0 FROM t GROUP BY conv_id UNION SELECT c.conv_id, t.turn, c.d + 1 FROM chain c JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn + 1 WHERE c.d < 16)
  SELECT conv_id, max(d) AS hops, max(turn) AS last_turn, max(d) = 16 AS capped FROM chain GROUP BY conv_id""")
def event_chain_bounded(spark, sf_dir):
    """How far each conversation's chain of consecutive turns goes, at most 16 hops."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    edges = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi").select(node(F.col("turn")).alias("src"), node(F.col("turn") + 1).alias("dst"))
    seeds = t.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(F.col("conv_id").alias("root"), node(F.col("turn")).alias("node"))
    got = reach_from(seeds, edges, Stage(spark, "chains"), max_depth=16)
    return got.groupBy(F.col("root").alias("conv_id")).agg(F.max("dist").alias("hops"), F.max("node.turn").alias("last_turn"), (F.max("dist") == 16).alias("capped"))
