import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.queries import carrier_queries, engine_queries, operator_queries, plan_queries

ALL = {**carrier_queries.QUERIES, **operator_queries.QUERIES, **engine_queries.QUERIES, **plan_queries.QUERIES}
ORACLES = {**carrier_queries.ORACLES, **operator_queries.ORACLES, **engine_queries.ORACLES, **plan_queries.ORACLES}
CHEAP = [k for k in ALL if k not in {"transaction_span_payload", "dead_routines", "scc_components", "recursive_event_expansion"}]


def shown(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    df = ALL[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(tuple(map(shown, r)) for r in df.select(cols).collect())
    assert got == sorted(tuple(map(shown, r)) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
