import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import threshold_topk as T


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for k2, (c, w) in enumerate(ok) if k2 != at and len(w) == len(v))[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "CANDIDATES", 60)
    monkeypatch.setattr(T, "QUERIES", 4)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.26, 1.3]) for _ in range(5)], "x", 1) for i in range(300)]
    rows += [(i, [0.5] * 5, "x", 1) for i in range(300, 340)]
    rows += [(1000, None, "x", 1), (1020, [0.1, None, 0.0, 0.0, 0.0], "x", 1), (1040, [math.nan, 0.0, 0.0, 0.0, 0.0], "x", 1), (None, [1.0] * 5, "x", 1), (1060, [1e9, -3e8, 0.1, 5e7, 1.0], "x", 1), (1080, [1.0, 2.0], "x", 1), (1081, [1.0, 2.5], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, g int")
    rows += [(40, [1.3, 1.3, 1.3, 0.1, 0.1], "x", 1), (40, [1.3, 1.3, 1.3, 0.1, 0.1], "x", 1), (7, [1.3] * 5, "x", 1)]  # ids that repeat
    df = spark.createDataFrame(rows, df.schema)
    assert sorted(tuple(r) for r in T.exact_top_k(df, F.col("vec_id") % 20 == 0, 7).collect()) == brute(rows, 7)


def test_stops_early_on_lists_with_a_clear_winner():
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(4000, 3)) * 8)
    c[:30] = 200
    q = np.array([[5.0, 4.0, 3.0]])
    scored, ids, _ = T.top_k(q, np.array([-1]), c, np.arange(4000), np.arange(4000), 20)
    assert scored[0] < 1000 and ids[0].tolist() == list(range(20))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.exact_top_k(df, F.col("vec_id") % 20 == 0).count() == 0
