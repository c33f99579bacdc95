"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Rows are dealt into candidate groups and query groups of bounded size, kept as
one packed matrix a row; every pair of groups is one unit of work. A candidate
group has one list a dimension, sorted once. Its lists are read from both ends
at one pace, so a candidate's depth is the least distance of any of its
components from an end of its list. Candidates are scored in order of depth,
all queries of the group at once; at a depth the bound is the best score that
components not yet reached allow, and a query stops as soon as that bound is
below its k-th score (a tie could still win by its id). Each pair yields at
most k rows a query, and a window over those gives the answer. On vectors whose
variance is even over the dimensions no bound falls below the k-th score before
the lists' middle, so there every candidate is scored; results are exact anyway.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.textbytes import freeing
from graphloom.storage import Stage

#: Vectors in a candidate group and in a query group.
CANDIDATES, QUERIES = 16_384, 1_024
_SCALE = 64


def quantised(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows.astype(np.float64) * _SCALE)


def sorted_lists(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(depth of each candidate, components sorted along each dimension)."""
    n = len(c)
    order = np.argsort(c, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], c.shape), 0)
    return np.minimum(place, n - 1 - place).min(1), np.take_along_axis(c, order, 0)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type in which all inner products are exact."""
    most = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(c).max(initial=0))
    if most < 1 << 24:
        return q.astype(np.float32), c.astype(np.float32)
    if most < 1 << 53:
        return q, c
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(c)


def top_k(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each query the ids and scores of its k best candidates but its own row, ties to smaller ids; and how many were scored."""
    q, c = _exact(q, c)
    depth, lists = sorted_lists(c)
    order = np.argsort(depth, kind="stable")
    c, c_ids, c_rows, depth = c[order], c_ids[order], c_rows[order], depth[order]
    n, m = len(c), len(q)
    zero = np.zeros_like(q)
    up, down = np.maximum(q, zero), np.minimum(q, zero)
    best_s = [np.zeros(0, q.dtype)] * m
    best_i = [np.zeros(0, np.int64)] * m
    active, at, step, scored = np.arange(m), 0, max(4 * k, 64), np.zeros(m, np.int64)
    while at < n and len(active):
        to = min(n, at + step)
        step *= 2
        to = n if n - to < step // 2 else int(np.searchsorted(depth, depth[to - 1], "right"))
        score = q[active] @ c[at:to].T
        scored[active] += to - at
        for row, qi in zip(score, active):
            if len(best_s[qi]) == k:
                keep = np.flatnonzero(row >= best_s[qi][-1])
            elif len(row) > 4 * k and row.dtype != object:
                keep = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
            else:
                keep = np.arange(len(row))
            keep = keep[c_rows[at + keep] != q_rows[qi]]
            if len(keep):
                s, i = np.concatenate((best_s[qi], row[keep])), np.concatenate((best_i[qi], c_ids[at + keep]))
                o = np.lexsort((i, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k])  # noqa: B023
                best_s[qi], best_i[qi] = s[o], i[o]
        at = to
        if at < n:
            d = int(depth[at])  # what is left lies between the d-th values from both ends
            bound = up[active] @ lists[n - 1 - d] + down[active] @ lists[d]
            kth = np.array([best_s[x][-1] if len(best_s[x]) == k else -math.inf for x in active])
            active = active[bound >= kth]
    return scored, best_i, best_s


def _pack(df: DataFrame, group: str, name: str) -> DataFrame:
    """Groups of quantised vectors, each in the narrowest integers that hold it (32 bits at most, else doubles)."""

    def run(batches):
        for b in batches:
            flat = quantised(b.column(3).flatten().to_numpy(zero_copy_only=False))
            off = b.column(3).offsets.to_numpy()
            off = (off - off[0]).tolist()
            most = float(np.abs(flat).max(initial=0))
            kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
            flat = flat.astype(kind)
            rows = list(zip(off, off[1:]))
            packed = [pa.array([z - a for a, z in rows], pa.int32()), pa.array([kind] * len(rows), pa.string()), pa.array([flat[a:z].tobytes() for a, z in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *packed], ["g", "id", "row", "d", "t", "v"])

    one = df.select(F.col(group).alias("g"), "id", "row", "v").mapInArrow(freeing(run), "g long, id long, row long, d int, t string, v binary")
    return one.groupBy("g").agg(F.collect_list(F.struct("id", "row", "d", "t", "v")).alias(name))


def _matrix(side: list) -> np.ndarray:
    return np.stack([np.frombuffer(x["v"], x["t"]).astype(np.float64) for x in side])


def _usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    return vector.isNotNull() & F.forall(x, finite)


def _pairs(k: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for qs, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for d in {x["d"] for x in qs}:  # vectors of another length have no inner product with these
                    q, c = ([x for x in side if x["d"] == d] for side in (qs, cs))
                    if not c:
                        continue
                    of = lambda side, key: np.array([x[key] for x in side], np.int64)
                    _, best, score = top_k(_matrix(q), of(q, "row"), _matrix(c), of(c, "id"), of(c, "row"), k)
                    for x, i, s in zip(q, best, score):
                        out[0] += [x["row"]] * len(i)
                        out[1] += [x["id"]] * len(i)
                        out[2] += i.tolist()
                        out[3] += [max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in s.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by the product of floor(64 x).

    Ties go to the smaller id. Vectors that are null, or hold null, NaN or
    infinite components, and rows with a null id take no part, nor do pairs of
    vectors of different lengths. Rows that repeat an id are rows of their own, as
    queries and as candidates; other columns play no part. Scores beyond a long
    are set to its ends.
    """
    stage = Stage(vectors.sparkSession, "top-k")
    v = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), "_q")
    v = stage.table("vectors", v.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
    sizes = v.agg(F.count(F.lit(1)), F.count_if("_q")).first()
    n_c, n_q = max(1, -(-sizes[0] // CANDIDATES)), max(1, -(-sizes[1] // QUERIES))
    c = _pack(v.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n_c))), "g", "cs")
    q = _pack(v.where("_q").withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n_q))), "g", "qs")
    # the stated queries against all rows, in blocks: each group goes to its row or column of units
    cs = c.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qg"), F.col("g").alias("cg"), "cs")
    qs = q.select(F.col("g").cast("long").alias("qg"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cg"), "qs")
    qs = qs.repartition(max(1, min(n_c * n_q, 20_000)), "qg", "cg")
    units = qs.join(cs, (qs["qg"] == cs["qg"]) & (qs["cg"] == cs["cg"])).select("qs", "cs")
    found = units.mapInArrow(freeing(_pairs(k)), "row long, query_id long, vec_id long, score long")
    w = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
