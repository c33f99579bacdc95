"""Weak components of a graph dealt out over tasks, each worked on as a whole in memory.

Nothing that a node reaches lies outside its weak component. So components of up to
SOLO edges go to one task each, many to a task, where closures, cones and paths are made
by arrays, without a shuffle of pairs; larger ones stay with the operators' rounds
over the cluster. Components are found by contracting what lies together in a task first, and
joining only what is left between tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.components import connected_components
from graphloom.storage import Stage

#: Edges of a component, and facts of a node in it, that one task takes.
SOLO, FACTS = 4_000, 500
#: Edges that are contracted at once, and links between contracted parts that one task joins.
AT_ONCE = 500_000
#: Rows that are worked on at once, and cells of an array of distances.
ROWS, CELLS = 100_000, 500_000
#: Edges of a task that works on parts, and of one that groups nodes.
TASK_EDGES, NODES = 50_000, 200_000


def plain(*types: T.DataType) -> bool:
    """Whether ids of these types can be worked on here: all of one type, a whole number or a text."""
    return len(set(types)) == 1 and types[0] in (T.ShortType(), T.IntegerType(), T.LongType(), T.StringType())


def column_types(df: DataFrame, *names: str) -> list[T.DataType]:
    return [df.schema[n].dataType for n in names]


def _encoded(*columns) -> tuple[list[np.ndarray], pa.Array]:
    """Codes of each column in one dictionary, which may hold null."""
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    enc = pc.dictionary_encode(pa.concat_arrays(flat), null_encoding="encode")
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in flat])[:-1]), enc.dictionary


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of ``n`` nodes over edges: equal where they are connected."""
    lab = np.arange(n)
    while len(a):
        lo, hi = np.minimum(lab[a], lab[b]), np.maximum(lab[a], lab[b])
        open_ = lo < hi
        a, b = a[open_], b[open_]
        np.minimum.at(lab, hi[open_], lo[open_])
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def _contract(batches: Iterator[pa.RecordBatch], at_once: float) -> Iterator[pa.RecordBatch]:
    """The edges with the root of what is connected among those at hand."""
    held, n = [], 0
    for b in _until(batches):
        if b is not None:
            held.append(b)
            n += b.num_rows
        if held and (b is None or n >= at_once):
            t = pa.Table.from_batches(held)
            (x, y), ids = _encoded(t["src"], t["dst"])
            yield from t.append_column("root", ids.take(pa.array(_roots(x, y, len(ids))[x]))).combine_chunks().to_batches()
            held, n = [], 0


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of both ends of edges, once each among those at hand; grouping texts by Spark would sort all rows of a file."""
    held, n = [], 0
    for b in _until(batches):
        if b is not None:
            held.append(b)
            n += b.num_rows
        if held and (b is None or n >= AT_ONCE):
            t = pa.Table.from_batches(held)
            (x, y, r), ids = _encoded(t["src"], t["dst"], t["root"])
            pairs = np.unique(np.concatenate([x, y]) * len(ids) + np.concatenate([r, r]))
            for k in range(0, len(pairs), ROWS):
                some = pairs[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some // len(ids))), ids.take(pa.array(some % len(ids)))], ["node", "root"])
            held, n = [], 0


class _until:  # noqa: N801
    """The items of an iterator, then None."""

    def __init__(self, items):
        self.items = items

    def __iter__(self):
        yield from self.items
        yield None


@dataclass
class Parts:
    """Edges with ``part``; ``nodes(node, part)``; ``big(part)`` or None; ``tasks``."""

    edges: DataFrame
    nodes: DataFrame
    big: DataFrame | None
    tasks: int

    def place(self, df: DataFrame, column: str) -> DataFrame:
        """Rows with the part of the node in a column; one that stands in no edge is a part of its own."""
        n = self.nodes.select(F.col("node").alias("_node"), "part").hint("merge")  # small as a file, not as a broadcast
        return df.join(n, F.col(column) == F.col("_node"), "left").withColumn("part", F.coalesce("part", F.col(column))).drop("_node")

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows with ``part``, of the components that one task takes and of the others; None if there are none of those."""
        if self.big is None:
            return df, None
        return df.join(F.broadcast(self.big), "part", "left_anti"), df.join(F.broadcast(self.big), "part", "left_semi")


def weak_parts(edges: DataFrame, stage: Stage, name: str, facts: DataFrame | None = None) -> Parts:
    """The weak components of ``edges(src, dst, ...)`` without null ends; ``facts(node, ...)`` count for what one task takes."""
    one, name = edges.schema["src"].dataType, f"{name}-{uuid.uuid4().hex[:8]}"  # what is made of it is read later, whoever uses the stage in between
    lab = stage.table(f"{name}-lab", edges.mapInArrow(partial(_contract, at_once=AT_ONCE), T.StructType([*edges.schema.fields, T.StructField("root", one)])))
    n, cores = lab.count(), edges.sparkSession.sparkContext.defaultParallelism
    ends = lambda df: df.select("src", "dst", "root").mapInArrow(_ends, T.StructType([T.StructField("node", one), T.StructField("root", one)]))
    # so many partitions that one holds about as many rows whatever the input
    nodes = stage.table(f"{name}-nodes", ends(lab).repartition(n // NODES + 1, "node").groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    cross = nodes.where("root <> other")
    if cross.isEmpty():
        lab, nodes = lab.withColumnRenamed("root", "part"), nodes.select("node", F.col("root").alias("part"))
    else:
        links = ends(lab).join(cross.select("node", F.col("root").alias("dst")), "node").select(F.col("root").alias("src"), "dst").where("src <> dst").distinct()
        links = stage.table(f"{name}-links", links)
        if links.count() <= AT_ONCE:
            found = ends(links.coalesce(1).mapInArrow(partial(_contract, at_once=float("inf")), T.StructType([*links.schema.fields, T.StructField("root", one)]))).distinct()
            found = found.select(F.col("node").alias("root"), F.col("root").alias("part"))
        else:
            found = connected_components(links, stage, f"{name}-cc").select(F.col("node").alias("root"), F.col("component").alias("part"))
        found = stage.table(f"{name}-found", found)
        joined = lambda df: df.join(found, "root", "left").withColumn("part", F.coalesce("part", "root")).drop("root")
        lab, nodes = joined(lab), joined(nodes.drop("other"))
    big = lab.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SOLO).select("part")
    if facts is not None:
        many = facts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FACTS)
        big = big.union(many.join(nodes, "node", "left").select(F.coalesce("part", "node"))).distinct()
    big = stage.table(f"{name}-big", big)
    if big.isEmpty():
        big = None
    return Parts(lab, nodes, big, min(5_000, max(n // TASK_EDGES, min(n // 2_000, cores) if facts is None else cores, 1)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by part, as tables of whole parts."""
    held, n = [], 0
    for b in _until(batches):
        if b is not None and b.num_rows:
            held.append(b)
            n += b.num_rows
        if held and (b is None or n >= ROWS):
            t = pa.Table.from_batches(held)
            p = t["part"]
            cut = t.num_rows if b is None else t.num_rows - (pc.sum(pc.equal(p, p[-1])).as_py() or 0)
            if cut:
                yield t.slice(0, cut).combine_chunks()
                held = t.slice(cut).to_batches()
                n = sum(x.num_rows for x in held)


def solve(parts: Parts, tables: list[DataFrame], work: Callable, schema: str | T.StructType) -> DataFrame:
    """``work(table)`` over whole parts: rows of all tables, each with ``part``, ``x`` and columns of its own, told apart by ``which``, their place in the list."""
    rows = tables[0].withColumn("which", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("which", F.lit(k)), allowMissingColumns=True)

    def run(batches):
        for t in _whole(batches):
            for out in work(t):
                yield from pa.Table.from_pydict(out).to_batches(max_chunksize=100_000)

    return rows.repartition(parts.tasks, "part").sortWithinPartitions("part").mapInArrow(run, schema)


class Graph:
    """Nodes of a table's rows, numbered part by part in the order of their ids, and edges by their source."""

    def __init__(self, t: pa.Table, back: bool = False):
        which = t["which"].to_numpy()
        e = np.flatnonzero(which == 0)
        edges = t.take(pa.array(e))
        (x, y), ids = _encoded(t["x"], edges["y"])
        (p,), _ = _encoded(t["part"])
        n = len(ids)
        part = np.empty(n, np.int64)
        part[x], part[y] = p, p[e]
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        order = np.lexsort((rank, part))
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        self.n, self.ids, self.part, self.x = n, ids.take(pa.array(order)), part[order], new[x]
        self.size = np.bincount(self.part)
        self.start = np.cumsum(self.size) - self.size
        self.rows = {int(k): np.flatnonzero(which == k) for k in np.unique(which)}
        a, b = self.x[e], new[y]
        self.table, self.which = t, which
        self.src, self.dst = (b, a) if back else (a, b)
        self.at, self.by = grouped(self.src, n)
        self.to = self.dst[self.by]

    def of(self, k: int) -> tuple[np.ndarray, pa.Table]:
        """Nodes and rows of one of the tables."""
        r = self.rows.get(k, np.empty(0, np.int64))
        return self.x[r], self.table.take(pa.array(r))

    def name(self, nodes: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(nodes))


def grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of each of ``n`` keys begin, and the rows in that order."""
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(keys, minlength=n), out=at[1:])
    return at, np.argsort(keys, kind="stable")


def spread(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``keys``, place) for all places of each key."""
    n = at[keys + 1] - at[keys]
    rep = np.repeat(np.arange(len(keys)), n)
    return rep, np.arange(len(rep)) + np.repeat(at[keys] - (np.cumsum(n) - n), n)


def reach(g: Graph, root_part: np.ndarray, seed_root: np.ndarray, seed: np.ndarray, proper: bool = False, stops: np.ndarray | None = None, max_depth: int | None = None, cost: np.ndarray | None = None):
    """Blocks (root, node, dist) of what each root reaches from its seeds, by fewest edges.

    A seed itself is at 0 or, if ``proper``, where a path of one edge or more leads back. Roots are numbers in the order
    of their seeds; ``cost`` of a part bounds the block beside its size.
    """
    size = g.size[root_part]
    block = np.cumsum(size if cost is None else np.maximum(size, cost[root_part])) // CELLS
    cuts = np.flatnonzero(np.diff(block)) + 1
    for j0, j1 in zip([0, *cuts], [*cuts, len(root_part)]):
        base = np.cumsum(size[j0:j1]) - size[j0:j1] - g.start[root_part[j0:j1]]
        cells = int(size[j0:j1].sum())
        dist, owner = np.full(cells, -1, np.int32), np.empty(cells, np.int64)
        lo, hi = np.searchsorted(seed_root, [j0, j1])
        j, v, d, got = seed_root[lo:hi] - j0, seed[lo:hi], 0, []
        if not proper:
            c = base[j] + v
            owner[c] = np.arange(len(c))
            first = owner[c] == np.arange(len(c))
            j, v = j[first], v[first]
            dist[c] = 0
            got.append((j, v, np.zeros(len(j), np.int32)))
        while len(j) and (max_depth is None or d < max_depth):
            d += 1
            if stops is not None and d > 1:
                on = ~stops[v]
                j, v = j[on], v[on]
            rep, k = spread(g.at, v)
            j, v = j[rep], g.to[k]
            c = base[j] + v
            new = dist[c] < 0
            j, v, c = j[new], v[new], c[new]
            owner[c] = np.arange(len(c))
            first = owner[c] == np.arange(len(c))
            j, v = j[first], v[first]
            dist[c] = d
            got.append((j, v, np.full(len(j), d, np.int32)))
        if got:
            yield np.concatenate([x[0] for x in got]) + j0, np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])


def closure_work(t: pa.Table):
    g = Graph(t)
    src = np.unique(g.src)
    for j, v, d in reach(g, g.part[src], np.arange(len(src)), src, proper=True):
        yield {"src": g.name(src[j]), "dst": g.name(v), "dist": pa.array(d)}


def components_work(t: pa.Table):
    """Strong components of two nodes or more, under their least node, by one walk in depth."""
    g = Graph(t)
    at, to = g.at.tolist(), g.to.tolist()
    index, low, place, path, todo, count = [0] * g.n, [0] * g.n, list(at), [], [], 0
    node, least, size = [], [], []
    for root in np.unique(g.src).tolist():
        if index[root]:
            continue
        todo.append(root)
        while todo:
            v = todo[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                path.append(v)
            if place[v] < at[v + 1]:
                w = to[place[v]]
                place[v] += 1
                if not index[w]:
                    todo.append(w)
                elif low[w] > 0 and index[w] < low[v]:  # still on the path
                    low[v] = index[w]
                continue
            todo.pop()
            if todo and low[v] < low[todo[-1]]:
                low[todo[-1]] = low[v]
            if low[v] == index[v]:
                k = len(path) - 1
                while path[k] != v:
                    k -= 1
                found = path[k:]
                del path[k:]
                if len(found) > 1:
                    node += found
                    least += [min(found)] * len(found)
                    size += [len(found)] * len(found)
                for w in found:  # off the path
                    low[w] = -1
    if node:
        yield {"node": g.name(np.array(node)), "component": g.name(np.array(least)), "size": pa.array(size, pa.int64())}


def reach_work(t: pa.Table, max_depth: int | None, stopped: bool):
    g = Graph(t)
    v, rows = g.of(1)
    if not len(v):
        return
    (label,), names = _encoded(rows["root"])
    pair, inverse = np.unique(g.part[v] * len(names) + label, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    stops = None
    if stopped:
        stops = np.zeros(g.n, bool)
        stops[g.of(2)[0]] = True
    for j, n, d in reach(g, pair // len(names), inverse[order], v[order], stops=stops, max_depth=max_depth):
        yield {"root": names.take(pa.array(pair[j] % len(names))), "node": g.name(n), "dist": pa.array(d)}


def keyed(rows: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each row's key in the order of the columns, nulls last, and a row that holds each."""
    code = np.zeros(rows.num_rows, np.int64)
    for c in columns:
        (k,), values = _encoded(rows[c])
        rank = np.empty(len(values), np.int64)
        rank[pc.sort_indices(values, null_placement="at_end").to_numpy()] = np.arange(len(values))
        code = np.unique(code * max(len(values), 1) + rank[k], return_inverse=True)[1]
    one = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    one[code] = np.arange(len(code))
    return code, one


def nearest(g: Graph, node: np.ndarray, key: np.ndarray, keys: int):
    """Blocks (root, key, dist, origin): the nearest fact of each key that each node reaches, of equally near ones the one at the least node."""
    at, by = grouped(node, g.n)
    cost = np.bincount(g.part[node], minlength=len(g.size))
    every = np.arange(g.n)
    for j, v, d in reach(g, g.part, every, every, cost=cost):
        rep, k = spread(at, v)
        if not len(rep):
            continue
        r, f = j[rep], key[by[k]]
        r0, wide = r.min(), int(g.size.max())
        far = d[rep].astype(np.int64) * wide + (v - g.start[g.part[v]])[rep]
        most = int(far.max()) + 1
        of = (r - r0) * keys + f
        if (int(of.max()) + 1) * most < 2**62:
            both = np.sort(of * most + far)
            of, far = both // most, both % most
        else:
            order = np.lexsort((far, of))
            of, far = of[order], far[order]
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        of, far = of[first], far[first]
        r = of // keys + r0
        yield r, of % keys, far // wide, far % wide + g.start[g.part[r]]


def cones_work(t: pa.Table, key: list[str]):
    g = Graph(t)
    node, rows = g.of(1)
    if not len(node):
        return
    code, one = keyed(rows, key)
    for r, k, d, o in nearest(g, node, code, len(one)):
        held = rows.select(key).take(pa.array(one[k]))
        yield {"routine_id": g.name(r), **{c: held[c] for c in key}, "dist": pa.array(d.astype(np.int32)), "origin": g.name(o)}


def digest_work(t: pa.Table, key: list[str]):
    """Of the nearest facts by ``key``, whose second column is the one to take the least of: how many, sum of distances, least, by the first column."""
    g = Graph(t)
    node, rows = g.of(1)
    if not len(node):
        return
    code, one = keyed(rows, key)
    (group,), groups = _encoded(rows[key[0]])
    group = group[one]
    for r, k, d, _ in nearest(g, node, code, len(one)):
        # keys of one group follow each other, the least value first
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (group[k[1:]] != group[k[:-1]])
        at = np.flatnonzero(new)
        n = np.diff([*at, len(r)])
        yield {"routine_id": g.name(r[at]), key[0]: groups.take(pa.array(group[k[at]])), "keys": pa.array(n), "dists": pa.array(np.add.reduceat(d, at)), "least": rows[key[1]].take(pa.array(one[k[at]]))}


def summary_work(t: pa.Table, weights: list[str], proper: bool, roots: bool):
    """Per root (all nodes, or those of the third table): distinct keys, sums of weights and least distance of the facts that it reaches."""
    g = Graph(t)
    node, rows = g.of(1)
    start = np.unique(g.of(2)[0]) if roots else np.arange(g.n)
    if not len(node) or not len(start):
        return
    (key,), values = _encoded(rows["key"])
    none = np.flatnonzero(pc.is_null(values).to_numpy(zero_copy_only=False))
    at, by = grouped(node, g.n)
    w = {c: rows[c].to_numpy() for c in weights}
    cost = np.bincount(g.part[node], minlength=len(g.size))
    for j, v, d in reach(g, g.part[start], np.arange(len(start)), start, proper=proper, cost=cost):
        rep, k = spread(at, v)
        if not len(rep):
            continue
        f, r = by[k], j[rep]
        r0 = r.min()
        n = int(r.max() - r0) + 1
        pairs = np.unique((r - r0) * len(values) + key[f])
        pairs = pairs[~np.isin(pairs % len(values), none)]
        near = np.full(n, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(near, r - r0, d[rep])
        there = np.flatnonzero(np.bincount(r - r0, minlength=n))
        out = {"root": g.name(start[there + r0]), "keys": pa.array(np.bincount(pairs // len(values), minlength=n)[there])}
        for c in weights:
            out[c] = pa.array(np.bincount(r - r0, weights=w[c][f], minlength=n)[there].astype(np.int64))
        yield {**out, "nearest": pa.array(near[there])}


def roles_work(t: pa.Table, roles: list[str], rounds: int):
    """Ranks of each (x, position): own ones, and those of what it is passed to; a callee without a rank counts as 2."""
    g = Graph(t)
    e, own, open_ = g.of(0)[1], g.of(1), g.of(2)
    (p, q, po, pu), names = _encoded(e["position"], e["callee_position"], own[1]["position"], open_[1]["position"])
    many = len(names)
    caller, callee, mine, blind = g.src * many + p, g.dst * many + q, own[0] * many + po, open_[0] * many + pu
    keys = np.unique(np.concatenate([caller, mine, blind]))
    at = np.minimum(np.searchsorted(keys, callee), len(keys) - 1)
    there = keys[at] == callee
    caller, mine, blind = (np.searchsorted(keys, k) for k in (caller, mine, blind))
    out = {"routine_id": g.name(keys // many), "position": names.take(pa.array(keys % many))}
    for r in roles:
        cur = np.zeros(len(keys), np.int64)
        np.maximum.at(cur, mine, own[1][r].fill_null(0).to_numpy())
        for _ in range(rounds):
            new = cur.copy()
            had = np.where(there, cur[at], 0)
            np.maximum.at(new, caller, np.where(had == 0, 2, had))
            np.maximum.at(new, blind, 2)
            if (new == cur).all():
                break
            cur = new
        out[r] = pa.array(cur.astype(np.int32), mask=cur == 0)
    yield out


def effects_work(t: pa.Table):
    """States (x, table_id, op, temp, param) against the calls to their fixpoint, each with the best rank of its ways."""
    g = Graph(t, back=True)
    node, rows = g.of(1)
    if not len(node):
        return
    edges, bound = g.of(0)[1], g.of(2)[1]
    fact, one = keyed(rows, ["table_id", "op"])
    (temp, bt, fixed), temps = _encoded(rows["temp"], bound["bound"], pa.array(["parameter", "unknown"], rows["temp"].type))
    (param, bp, bq, none), params = _encoded(rows["param"], bound["param"], bound["bound_param"], pa.array([None], rows["param"].type))
    (site, bs), sites = _encoded(edges["site"], bound["site"])
    rank, carries = edges["rank"].to_numpy(), edges["carries"].to_numpy(zero_copy_only=False)
    moves = np.array([x is None or x == "parameter" for x in temps.to_pylist()])
    lost = np.array([x is None for x in temps.to_pylist()])
    nf, nt, np_, none = len(one), len(temps), len(params), none[0]
    state = lambda n, f, s, p: ((n * nf + f) * nt + s) * np_ + p
    binds = np.argsort(bs * np_ + bp, kind="stable")
    bkey = (bs * np_ + bp)[binds]
    bt, bq = np.where(lost[bt], fixed[1], bt)[binds], bq[binds]
    bq = np.where(bt == fixed[0], bq, none)

    seen = np.unique(state(node, fact, temp, param))
    via, delta = np.full(len(seen), VIA_OWN), seen
    while len(delta):
        n, f, s, p = delta // (nf * nt * np_), delta // (nt * np_) % nf, delta // np_ % nt, delta % np_
        rep, k = spread(g.at, n)
        e, to, f, s, p = g.by[k], g.to[k], f[rep], s[rep], p[rep]
        ways = rank[e]
        new = state(to, f, np.where(moves[s], fixed[1], s), none)
        ask = np.flatnonzero(moves[s] & carries[e] & (p != none))
        if len(ask) and len(bkey):
            want = site[e[ask]] * np_ + p[ask]
            lo, hi = np.searchsorted(bkey, want), np.searchsorted(bkey, want, side="right")
            r = np.repeat(np.arange(len(ask)), hi - lo)
            b = np.arange(len(r)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
            got = ask[r]
            keep = np.ones(len(new), bool)
            keep[ask[hi > lo]] = False
            new, ways = np.concatenate([new[keep], state(to[got], f[got], bt[b], bq[b])]), np.concatenate([ways[keep], ways[got]])
        both = np.sort(new * 8 + ways)
        last = np.ones(len(both), bool)
        last[:-1] = both[1:] // 8 != both[:-1] // 8
        new, ways = both[last] // 8, both[last] % 8
        at = np.searchsorted(seen, new)
        known = at < len(seen)
        known[known] = seen[at[known]] == new[known]
        via[at[known]] = np.maximum(via[at[known]], ways[known])
        delta = new[~known]
        via, seen = np.insert(via, at[~known], ways[~known]), np.insert(seen, at[~known], delta)
    for a in range(0, len(seen), 100_000):
        k, v = seen[a : a + 100_000], via[a : a + 100_000]
        held = rows.take(pa.array(one[k // (nt * np_) % nf]))
        yield {"routine_id": g.name(k // (nf * nt * np_)), "table_id": held["table_id"], "op": held["op"], "temp": temps.take(pa.array(k // np_ % nt)), "param": params.take(pa.array(k % np_)), "rank": pa.array(v)}


#: Rank of a routine's own effect.
VIA_OWN = 4


def paths_work(t: pa.Table, k: int, max_depth: int):
    """The best ``k`` simple paths from each root to each node, a level at a time, the last node's ``k`` each extended."""
    g = Graph(t)
    v, rows = g.of(1)
    if not len(v):
        return
    (label,), names = _encoded(rows["root"])
    seeds: dict[tuple[int, int], set[int]] = {}
    for p, x, n in zip(g.part[v].tolist(), label.tolist(), v.tolist()):
        seeds.setdefault((p, x), set()).add(n)
    pairs = np.unique(g.src * g.n + g.dst)
    at, to = grouped(pairs // g.n, g.n)[0].tolist(), (pairs % g.n).tolist()

    def table(found):
        paths = [f[2] for f in found]
        ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
        flat = np.fromiter((n for p in paths for n in p), np.int64, ends[-1])
        return {
            "root": names.take(pa.array([f[0] for f in found], pa.int64())), "node": g.name(np.array([p[-1] for p in paths], np.int64)), "dist": pa.array([len(p) - 1 for p in paths], pa.int32()),
            "path": pa.ListArray.from_arrays(pa.array(ends), g.name(flat)), "rank": pa.array([f[1] for f in found], pa.int32()),
        }

    found = []
    for (_, root), nodes in seeds.items():
        have, level = dict.fromkeys(nodes, 1), [(n,) for n in nodes]
        found += [(root, 1, p) for p in level]
        for _ in range(max_depth):
            step: dict[int, list] = {}
            for p in level:
                for n in to[at[p[-1]] : at[p[-1] + 1]]:
                    if n not in p:
                        step.setdefault(n, []).append((*p, n))
            level = []
            for n, ps in step.items():
                had = have.get(n, 0)
                kept = sorted(ps)[: k - had] if had < k else []
                if kept:
                    have[n] = had + len(kept)
                    level += kept
                    found += [(root, had + 1 + i, p) for i, p in enumerate(kept)]
            if not level:
                break
        if len(found) >= 50_000:
            yield table(found)
            found = []
    if found:
        yield table(found)
