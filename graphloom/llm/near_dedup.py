"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Features are runs of five words (a shorter text: all its words as one). Weight:
``(1 + ln tf) * (1 + IDF_SHARE * idf)`` with ``idf = ln((N+1)/(df+1)) / ln(N+1)``; df comes
from a count sketch of fixed size over all documents, which can only be too
high. Texts with equal weighted features are one node from the start. Each node
has HASHES consistent weighted samples, in BANDS bands; nodes that share a band
are compared, and a weighted Jaccard similarity of at least ``threshold``
links them. Groups are the connected components of the links.

Comparisons: every node of a band's bucket with the bucket's least node, then,
where a bucket still has several components, every pair from different ones,
if their samples agree often enough for the threshold. These pairs are tried
block by block where the blocks are, and only links come out. So copies of one
text cost their number, not its square, and no bucket is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sketches import PIECES, KeySet, folded, pieces
from graphloom.llm.textbytes import Words, freeing, gram_hashes, gram_places, layout, lowered, map_texts, mix
from graphloom.operators.components import connected_components
from graphloom.storage import Stage

SHINGLE, THRESHOLD, IDF_SHARE = 5, 0.8, 0.5
HASHES, BANDS = 64, 16
#: Counters of each of the sketch's two rows.
SKETCH = 1 << 19
#: Least share of equal samples at which a pair from different components is compared; 0.8 gives less with a chance under 1e-4.
AGREE = 0.58
BLOCK, SALT = 128, 256
_CODES = 4096


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, count), sorted by both."""
    words = Words(data, offsets)
    h = words.hashes(data)
    places = gram_places(words, SHINGLE)
    g = gram_hashes(h, SHINGLE)
    text, gram = [words.text[places]], [g[places]]
    for n in range(1, SHINGLE):
        short = words.first[:-1][words.count == n]
        if len(short):
            gn = gram_hashes(h, n)
            text.append(words.text[short])
            gram.append(mix(gn[short] + np.uint64(n)))
    text, gram = np.concatenate(text), np.concatenate(gram)
    out_t, out_g, out_n = [], [], []
    for a in range(0, len(offsets) - 1, 1 << 16):  # the text's number takes 16 bits of the sort key
        own = (text >= a) & (text < a + (1 << 16)) if len(offsets) > 1 << 16 else slice(None)
        key = np.sort(((text[own] - a).astype(np.uint64) << np.uint64(48)) | (gram[own] >> np.uint64(16)))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        out_t.append((key[first] >> np.uint64(48)).astype(np.int64) + a)
        out_g.append(key[first] & np.uint64((1 << 48) - 1))
        out_n.append(np.diff(np.append(first, len(key))))
    return np.concatenate(out_t), np.concatenate(out_g), np.concatenate(out_n)


def _rows(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gram & np.uint64(SKETCH - 1)).astype(np.int64), ((gram >> np.uint64(24)) & np.uint64(SKETCH - 1)).astype(np.int64) + SKETCH


class _Sketch:
    def __init__(self):
        self.counts, self.docs = None, 0

    def __call__(self, batch: pa.RecordBatch):
        if self.counts is None:
            self.counts = np.zeros(2 * SKETCH, np.int64)
        _, gram, _ = features(*_bytes(batch))
        for row in _rows(gram):
            self.counts += np.bincount(row, minlength=2 * SKETCH)
        return iter(())

    def finish(self):
        if self.counts is not None:
            yield from pieces(self.counts)


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = layout(batch.column("text"))
    return lowered(data), offsets


class Weights:
    """Fixed-point weights (1/1024) of features."""

    def __init__(self, counts: np.ndarray, docs: int):
        top = math.log(docs + 1) or 1.0
        idf = np.clip((top - np.log(np.minimum(counts, docs) + 1)) / top, 0, 1)
        self.level = np.round(idf * 255).astype(np.uint8)  # falls as the count rises: the larger level is the smaller count

    def vector(self, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Shingle in the upper 48 bits, weight in the lower 16."""
        a, b = _rows(gram)
        idf = np.maximum(self.level[a], self.level[b]) / 255.0
        w = np.round((1 + np.log(count)) * (1 + IDF_SHARE * idf) * 1024)
        return (gram << np.uint64(16)) | np.minimum(w, 65535).astype(np.uint64)


_tables: list = []


def samples(vector: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples of each non-empty run of features that begins at ``first``.

    The random variables of a feature are rows of fixed tables, picked by its
    hash. A sample is known by its least value, which only its feature and
    quantised weight can give.
    """
    if not _tables:
        rng = np.random.default_rng(20_14)
        r, c = (rng.gamma(2, 1, (_CODES, HASHES)).astype(np.float32) for _ in range(2))
        _tables.extend([1 / r, r, rng.random((_CODES, HASHES), np.float32), np.log(c)])
    inverse, r, beta, lnc = _tables
    out = np.empty((len(first), HASHES), np.float32)
    ends = np.append(first[1:], len(vector))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + 8192, "right")))
        part = vector[first[at] : ends[to - 1]]
        lnw = np.log((part & np.uint64(0xFFFF)).astype(np.float32) / np.float32(1024))[:, None]
        h = mix(part >> np.uint64(16))
        i, j = (h & np.uint64(_CODES - 1)).astype(np.int64), ((h >> np.uint64(12)) & np.uint64(_CODES - 1)).astype(np.int64)
        rr, bb = r.take(i, 0), beta.take(i, 0)
        t = inverse.take(i, 0)
        t *= lnw
        t += bb
        np.floor(t, out=t)
        t -= bb
        t += 1  # y * e^r = exp(r * (t - beta + 1))
        t *= rr
        value = lnc.take(j, 0)
        value -= t
        out[at:to] = np.minimum.reduceat(value, first[at:to] - first[at], axis=0)
        at = to
    return out.view(np.uint32)


def _vectors(batch: pa.RecordBatch, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with weights, first of each text that has any, that text)."""
    text, gram, count = features(*_bytes(batch))
    first = np.flatnonzero(np.concatenate(([True], np.diff(text) != 0))) if len(text) else np.zeros(0, np.int64)
    return weights.vector(gram, count), first, text[first]


def _nodes(vector: np.ndarray, first: np.ndarray) -> list[str]:
    ends = np.append(first[1:], len(vector)).tolist()
    return [xxhash.xxh3_128_hexdigest(vector[a:z].data) for a, z in zip(first.tolist(), ends)]


class _Sign:
    def __init__(self, weights: Weights):
        self.weights = weights

    def __call__(self, batch: pa.RecordBatch):
        vector, first, text = _vectors(batch, self.weights)
        sig = samples(vector, first)
        node: list = [None] * len(batch)
        sign: list = [None] * len(batch)
        for i, name, s in zip(text.tolist(), _nodes(vector, first), sig):
            node[i], sign[i] = name, s.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(node, pa.string()), pa.array(sign, pa.binary())], ["doc_id", "node", "sig"])


class _Fetch:
    """Features of the documents that the key set holds."""

    def __init__(self, weights: Weights, wanted: KeySet):
        self.weights, self.wanted = weights, wanted

    def __call__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id").cast(pa.int64())
        keep = self.wanted.holds(ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(keep))
        if len(batch):
            vector, first, _ = _vectors(batch, self.weights)
            ends = np.append(first[1:], len(vector)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(vector, first), pa.string()), pa.array([vector[a:z].tobytes() for a, z in zip(first.tolist(), ends)], pa.binary())], ["node", "vector"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser weights over sum of the greater ones."""
    low = np.uint64(0xFFFF)
    total = int((a & low).sum()) + int((b & low).sum())
    _, i, j = np.intersect1d(a >> np.uint64(16), b >> np.uint64(16), True, True)
    both = int(np.minimum(a[i] & low, b[j] & low).sum())
    return both / (total - both)


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            va, vb = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i)] for i in (2, 3))
            ok = [k for k in range(len(va)) if weighted_jaccard(va[k], vb[k]) >= threshold]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(ok, pa.int64())) for i in (0, 1)], ["src", "dst"])

    return run


def _links(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, hub)`` whose similarity meets the threshold. A hub's pairs are dealt over as many tasks as they need."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("n"))
    hubs = vectors.join(salts, vectors["node"] == salts["hub"]).select("hub", "n", F.col("vector").alias("hub_vector"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    members = pairs.join(salts, "hub").join(vectors, pairs["a"] == vectors["node"]).select("a", "hub", "vector", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("salt"))
    both = members.join(hubs.drop("n"), ["hub", "salt"]).select("a", "hub", "vector", "hub_vector")
    return both.mapInArrow(freeing(_verify(threshold)), "src string, dst string")


def _bands(batches):
    width = HASHES // BANDS
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(b), BANDS, width)
        key = np.zeros((len(b), BANDS), np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, :, k] + np.arange(BANDS, dtype=np.uint64)[None])
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b))), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), BANDS)))], ["bucket", "band", "node"])


def _across(threshold: float):
    """Links between different components of two blocks of a bucket.

    A pair is tried in the first band it shares, if its samples agree often
    enough, and as long as nothing in the two blocks has joined its components.
    """

    def run(batches):
        width = HASHES // BANDS
        for b in batches:
            out: list[list] = [[], []]
            for band, one, two in zip(*(b.column(i).to_pylist() for i in range(3))):
                root: dict[str, str] = {}

                def find(c):
                    while root.get(c, c) != c:  # noqa: B023
                        c = root[c]  # noqa: B023
                    return c

                sigs = [np.frombuffer(b"".join(x["sig"] for x in side), np.uint32).reshape(len(side), -1) for side in (one, two)]
                vecs = [[np.frombuffer(x["vector"], np.uint64) for x in side] for side in (one, two)]
                sums = [np.array([int((v & np.uint64(0xFFFF)).sum()) for v in side], float) for side in vecs]
                comp = np.array([x["component"] for x in two])
                for i, x in enumerate(one):
                    same = sigs[1] == sigs[0][i]
                    share = np.minimum(sums[1], sums[0][i]) / np.maximum(sums[1], sums[0][i])
                    good = (same.mean(1) >= threshold * AGREE / 0.8) & (share >= threshold) & (comp != x["component"])
                    good &= same.reshape(len(two), BANDS, width).all(2).argmax(1) == band
                    at = np.flatnonzero(good)
                    for j in at[np.argsort(-same[at].mean(1), kind="stable")].tolist():
                        c, d = find(x["component"]), find(two[j]["component"])
                        if c != d and weighted_jaccard(vecs[0][i], vecs[1][j]) >= threshold:
                            root[c] = d
                            out[0].append(x["node"])
                            out[1].append(two[j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["src", "dst"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copies) of every row of ``docs(doc_id, text)``.

    ``class_id`` is the least doc_id of the group, ``copies`` the group's rows. A
    text without words (null, empty) is its own group, with its own id. Rows that repeat are copies; null ids
    belong to their group like others.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near-dedup")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    weights = Weights(folded(map_texts(text.select("text"), _Sketch(), PIECES), 2 * SKETCH, np.int64), text.count())
    signed = stage.table("signed", map_texts(text, _Sign(weights), "doc_id long, node string, sig binary"))
    nodes = stage.table("nodes", signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")))
    buckets = stage.table("buckets", nodes.select("node", "sig").mapInArrow(freeing(_bands), "bucket long, band int, node string"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = buckets.join(hubs, "bucket")
    pairs = stage.table("pairs", shared.where("node <> hub").select(F.col("node").alias("a"), "hub").distinct())
    wanted = shared.select("node").distinct().join(nodes.select("node", "rep"), "node").select("rep")
    fetched = map_texts(text, _Fetch(weights, KeySet.of(wanted)), "node string, vector binary")
    needed = shared.select("node").distinct()
    vectors = stage.table("vectors", fetched.join(needed, "node", "left_semi").dropDuplicates(["node"]))
    links = stage.table("links", _links(pairs, vectors, threshold))
    joined = stage.table("components", connected_components(links, stage, "cc1"))
    # buckets that still hold several components
    placed = shared.select("bucket", "band", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("bucket", "blocks")
    member = placed.join(open_, "bucket").join(nodes.select("node", "sig"), "node").join(vectors, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = stage.table("blocks", member.groupBy("bucket", "blocks", "block").agg(F.first("band").alias("band"), F.collect_list(F.struct("node", "component", "sig", "vector")).alias("xs")))
    left = block.select("bucket", "band", F.col("xs").alias("one"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = block.select("bucket", F.col("block").alias("j"), F.col("xs").alias("two"))
    more = stage.table("more", left.join(right, ["bucket", "j"]).select("band", "one", "two").mapInArrow(freeing(_across(threshold)), "src string, dst string"))
    stage.drop("buckets", "blocks", "vectors")
    if not more.isEmpty():
        joined = stage.table("all-components", connected_components(links.union(more), stage, "cc2"))
    classes = nodes.select("node", "rep", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("copies"))
    found = stage.table("classes", classes.select("node", "component").join(least, "component").select("node", "class_id", "copies"))
    return signed.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
