"""Secrets: exact base patterns, and a character convolutional network over every other candidate.

A candidate is a maximal run of at least MIN_RUN characters of ``[A-Za-z0-9+/_.=-]``
that is no plain word: it holds a digit, a capital after its first character, a
symbol inside, or stands after an assignment sign. Its value begins after its
first ``=``, if MIN_RUN characters follow. The network sees windows of CONTEXT
characters, one for each VALUE - LEFT characters of the value, so all of it and
what stands around it; the highest score counts. Outside the value it sees letters and
digits by class only, so it can't learn the base patterns' key names and judges
a value by itself and the punctuation around it. Its labelled findings are the
base patterns' matches (secrets) and the other candidates (not): every distinct
window of the corpus, both sorts with the same total weight. They are dealt by
hash into shards of about SAMPLE windows. The first shard's network is where all
shards start; they train side by side and are averaged, ROUNDS times. One window
in four is kept for calibration, all of these by a count for each BIN of their
scores: Platt scaling, then the highest bin's threshold whose recall of the kept
secrets is at least RECALL. A candidate at or above it that overlaps no base span
is added as kind ``model``. Which windows meet does not depend on how the table is split.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.convnet import ConvNet
from graphloom.llm.textbytes import freeing, layout, lowered, map_texts
from graphloom.storage import Stage

MIN_RUN, LEFT, CONTEXT, RECALL = 8, 24, 72, 0.98
#: Labelled windows of a shard; every window lies in one.
SAMPLE, ROUNDS = 6000, 2
#: Width of a bin of scores.
BIN = 1 / 1024
VALUE = CONTEXT - LEFT
KINDS = ("assign", "access", "hex", "model")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_RUN = np.zeros(256, bool)
_RUN[0x30:0x3A] = _RUN[0x41:0x5B] = _RUN[0x61:0x7B] = True
for _c in b"+/_.=-":
    _RUN[_c] = True
_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True
_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = _DIGIT[0x30:0x3A] = True
_SYMBOL = _RUN.copy()
_SYMBOL[0x30:0x3A] = _SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = False
_SIGN[[0x3A, 0x3D]] = True  # : and =
#: Class of each byte: a letter, a capital, a digit, or the byte itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 0x61
_CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0x41, 0x30


def _finds(blob: bytes, word: bytes) -> list[int]:
    out, at = [], blob.find(word)
    while at >= 0:
        out.append(at)
        at = blob.find(word, at + 1)
    return out


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


class Batch:
    """Base spans and candidates of a batch, as places in its bytes with one separator after each text."""

    def __init__(self, col: pa.Array):
        raw, offsets = layout(col)
        n = len(offsets) - 1
        self.data = np.full(len(raw) + n, 0xFF, np.uint8)  # 0xFF is never in UTF-8
        self.data[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = raw
        self.starts = offsets[:-1] + np.arange(n)
        blob = self.data.tobytes()
        low = lowered(self.data).tobytes()
        self.base: list[tuple[int, int, int]] = []  # kind, start, end
        end = 0
        for at in sorted({p for k in _KEYS for p in _finds(low, k)}):
            m = _ASSIGN.match(blob, at) if at >= end else None
            if m:
                end = m.end()
                if m.end(1) - m.start(1) >= 8:
                    self.base.append((0, at, end))
        end = 0
        for at in _finds(blob, b"AKIA"):
            m = _ACCESS.match(blob, at) if at >= end else None
            if m:
                end = m.end()
                if end - at >= 16:
                    self.base.append((1, at, end))
        a, z = _runs(_HEX[self.data])
        long = z - a >= 32
        self.base += [(2, s, e) for s, e in zip(a[long].tolist(), z[long].tolist())]
        a, z = _runs(_RUN[self.data])
        long = z - a >= MIN_RUN
        a, z = a[long], z[long]

        def holds(table, lo, hi):
            n = np.concatenate(([0], np.cumsum(table[self.data])))
            return n[np.maximum(lo, hi)] > n[lo]

        # before the value at most a quote and a space stand after the sign; the text's first bytes look no further back
        good = holds(_DIGIT, a, z) | holds(_UPPER, a + 1, z) | holds(_SYMBOL, a + 1, z - 1) | holds(_SIGN, np.maximum(a - 3, 0), a)
        self.run_start, self.run_end = a[good], z[good]
        signs = np.append(np.flatnonzero(self.data == 0x3D), len(self.data) + MIN_RUN)
        after = signs[np.searchsorted(signs, self.run_start)] + 1
        self.value = np.where(self.run_end - after >= MIN_RUN, after, self.run_start)
        covered = np.zeros(len(self.data) + 1, np.int32)
        for _, s, e in self.base:
            covered[s] += 1
            covered[e] -= 1
        self.inside = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
        self.known = self.inside[self.run_end] > self.inside[self.run_start]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, first place of the value's part) of every window of these candidates."""
        step = VALUE - LEFT
        count = 1 + np.maximum(0, -(-(self.run_end[which] - self.value[which] - VALUE) // step))
        owner = np.repeat(which, count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.value[owner] + nth * step

    def contexts(self, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
        """CONTEXT bytes around each window's place; what lies in other texts is zero, what lies outside the value has classes."""
        text = np.searchsorted(self.starts, start, "right") - 1
        lo = self.starts[text]
        hi = np.append(self.starts[1:], len(self.data))[text] - 1
        at = start[:, None] - LEFT + np.arange(CONTEXT)[None]
        ok = (at >= lo[:, None]) & (at < hi[:, None])
        own = (at >= self.value[owner, None]) & (at < self.run_end[owner, None])
        seen = self.data[np.clip(at, 0, max(0, len(self.data) - 1))]
        return np.where(ok, np.where(own, seen, _CLASS[seen]), 0).astype(np.uint8)


def _findings(batch: pa.RecordBatch):
    """Windows with whether they show a base span; those of a run with one that show none of it are left out."""
    b = Batch(batch.column("text"))
    owner, start = b.windows(np.arange(len(b.run_start)))
    shown_ = b.inside[np.minimum(start + VALUE, b.run_end[owner])] > b.inside[start]
    use = shown_ | ~b.known[owner]
    owner, start, shown_ = owner[use], start[use], shown_[use]
    x = []
    for a in range(0, len(owner), 4096):
        x += [r.tobytes() for r in b.contexts(owner[a : a + 4096], start[a : a + 4096])]
    yield pa.RecordBatch.from_arrays([pa.array(shown_.astype(np.int32)), pa.array(x, pa.binary())], ["known", "x"])


class Model:
    def __init__(self, net: ConvNet, scale: float, shift: float, threshold: float):
        self.net, self.scale, self.shift, self.threshold = net, scale, shift, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.net.logits(x).astype(np.float64)
        return self.probability(z[:, 1] - z[:, 0])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, steps: int = 500) -> tuple[float, float]:
    """Scale and shift of a logistic fit to one-dimensional scores, each of which stands ``n`` times."""
    n = np.ones(len(z)) if n is None else n
    a, b = 1.0, 0.0
    ones, zeros = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = float(np.abs(z).max()) or 1.0
    u = z / spread
    a *= spread
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w, d = n * (p * (1 - p) + 1e-6), n * (p - target)
        g = np.array([(d * u).sum(), d.sum()])
        h = np.array([[(w * u * u).sum() + 1e-3, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return a / spread, b


def _fit_shards(rows: DataFrame, net: ConvNet, weight: np.ndarray, shards: int, epochs: int, rate: float) -> ConvNet:
    """The mean of the networks that each shard of ``rows(shard, known, x)`` makes of ``net``."""

    def run(batches):
        x, y, last = [], [], None

        def done():
            own = net.like(net.flat()).fit(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), CONTEXT), np.array(y), max(epochs, 300 * 64 // len(x)) if shards == 1 else epochs, rate=rate, weight=weight)
            row = [pa.array([last], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([own.flat().astype(np.float64).tobytes()], pa.binary())]
            x.clear()
            y.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "n", "flat"])

        for b in batches:
            for shard, known, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                if x and shard != last:
                    yield done()
                last = shard
                x.append(blob)
                y.append(known)
        if x:
            yield done()

    dealt = rows.select("shard", "known", "x").repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("x"), "x", "known")
    return net.averaged(sorted(dealt.mapInArrow(freeing(run), "shard long, n long, flat binary").collect(), key=lambda r: r["shard"]))


def _binned(net: ConvNet):
    """(known, bin of the score) of each window."""

    def run(batches):
        for b in batches:
            if len(b):
                z = net.logits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), CONTEXT)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor((z[:, 1] - z[:, 0]) / BIN).astype(np.int64))], ["known", "bin"])

    return run


def train(docs: DataFrame, recall: float = RECALL) -> Model | None:
    """A model from every labelled finding of ``docs(text)``; None unless both secrets and other candidates are found."""
    stage = Stage(docs.sparkSession, "secrets")
    h = F.xxhash64("x")
    found = stage.table("findings", map_texts(docs, _findings, "known int, x binary").distinct())
    found = found.withColumn("kept", F.pmod(F.shiftright(h, 20), F.lit(4)) == 3)
    sizes = {(r["known"], r["kept"]): r["n"] for r in found.groupBy("known", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({k for k, _ in sizes}) < 2:
        stage.drop("findings")
        return None
    fit, kept = found.where(~F.col("kept")), found.where("kept")
    n = np.array([sizes.get((k, False), 0) for k in (0, 1)], np.float64)
    if len(sizes) < 4:
        fit = kept = found  # too few to part them
        n = np.array([sizes.get((k, False), 0) + sizes.get((k, True), 0) for k in (0, 1)], np.float64)
    weight = (n.sum() / (2 * n)).astype(np.float32)
    shards = max(1, -(-int(n.sum()) // SAMPLE))
    rows = fit.withColumn("shard", F.pmod(h, F.lit(shards)))
    net = ConvNet(2, (3, 5), 12, 8)
    net = _fit_shards(rows.where("shard = 0") if shards > 1 else rows, net, weight, 1, 3, 0.004)
    for _ in range(ROUNDS if shards > 1 else 0):
        net = _fit_shards(rows, net, weight, shards, 1, 0.001)
    bins = kept.select("known", "x").mapInArrow(freeing(_binned(net)), "known int, bin long").groupBy("known", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    stage.drop("findings")
    bins.sort(key=lambda r: (r["bin"], r["known"]))
    z, y, n = np.array([r["bin"] * BIN for r in bins]), np.array([r["known"] for r in bins]), np.array([r["n"] for r in bins])
    model = Model(net, *platt(z + BIN / 2, y, n), 1.0)
    p, n = model.probability(z if model.scale >= 0 else z + BIN)[y == 1], n[y == 1]  # the least of each bin
    order = np.argsort(p, kind="stable")
    up = np.cumsum(n[order])
    model.threshold = float(p[order][np.searchsorted(up, int((1 - recall) * up[-1]), "right")])
    return model


def spans(batch: pa.RecordBatch, model: Model | None) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind, end), in code points, sorted."""
    b = Batch(batch.column("text"))
    found = list(b.base)
    if model is not None:
        rest = np.flatnonzero(~b.known)
        if len(rest):
            owner, start = b.windows(rest)
            score = np.concatenate([model.score(b.contexts(owner[a : a + 4096], start[a : a + 4096])) for a in range(0, len(owner), 4096)])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            hit = rest[np.maximum.reduceat(score, first) >= model.threshold]
            found += [(3, int(s), int(e)) for s, e in zip(b.run_start[hit], b.run_end[hit])]
    out: list[list] = [[] for _ in range(len(b.starts))]
    if found:
        chars = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))
        for kind, s, e in found:
            d = int(np.searchsorted(b.starts, s, "right")) - 1
            base = chars[b.starts[d]]
            out[d].append((int(chars[s] - base), kind, int(chars[e] - base)))
    return [sorted(x) for x in out]


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


class _Scan:
    def __init__(self, model: Model | None):
        self.model = model

    def __call__(self, batch: pa.RecordBatch):
        found = spans(batch, self.model)
        base = [[x for x in f if x[1] < 3] for f in found]
        cols = [batch.column("doc_id").cast(pa.int64())]
        cols += [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)]
        cols += [pa.array([hashlib.sha256(shown(f).encode()).hexdigest() for f in base], pa.string()), pa.array([shown(f) for f in found], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, model: Model | None = None, learn: bool = True) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs(doc_id, text)``.

    Null and empty texts have no span. Offsets count code points, ends are
    exclusive. A corpus without labelled findings of both sorts gives base spans
    alone. Repeated rows are judged alike.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if model is None and learn:
        model = train(text)
    return map_texts(text, _Scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


class Redact:
    """Batch function that overwrites every span with ``mask``; other columns pass, ``n_chars`` follows where it stands."""

    def __init__(self, model: Model | None, mask: str = "[secret]"):
        self.model, self.mask = model, mask

    def __call__(self, batch: pa.RecordBatch):
        at = batch.schema.get_field_index("text")
        found = spans(batch, self.model)
        hit = [i for i, f in enumerate(found) if f]
        if hit:
            texts = batch.column(at).to_pylist()
            for i in hit:
                out, place = [], 0
                for s, _, e in found[i]:
                    if s >= place:
                        out += [texts[i][place:s], self.mask]
                    place = max(place, e)
                texts[i] = "".join(out) + texts[i][place:]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0 and pa.types.is_integer(batch.schema.field(n).type):
                sizes = batch.column(n).to_pylist()
                for i in hit:
                    sizes[i] = len(texts[i])
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
        yield batch
