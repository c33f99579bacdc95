"""Removes every byte of a repeated string of LENGTH bytes, by intervals of a Burrows-Wheeler transform.

Candidates. Each LENGTH-byte window takes the least hash among its GRAM-byte
strings (leftmost of equals) as its anchor; equal windows have equal anchors.
Windows of one anchor follow one another, and the bytes they cover are the
anchor's stretch. Only anchors whose hash stands more than once can repeat.
Equal stretches repeat throughout; they are counted first, so copies cost one
row. What is left are different stretches with one anchor hash (edges of copied
passages); of these, a filter that loses none keeps those that share a string
nearly as long as a window around the anchor with another.

Exact part. Stretches of whole anchor groups are joined to texts of about
TEXT_BYTES. Over such a text's transform, breadth-first backward extension
starts from the empty string's interval and finds the places where the common
prefix of neighbouring suffixes is 0, 1, 2, ... bytes long, each interval being
extended only if it marks a new place, until LENGTH - 1. Places not marked by
then join suffixes with LENGTH equal bytes: windows that share such a run are repeated.

Groups of more than GROUP different stretches are not put into one task: their
windows are hashed and counted one by one, by a group-by that sums first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import Hasher, freeing, layout, map_texts
from graphloom.storage import Stage

LENGTH, GRAM = 400, 32
TEXT_BYTES, GROUP = 1 << 20, 1024
#: Ways to part a window around its anchor, in the filter before the exact part.
SPLITS = 8
#: Bytes of text whose anchors are found at once; longer texts go piece by piece, which parts stretches but no window.
PIECE = 2 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, hash, first window, windows) of each anchor; no window crosses texts."""
    gram = min(gram, length)
    width = length - gram + 1
    h = Hasher(data).grams(gram)
    n = len(h)
    if n < width:
        return (np.zeros(0, np.int64),) * 4
    # least of the width hashes from each place: prefix and suffix minima of blocks
    key = h >> np.uint64(1)
    pad = np.full(-(-n // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:n] = key
    block = pad.reshape(-1, width)
    pre = np.minimum.accumulate(block, 1).reshape(-1)
    suf = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = n - width + 1
    least = np.minimum(suf[:count], pre[width - 1 : width - 1 + count])
    # a window belongs to the next place, from its start, that holds its least hash
    sizes = np.diff(offsets)
    long = sizes >= length
    for_start, for_count = offsets[:-1][long], sizes[long] - length + 1
    mark = np.zeros(count + 1, np.int32)
    np.add.at(mark, for_start, 1)
    np.add.at(mark, np.minimum(for_start + for_count, count), -1)
    inside = np.cumsum(mark[:-1]) > 0
    windows = np.flatnonzero(inside)
    if not len(windows):
        return (np.zeros(0, np.int64),) * 4
    value = least[windows]
    # runs of windows with one least value; within a run the anchor is the next place that holds it
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (np.diff(windows) != 1))))
    run_end = np.append(first[1:], len(windows))
    out_p, out_w, out_n = [], [], []
    start, stop = windows[first], windows[run_end - 1] + 1
    at = _next_equal(key, start, value[first], width)
    todo = np.arange(len(start))
    while len(todo):
        upto = np.minimum(stop[todo], at[todo] + 1)
        out_p.append(at[todo])
        out_w.append(start[todo])
        out_n.append(upto - start[todo])
        start[todo] = upto
        todo = todo[upto < stop[todo]]
        if len(todo):
            at[todo] = _next_equal(key, start[todo], key[at[todo]], width)
    p, w, c = np.concatenate(out_p), np.concatenate(out_w), np.concatenate(out_n)
    order = np.argsort(w, kind="stable")
    p, w, c = p[order], w[order], c[order]
    return p, h[p], w, c


def _next_equal(key: np.ndarray, start: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """First place from each start whose key is the value; it lies within ``width``."""
    order = np.argsort(key, kind="stable") if len(start) > len(key) // 64 else None
    if order is not None:
        ranked = key[order]
        lo, hi = np.searchsorted(ranked, value, "left"), np.searchsorted(ranked, value, "right")
        out = np.empty(len(start), np.int64)
        single = hi - lo == 1
        out[single] = order[lo[single]]
        for i in np.flatnonzero(~single).tolist():
            same = order[lo[i] : hi[i]]
            out[i] = same[np.searchsorted(same, start[i])]
        return out
    out = np.empty(len(start), np.int64)
    for i, (s, v) in enumerate(zip(start.tolist(), value)):
        out[i] = s + int(np.argmax(key[s : s + width] == v))
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    wide = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    reach = 7
    while reach < depth:
        # only suffixes that share their rank are sorted on
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        sa = order[tied]
        nxt = sa + reach
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[sa].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tied] = sa[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[tied] = fresh
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        reach *= 2
    return order


def long_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether each suffix shares ``length`` symbols with the one before it in the order).

    Breadth-first backward extension: level l has the intervals of strings of l
    symbols that marked a new boundary; a boundary marked at level l parts
    suffixes whose common prefix has l - 1 symbols.
    """
    n = len(text)
    order = suffix_order(text, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[(order - 1) % n]  # where the suffix one symbol longer stands
    symbol = text[(order - 1) % n]  # the transform
    marked = np.zeros(n + 1, bool)
    marked[0] = marked[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(lo)), size)
        to = back[at]
        by = np.argsort(to)
        to, owner, sym = to[by], owner[by], symbol[at][by]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (sym[1:] != sym[:-1]))))
        last = np.append(first[1:], len(to)) - 1
        lo, hi = to[first], to[last] + 1
        new = ~marked[hi]
        marked[hi] = True
        lo, hi = lo[new], hi[new]
    return order, ~marked[:n]


def repeated_windows(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch, which of its windows stand at another place of these stretches."""
    sizes = np.array([len(s) for s in stretches])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.zeros(int(sizes.sum()) + len(stretches), np.uint16)
    for s, a in zip(stretches, starts.tolist()):
        text[a : a + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
    order, joined = long_prefixes(text, length)
    same = joined.copy()
    same[:-1] |= joined[1:]
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


def related(stretches: list[bytes], anchor: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether each stretch could share a window with another of its anchor.

    A shared window reaches some bytes left of the anchor and the rest right of
    it. Rounded down to one of SPLITS ways to part them, it is a string around the
    anchor, a little shorter than the window, which both stretches hold. So a
    stretch none of whose strings stands elsewhere has no repeated window.
    """
    gram = min(gram, length)
    width, sizes = length - gram, np.array([len(s) for s in stretches])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    hasher = Hasher(np.frombuffer(b"".join(stretches), np.uint8))
    at = (starts + sizes - length)[:, None] + np.arange(width + 1)[None]  # the anchor is its hash's first place from the last window on
    same = (hasher.grams(gram)[at] >> np.uint64(1)) == (anchor.view(np.uint64) >> np.uint64(1))[:, None]
    place = at[np.arange(len(sizes)), same.argmax(1)]
    step, keep = -(-width // SPLITS), np.zeros(len(sizes), bool)
    for k in range(SPLITS):
        lo, hi = place - min(width, k * step), place + gram + max(0, width - (k + 1) * step)
        ok = np.flatnonzero((lo >= starts) & (hi <= starts + sizes))
        _, inverse, n = np.unique(hasher.slices(lo[ok], hi[ok]) ^ anchor[ok].view(np.uint64), return_inverse=True, return_counts=True)
        keep[ok] |= n[inverse] > 1
    return keep


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


class _Anchors:
    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def __call__(self, batch: pa.RecordBatch):
        data, offsets = layout(batch.column("text"))
        if len(offsets) > 2 or len(data) <= 2 * PIECE:
            got = anchors(data, offsets, self.length, self.gram)
        else:
            parts = []
            for a in range(0, len(data) - self.length + 1, PIECE):
                part = data[a : a + PIECE + self.length - 1]
                p, h, w, c = anchors(part, np.array([0, len(part)]), self.length, self.gram)
                parts.append((p + a, h, w + a, c))
            got = tuple(map(np.concatenate, zip(*parts)))
        place, h, first, count = got
        text = np.searchsorted(offsets, first, "right") - 1
        blob = memoryview(np.ascontiguousarray(data))
        stretch = [xxhash.xxh3_128_digest(blob[a : a + n + self.length - 1]) for a, n in zip(first.tolist(), count.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(stretch, pa.binary()), pa.array((first - offsets[text]).astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "anchor", "stretch", "first", "windows"]
        )


def _cut(length: int):
    """Stretch bytes of each text from the list of its wanted stretches."""

    def run(batches):
        for b in batches:
            texts = b.column(0)
            out: list[list] = [[], [], [], [], []]
            for text, key, wanted in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.as_buffer()
                for w in wanted:
                    a, z = w["first"], w["first"] + w["windows"] + length - 1
                    for col, v in zip(out, (key, w["anchor"], w["first"], w["alone"], bytes(raw[a:z]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["key", "anchor", "first", "alone", "bytes"])

    return run


def _resolve(length: int, gram: int):
    """Repeated runs of windows of stretches that stand alone; rows come sorted by anchor."""

    def run(batches):
        held, left = [], []  # stretches as they come, and those that the filter has left

        def sift():
            keep = related([r[3] for r in held], np.array([r[4] for r in held], np.int64), length, gram)
            left.extend(r for r, k in zip(held, keep.tolist()) if k)
            held.clear()

        def done():
            got = repeated_windows([r[3] for r in left], length)
            rows = [(r[0], r[1] + a, r[1] + z - 1 + length) for r, flag in zip(left, got) if r[2] for a, z in runs(flag)]
            left.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["key", "lo", "hi"])

        last, room = None, 0
        for b in batches:
            for key, anchor, first, alone, blob in zip(*(b.column(i).to_pylist() for i in range(5))):
                if room > TEXT_BYTES and anchor != last:
                    sift()
                    room = 0
                    if sum(len(r[3]) + 1 for r in left) > TEXT_BYTES:
                        yield done()
                held.append((key, first, alone, blob, anchor))
                room, last = room + len(blob) + 1, anchor
        if held:
            sift()
        if left:
            yield done()

    return run


def _each_window(length: int):
    def run(batches):
        for b in batches:
            for key, first, alone, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                view = memoryview(blob)
                n = len(blob) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array(np.arange(first, first + n), pa.int64()), pa.array([alone] * n), pa.array([xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)], pa.binary())], ["key", "lo", "alone", "w"]
                )

    return run


class _Keep:
    """Result rows from texts and the removed spans of each."""

    def __init__(self, length: int, with_text: bool):
        self.length, self.with_text = length, with_text

    def __call__(self, batches):
        for b in batches:
            names = b.schema.names
            out: list[list] = [[] for _ in range(6)]
            for doc, text, spans in zip(b.column(names.index("doc_id")).to_pylist(), b.column(names.index("text")), b.column(names.index("spans")).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                for col, v in zip(out, (doc, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            n = 6 if self.with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:n], kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:n])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs(doc_id, text)``.

    A byte goes if a string of ``length`` bytes that covers it starts at a second
    place in the table. Null and empty texts, and texts under ``length`` bytes,
    keep all. Equal texts (repeated rows, too) are copies of each other: at
    ``length`` bytes or more they lose everything. Cuts may part the bytes of a
    character, so ``kept`` is binary.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "suffix-dedup")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    long = text.where(F.octet_length("text") >= length)
    # one row for each different text; copies of a whole text need no further look
    copies = stage.table("keys", long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")))
    found = stage.table("anchors", map_texts(long.select("key", "text"), _Anchors(length, gram), "key string, anchor long, stretch binary, first int, windows int", PIECE))
    # different stretches of each anchor, with one place of each; map-side sums, so copies meet as one row a task
    place = F.struct("key", "first", "windows")
    kinds = stage.table("stretches", found.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("some_alone")).where("kinds > 1 and some_alone = 1")
    group = kinds.join(groups.select("anchor", "kinds"), "anchor").select("anchor", "kinds", F.col("n").alias("places"), "at.*")
    whole = found.join(kinds.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("key", F.col("first").cast("long").alias("lo"), (F.col("first") + F.col("windows") - 1 + length).cast("long").alias("hi"))
    whole = whole.join(copies.where("n = 1").select("key"), "key")  # whole copies are dropped below without spans
    wanted = group.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "windows", (F.col("places") == 1).alias("alone"))).alias("wanted"))
    wanted = wanted.join(copies.select(F.col("key").alias("of"), "rep"), F.col("key") == F.col("of")).select("of", "rep", "wanted")
    one = long.join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "key", "wanted")
    cut = stage.table("cut", one.mapInArrow(freeing(_cut(length)), "key string, anchor long, first int, alone boolean, bytes binary").distinct())
    large = groups.where(F.col("kinds") > GROUP).select("anchor")
    small = cut.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").select("key", "anchor", "first", "alone", "bytes")
    parts = small.mapInArrow(freeing(_resolve(length, gram)), "key string, lo long, hi long")
    each = cut.join(large, "anchor").select("key", "first", "alone", "bytes").mapInArrow(freeing(_each_window(length)), "key string, lo long, alone boolean, w binary")
    each = stage.table("each", each)
    twice = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    rest = each.where("alone").join(twice, "w").select("key", "lo", (F.col("lo") + length).alias("hi"))
    spans = stage.table("spans", whole.unionByName(parts).unionByName(rest).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    stage.drop("anchors", "stretches", "cut", "each")
    # only texts with spans, none of which is a copy, are shuffled to them; the rest is decided where it is read
    gone = copies.where("n > 1").select(F.col("key").alias("copy_key"))
    marks = spans.unionByName(gone.select(F.col("copy_key").alias("key"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).cast("long").alias("hi"))).alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return text.join(marks, "key", "left").select("doc_id", "text", "spans").mapInArrow(freeing(_Keep(length, with_text)), schema)
