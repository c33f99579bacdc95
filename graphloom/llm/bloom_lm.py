"""Language-model scores from a log-frequency Bloom filter of word-pair counts.

Words are counted exactly, and so are pairs of neighbours (words, or a text's start or
end) over all training documents, single ones too. The BROADCAST most frequent words are
known to every task. Pairs of two of them go to the filter, which
holds the level of each count, an exact number up to 8 and a quarter of
an octave from there, by one entry for each level up to it; a count is read by
probing levels until one is absent. Its size follows from the counted entries,
ENTRY_BITS for each, so it grows with the corpus. All probes of an entry lie in
one region of the filter; regions are filled where their pairs are, and parts of
some regions, small enough for one task, answer the probes: each slice of texts sends
its distinct pairs, with the texts that hold them, to the parts that know them. The HOT
most frequent pairs stand in a small filter of their own besides, which is broadcast
and answers first, so that no part gets the probes of a pair that every text holds.

Pairs with a word beyond those, a rare one, keep their exact counts: they lie in buckets
by a rare word of theirs (the first, if both are), with the counts of its rare words, and slices
send theirs there. What a pair of two rare words needs of the second is added
where the second lies. No rare word is frequent, so no bucket is.

Scores: absolute discounting, ``P(w|u) = max(0, q(u,w) - D) / c(u) + l(u) P(w)``, with
``D = n1 / (n1 + 2 n2)`` of the pairs and ``P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``. q, the level's
number, is never above the count, and l(u) is what the discounted levels of u leave of 1,
summed over all its pairs; so P(.|u) sums to 1 but for false positives of the filter.

HEAD, if set, makes a smaller model: words beyond that many are one class in pairs, each
with its share ``P(w) / P(class)`` of the class's probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.language_id import fold
from graphloom.llm.textbytes import TOKEN, Hasher, Words, expand, freeing, layout, lowered, map_texts, mix
from graphloom.storage import Stage

ENTRY_BITS, PROBES = 16, 6
#: Words of the model, the others being one class; none: every word is its own.
HEAD: int | None = None
#: Words that every task knows; the pairs of others lie in buckets.
BROADCAST = 1 << 18
_REGION_BITS = 17
#: Regions (16 KB each) of a part of the filter: least, most, and the parts that a filter between has.
PART_REGIONS, MOST_REGIONS, PARTS = 1024, 4096, 64
#: Pairs of the filter that is broadcast, at most.
HOT = 1 << 18
#: Regions that one task fills before it hands them on.
FILLED = 512
#: Bytes of text that are counted together before words and pairs are sent on.
SLICE = 3 << 20
#: Bytes of text for each bucket of pairs, which one task merges.
BUCKET_BYTES = 16 << 20
#: Bytes of text for each bucket of rare words.
TAIL_BYTES = 32 << 20
#: Set in the hash that stands for a rare word.
RARE = np.uint64(1 << 63)
#: Pairs by what is rare: the second (kept by it, beside the first's id), the first (by it, beside the second's id), both (by the first, beside the second).
SECOND, FIRST, BOTH = range(3)
_OTHER = (np.uint32, np.uint32, np.uint64)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, Words, np.ndarray]:
    data, offsets = layout(batch.column("text"))
    data = lowered(data)
    words = Words(data, offsets, TOKEN)
    return data, words, Hasher(data).slices(words.start, words.end)


class Head:
    """The words that every task knows, by hash. A word's id is its place; any other word and a text's ends have the two ids after."""

    def __init__(self, h: np.ndarray, n: np.ndarray, classes: bool = False):
        order = np.argsort(h)
        self.h, self.n, self.classes = h[order], n[order], classes

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, len(self.h))

    def pairs(self, ids: np.ndarray, words: Words) -> np.ndarray:
        """The id before, and the id, of each token and of an end after each text, in one number."""
        end = len(self.h) + 1
        seq = np.insert(ids, words.first[1:], end).astype(np.uint64)
        before = np.concatenate((np.array([end], np.uint64), seq[:-1]))
        return (before << np.uint64(32)) | seq

    def split(self, h: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """All pairs, which of them the filter counts, and (places, rare word, other) of each kind of the rest; with a class, of its words."""
        pair = self.pairs(self.ids(h), words)
        before, own = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        first, second = before == len(self.h), own == len(self.h)
        key = np.insert(h | RARE, words.first[1:], np.uint64(0))
        if self.classes:
            at = np.flatnonzero(second)
            return pair, np.ones(len(pair), bool), [(at, key[at], np.zeros(len(at), np.uint64))]
        last = np.concatenate((np.zeros(1, np.uint64), key[:-1]))
        kinds = (second & ~first, key, before), (first & ~second, last, own), (first & second, last, key)
        return pair, ~(first | second), [(at, k[at], o[at]) for at, k, o in ((np.flatnonzero(f), k, o) for f, k, o in kinds)]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    flat = data[expand(start, size)]
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(flat)).cast(pa.string())


def _counts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.sort(a)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[first], np.diff(np.append(first, len(a)))


def _spread(h: np.ndarray, parts: int) -> np.ndarray:
    """Numbers below ``parts`` in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]) - 1, bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))


def _joint(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One hash of both."""
    return mix(mix(key) + other.astype(np.uint64))


def _by_bucket(key: np.ndarray, buckets: int, *cols: np.ndarray):
    """(bucket, bytes of the keys, bytes of each column) of every bucket that has keys."""
    bucket = _spread(mix(key), buckets)
    order = np.argsort(bucket, kind="stable")
    cols = [c[order] for c in (key, *cols)]
    return [(k, *(c[a:z].tobytes() for c in cols)) for k, a, z in _groups(bucket[order])]


class _CountPairs:
    """Counts of pairs, packed by bucket: kind -1 for those of the filter; the others' buckets come after its."""

    def __init__(self, head, buckets: int, tails: int):
        self.head, self.buckets, self.tails = head, buckets, tails

    def __call__(self, batch: pa.RecordBatch):
        _, words, h = tokens(batch)
        head = self.head.value
        pair, inner, rare = head.split(h, words)
        pair, n = _counts(pair[inner])
        out = [(k, -1, p, None, m) for k, p, m in _by_bucket(pair, self.buckets, n.astype(np.int64))]
        for kind, (_, key, other) in enumerate([] if head.classes else rare):
            joint = _joint(key, other)
            order = np.argsort(joint)
            first = _starts(joint[order])
            n = np.diff(np.append(first, len(order)))
            at = order[first]
            out += [(self.buckets + k, kind, p, o, m) for k, p, o, m in _by_bucket(key[at], self.tails, other[at].astype(_OTHER[kind]), n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "kind", "pair", "other", "n"])


def _merged(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, or (key, other), and the sums of the last column."""
    joint = _joint(key, cols[0]) if len(cols) > 1 else key
    order = np.argsort(joint)
    first = _starts(joint[order])
    at = order[first]
    n = np.add.reduceat(cols[-1][order], first) if len(first) else cols[-1]
    return key[at], *(c[at] for c in cols[:-1]), n


_TAIL = pa.struct([("part", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("other", pa.binary()), ("n", pa.binary())])


def _merge_pairs(buckets: int):
    """Sums of each bucket: (pair, n) of the filter's pairs, others packed with a pair of -1."""

    def rows(bucket, kind, cols):
        for a in range(0, len(cols[0]), 1 << 18):
            some = [c[a : a + (1 << 18)] for c in cols]
            if kind < 0:
                arrays = [pa.array(some[0].view(np.int64)), pa.array(some[1]), pa.nulls(len(some[0]), _TAIL)]
            else:
                tail = {"part": bucket - buckets, "kind": kind, **{k: c.tobytes() for k, c in zip(("key", "other", "n"), some)}}
                arrays = [pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([tail], _TAIL)]
            yield pa.RecordBatch.from_arrays(arrays, ["pair", "n", "tail"])

    def run(batches):
        held: dict[tuple[int, int], tuple[list, int]] = {}
        for b in batches:
            for bucket, kind, key, other, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                got, last = held.get((bucket, kind), ([], 1 << 16))
                cols = [np.frombuffer(key.as_buffer(), np.uint64)]
                if kind >= 0:
                    cols.append(np.frombuffer(other.as_buffer(), _OTHER[kind]))
                got.append((*cols, np.frombuffer(n.as_buffer(), np.int64)))
                if sum(len(x[0]) for x in got) > 2 * last:
                    got = [_merged(*(np.concatenate(x) for x in zip(*got)))]
                    last = max(len(got[0][0]), 1 << 16)
                held[bucket, kind] = (got, last)
        for (bucket, kind), (got, _) in held.items():
            yield from rows(bucket, kind, _merged(*(np.concatenate(x) for x in zip(*got))))

    return run


class _CountWords:
    def __call__(self, batch: pa.RecordBatch):
        data, words, h = tokens(batch)
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([strings(data, words.start[at], words.end[at]), pa.array(u.view(np.int64)), pa.array(n)], ["word", "h", "n"])


#: The number that each level stands for: 1 to 8, then four to an octave.
VALUES = np.array([*range(1, 8), *(m << e for e in range(1, 58) for m in (4, 5, 6, 7))], np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """The highest level whose number is not above the count."""
    return np.searchsorted(VALUES, counts, "right")


class LogCounts:
    """The filter, or some regions of it."""

    def __init__(self, regions: int, first: int = 0, held: int | None = None):
        self.regions, self.first = regions, first
        self.array = np.zeros((regions if held is None else held, 1 << (_REGION_BITS - 3)), np.uint8)

    @staticmethod
    def sized(entries: int) -> int:
        """Regions for so many entries."""
        return max(1, -(-entries * ENTRY_BITS >> _REGION_BITS))

    @staticmethod
    def places(h: np.ndarray, at: int):
        g = mix(h + np.uint64(at * 0x9FB21C651E98DF25 % (1 << 64)))
        mask = np.uint64((1 << _REGION_BITS) - 1)
        a, b = g & mask, ((g >> np.uint64(20)) & mask) | np.uint64(1)
        for k in range(PROBES):
            yield (a + np.uint64(k) * b) & mask

    def add(self, h: np.ndarray, levels: np.ndarray) -> None:
        rows, flags = _flags(h, levels, self.regions)
        self.array[rows - self.first] |= flags

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of distinct hashes: the number of the level each is found at, or 0."""
        out = np.zeros(len(h), np.int64)
        alive, at = np.arange(len(h)), 1
        while len(alive) and at <= len(VALUES):
            own, ok = h[alive], np.arange(len(alive))
            row = _spread(own, self.regions) - self.first
            for bit in self.places(own, at):  # what fails a probe needs no other
                b = bit[ok]
                ok = ok[(self.array[row[ok], (b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            alive = alive[ok]
            out[alive] = at
            at += 1
        return np.where(out > 0, VALUES[out - 1], 0)


def _head_count(words: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach, from a histogram of sixteenths of octaves; no sort of the vocabulary."""
    rows = words.groupBy(F.floor(F.log2("n") * 16).alias("q")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    least, total = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["n"]):
        total += r["k"]
        if total > most:
            break
        least = r["n"]
    return least


def _flags(h: np.ndarray, levels: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """(regions, their bits) with every entry of these hashes up to their levels."""
    rows, row = np.unique(_spread(h, regions), return_inverse=True)
    flag = np.zeros((len(rows) << _REGION_BITS), bool)
    row = row.astype(np.uint64) << np.uint64(_REGION_BITS)
    for at in range(1, int(levels.max(initial=0)) + 1):
        keep = levels >= at
        h, row, levels = h[keep], row[keep], levels[keep]
        for bit in LogCounts.places(h, at):
            flag[row + bit] = True
    return rows, np.packbits(flag, bitorder="little").reshape(len(rows), -1)


class Model:
    """What scoring needs beside the filter: for each id its probability, 1 / c, and the mass that its pairs leave."""

    def __init__(self, head: Head, n_tokens: int, n_words: int, n_docs: int):
        self.head, self.n_docs = head, n_docs
        self.norm = n_tokens + 0.5 * (n_words + (n_docs > 0) + 1)
        rare = n_tokens - n_docs - int(head.n.sum())  # of the class's words
        self.seen = np.concatenate((head.n, [rare, n_docs])).astype(np.float64)
        self.p = (self.seen + 0.5) / self.norm
        self.p[-2] = (rare + 0.5 * (n_words - len(head.n) + 1)) / self.norm
        self.discount, self.left = 0.0, np.ones(len(self.seen))

    def learn(self, pairs: DataFrame) -> int:
        """Takes discount and left mass from ``pairs(pair, n, tail)``; gives the number of the filter's entries."""
        size = len(self.seen)

        def sums(batches):
            level_sum, kinds, few, entries = np.zeros(size), np.zeros(size), [0, 0], 0

            def add(before, n):
                if before is not None:
                    level_sum[:] += np.bincount(before, VALUES[level(n) - 1], size)
                    kinds[:] += np.bincount(before, minlength=size)
                few[0] += int((n == 1).sum())
                few[1] += int((n == 2).sum())

            for b in batches:
                pair, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                inner = pair >= 0
                add(pair[inner] >> 32, n[inner])
                entries += int(level(n[inner]).sum())
                _, kind, _, other, n = b.column(2).filter(pa.array(~inner)).flatten()
                for k, o, m in zip(kind.to_pylist(), other, n):  # those with a rare first word leave its mass where they lie
                    add(np.frombuffer(o.as_buffer(), np.uint32).astype(np.int64) if k == SECOND else None, np.frombuffer(m.as_buffer(), np.int64))
            at = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(level_sum[at], entries)), pa.array(np.append(kinds[at], few[0])), pa.array(np.append(np.zeros(len(at)), few[1]))], ["id", "q", "k", "two"])

        rows = pairs.mapInArrow(freeing(sums), "id long, q double, k double, two double").groupBy("id").agg(F.sum("q").alias("q"), F.sum("k").alias("k"), F.sum("two").alias("two")).toArrow()
        at, q, k, two = (rows.column(c).to_numpy() for c in ("id", "q", "k", "two"))
        total = at < 0
        if not total.any():
            return 0
        one, pair = float(k[total].sum()), float(two[total].sum())
        self.discount = one / (one + 2 * pair) if one else 0.5
        at, q, entries, k = at[~total], q[~total], int(q[total].sum()), k[~total]
        self.left[at] = self.remains(q, k, self.seen[at])
        return entries

    def remains(self, q: np.ndarray, k: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """What k pairs, their levels' numbers q together, leave of a word's probability."""
        return np.clip(1 - (q - self.discount * k) / seen, 0, 1)

    def narrow(self, pair: np.ndarray) -> np.ndarray:
        """Pairs in 40 bits, which the bound on words allows, and back."""
        return (pair >> np.uint64(32)) * np.uint64(len(self.seen)) + (pair & np.uint64(0xFFFFFFFF))

    def widen(self, pair: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.seen))
        return (pair // size << np.uint64(32)) | pair % size

    def parts(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1 / c of the id before, probability without the pair's own) of each pair."""
        before, own = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return 1 / np.maximum(self.seen[before], 1), self.left[before] * self.p[own]

    def logs(self, inverse: np.ndarray, rest: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log10(np.minimum(1.0, self.gain(inverse, count) + rest))

    def gain(self, inverse: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.discount, 0) * (count > 0) * inverse


def fill(pairs: DataFrame, regions: int) -> DataFrame:
    """(region, bits) of every region that holds a pair of ``pairs(pair, n)``; the pairs of a region lie in few tasks."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        some: list[tuple[np.ndarray, np.ndarray]] = []

        def take():
            pair, n = (np.concatenate(x) for x in zip(*some))
            some.clear()
            h = mix(pair.view(np.uint64))
            order = np.argsort(h)
            h, lv = h[order], level(n[order])
            ends = np.flatnonzero(np.diff(_spread(h, regions) // 64)) + 1
            for a, z in zip([0, *ends.tolist()], [*ends.tolist(), len(h)]):  # 64 regions at once
                for r, bits in zip(*_flags(h[a:z], lv[a:z], regions)):
                    held[int(r)] = held[int(r)] | bits if int(r) in held else bits.copy()

        for b in batches:
            some.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(x) for x, _ in some) >= 1 << 20:
                take()
                if len(held) > FILLED:
                    yield from _bits(held)
                    held = {}
        if some:
            take()
        yield from _bits(held)

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, bits in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(bits.as_buffer(), np.uint8)
                held[r] = held[r] | got if r in held else got.copy()
        yield from _bits(held)

    made = pairs.mapInArrow(freeing(run), "region int, bits binary")
    return made.repartition(max(1, -(-regions // PART_REGIONS)), "region").mapInArrow(freeing(join), "region int, bits binary")


def _bits(held: dict[int, np.ndarray]):
    rows = sorted(held.items())
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[a : a + 64]], pa.int32()), pa.array([v.tobytes() for _, v in rows[a : a + 64]], pa.binary())], ["region", "bits"])


def _groups(sorted_keys: np.ndarray):
    first = np.flatnonzero(np.concatenate(([True], np.diff(sorted_keys) != 0))) if len(sorted_keys) else np.zeros(0, np.int64)
    return zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist())


#: What a slice knows of each of its texts; sums from elsewhere are added.
_DOC = np.dtype([("doc_id", "<i8"), ("known", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def _packed(sums: np.ndarray, used: np.ndarray) -> tuple[bytes, bytes]:
    """(texts, their sums) of those texts that have any."""
    some = np.flatnonzero(used)
    return some.astype(np.uint32).tobytes(), sums[some].tobytes()


class _Probe:
    """The distinct pairs of a slice with the texts that hold each, packed by the part of the filter, or the bucket after those, that knows them.

    Texts are numbered by ``base`` and their place. A pair of the filter is 40 bits, in two arrays.
    What needs no part, and what the broadcast filter knows, is in a row of kind 2.
    """

    def __init__(self, model, hot, regions: int, part_regions: int, tails: int):
        self.model, self.hot, self.regions, self.part_regions, self.tails, self.rows = model, hot, regions, part_regions, tails, 0

    def __call__(self, batch: pa.RecordBatch):
        _, words, h = tokens(batch)
        docs, m = len(batch), self.model.value
        base = (TaskContext.get().partitionId() << 40) + self.rows
        self.rows += docs
        every, inner, rare = m.head.split(h, words)
        text_of = np.insert(words.text, words.first[1:], np.arange(docs))
        own = (every & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = own < len(m.head.h)
        doc = np.zeros(docs, _DOC)
        ids = batch.column("doc_id")
        doc["doc_id"], doc["known"] = pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False)
        doc["held_out"] = batch.column("held_out").to_numpy(zero_copy_only=False)
        doc["n_tokens"] = words.count + 1
        doc["n_known"] = np.bincount(text_of[head], minlength=docs) + (m.n_docs > 0)
        doc["base"] = np.bincount(text_of[head], np.log10(m.head.n[own[head]] + 0.5), docs) + math.log10(m.n_docs + 0.5) - doc["n_tokens"] * math.log10(m.norm)
        pair, text = m.narrow(every[inner]), text_of[inner]
        if docs <= 1 << 16:
            key = np.sort((pair << np.uint64(16)) | text.astype(np.uint64))
            pair, text = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.uint16)
        else:
            order = np.lexsort((text, pair))
            pair, text = pair[order], text[order].astype(np.uint32)
        first = _starts(pair)
        n = np.diff(np.append(first, len(pair)))
        wide = m.widen(pair[first])
        hashed = mix(wide)
        least, hot = self.hot.value
        count = hot.counts(hashed)
        known = count >= least
        own = text[expand(first[known], n[known])]
        doc["score"] = np.bincount(own, np.repeat(m.logs(*m.parts(wide[known]), count[known]), n[known]), docs)
        rest = ~known
        own, n, at_pair = pair[first[rest]], n[rest], first[rest]
        part = _spread(hashed[rest], self.regions) // self.part_regions
        order = np.argsort(part, kind="stable")
        own, n, at_pair = own[order], n[order], at_pair[order]
        text = text[expand(at_pair, n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        blob = lambda x, a, z, t: np.ascontiguousarray(x[a:z]).astype(t).tobytes()
        rows = [(p, 1, blob(own & np.uint64(0xFFFFFFFF), a, z, np.uint32), blob(own >> np.uint64(32), a, z, np.uint8), blob(n, a, z, np.uint32), text[ends[a] : ends[z]].tobytes()) for p, a, z in _groups(part[order])]
        parts = -(-self.regions // self.part_regions)
        rows.append((int(mix(np.array([base], np.uint64))[0]) % max(1, parts), 2, doc.tobytes(), None, None, None))
        for kind, (at, key, other) in enumerate(rare):
            joint, text = _joint(key, other), text_of[at]
            order = np.lexsort((text, joint))
            first = _starts(joint[order], text[order])
            n = np.diff(np.append(first, len(order))).astype(np.uint32)
            at = order[first]
            rows += [(parts + p, _ASKED + kind, *cols) for p, *cols in _by_bucket(key[at], self.tails, other[at].astype(_OTHER[kind]), n, text[at].astype(np.uint32))]
        part, kind, *cols = zip(*rows)
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array([base] * k, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)],
            ["part", "kind", "region", "bits", "base", "low", "high", "n", "texts"],
        )


#: Kinds of rows in a bucket of rare words, in this order: their counts, pairs of each kind, what slices ask of each kind.
_RARE, _KEPT, _ASKED = 3, 4, 7


class _Bucket:
    """Rare words with their counts and the mass that their pairs leave, and the counts of pairs."""

    def __init__(self, model):
        self.model, self.words, self.pairs, self.ready = model, [], ([], [], []), False

    def take(self, kind: int, key, other, n) -> None:
        cols = np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)
        if kind == _RARE:
            self.words.append(cols)
        else:
            self.pairs[kind - _KEPT].append((cols[0], np.frombuffer(other.as_buffer(), _OTHER[kind - _KEPT]), cols[1]))

    def settle(self) -> None:
        self.ready = True
        self.key, self.n = _merged(*(np.concatenate(x) for x in zip(*self.words))) if self.words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        q, k, self.found = np.zeros(len(self.key)), np.zeros(len(self.key)), []
        for kind, some in enumerate(self.pairs):
            if not some:
                self.found.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            key, other, n = (np.concatenate(x) for x in zip(*some))
            value = VALUES[level(n) - 1]
            if kind != SECOND:
                at = np.searchsorted(self.key, key)
                q += np.bincount(at, value, len(q))
                k += np.bincount(at, minlength=len(k))
            joint = _joint(key, other)
            order = np.argsort(joint)
            self.found.append((joint[order], value[order]))
        self.left = self.model.remains(q, k, self.n)
        self.words, self.pairs = [], ([], [], [])

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), none, values.dtype)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], none)

    def count(self, key: np.ndarray) -> np.ndarray:
        return self.look(self.key, self.n, key, 0)

    def ask(self, kind: int, key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the word, number of the pair's level or 0, mass that the word's pairs leave)"""
        return self.count(key), self.look(*self.found[kind], _joint(key, other), 0), self.look(self.key, self.left, key, 1.0)


def _sums(text: np.ndarray, *values: np.ndarray) -> tuple[bytes, bytes]:
    """(texts, the sums of each value) of those texts that are there."""
    some, at = np.unique(text, return_inverse=True)
    return some.astype(np.uint32).tobytes(), b"".join(np.bincount(at, v, len(some)).tobytes() for v in values)


def _rare_sums(model, text, m, count, score) -> tuple[bytes, bytes]:
    """Sums for occurrences of rare words by their counts: score, base score, known tokens."""
    return _sums(text, m * score, m * np.log10(count + 0.5), m * (count > 0))


_ANSWER = "part int, base long, texts binary, sums binary, docs binary, low binary, n binary"


def _answer(model, regions: int, part_regions: int, tails: int):
    """A slice's sums of logarithms over the probes of each part; what a part holds comes before its probes.

    Rows with a part ask the bucket of the second of two rare words for the rest.
    """
    filters = -(-regions // part_regions)

    def rare(held, kind, base, cols):
        m = model.value
        key, n, text = (np.frombuffer(cols[i].as_buffer(), t) for i, t in ((0, np.uint64), (2, np.uint32), (3, np.uint32)))
        other = np.frombuffer(cols[1].as_buffer(), _OTHER[kind])
        c, q, left = held.ask(kind, key, other)
        if kind == BOTH:
            gain = m.gain(1 / np.maximum(c, 1), q)
            for p, low, n, text, gain, left in _by_bucket(other, tails, n, text, gain, left):
                yield p, base, text, gain + left, None, low, n
        elif kind == FIRST:
            yield None, base, *_sums(text, n * m.logs(1 / np.maximum(c, 1), left * m.p[other], q)), None, None, None
        elif m.head.classes:  # its part of the class's probability
            yield None, base, *_rare_sums(m, text, n, c, np.log10((c + 0.5) / m.norm / m.p[-2])), None, None, None
        else:
            yield None, base, *_rare_sums(m, text, n, c, m.logs(1 / np.maximum(m.seen[other], 1), m.left[other] * (c + 0.5) / m.norm, q)), None, None, None

    def run(batches):
        part, held = None, None
        for b in batches:
            out: list[tuple] = []
            for p, kind, region, bits, base, *cols in zip(*(b.column(i).to_pylist() if i in (0, 1, 2, 4) else b.column(i) for i in range(9))):
                if kind == 2:
                    out.append((None, base, None, None, cols[0].as_py(), None, None))
                    continue
                if p != part:
                    part, held = p, LogCounts(regions, p * part_regions, part_regions) if p < filters else _Bucket(model.value)
                if kind == 0:
                    held.array[region - held.first] = np.frombuffer(bits.as_buffer(), np.uint8)
                elif kind == 1:
                    low, high, n = (np.frombuffer(c.as_buffer(), t) for c, t in zip(cols, (np.uint32, np.uint8, np.uint32)))
                    total = int(n.sum())
                    text = np.frombuffer(cols[3].as_buffer(), np.uint16 if len(cols[3].as_buffer()) == 2 * total else np.uint32)
                    pair = model.value.widen((high.astype(np.uint64) << np.uint64(32)) | low)
                    s = model.value.logs(*model.value.parts(pair), held.counts(mix(pair)))
                    out.append((None, base, *_packed(np.bincount(text, np.repeat(s, n)), np.bincount(text)), None, None, None))
                elif kind < _ASKED:
                    held.take(kind, *cols[:3])
                else:
                    if not held.ready:
                        held.settle()
                    out += rare(held, kind - _ASKED, base, cols)
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = pa.int32(), pa.int64(), *[pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["part", "base", "texts", "sums", "docs", "low", "n"])


def _complete(model):
    """The sums of pairs of two rare words, where the second one's count is."""

    def run(batches):
        part, held = None, None
        for b in batches:
            out: list[tuple] = []
            for p, kind, base, text, sums, low, n in zip(*(b.column(i).to_pylist() if i < 3 else b.column(i) for i in range(7))):
                if p != part:
                    part, held = p, _Bucket(model.value)
                if kind == _RARE:
                    held.take(kind, low, None, n)
                    continue
                if not held.ready:
                    held.settle()
                text, m, key = (np.frombuffer(c.as_buffer(), t) for c, t in ((text, np.uint32), (n, np.uint32), (low, np.uint64)))
                gain, left = np.frombuffer(sums.as_buffer(), np.float64).reshape(2, -1)
                c = held.count(key)
                out.append((None, base, *_rare_sums(model.value, text, m, c, np.log10(np.minimum(1.0, gain + left * (c + 0.5) / model.value.norm))), None, None, None))
            if out:
                yield _rows(out)

    return run


def _pack_words(tails: int):
    """(part, low, n): rare words and their counts, packed by bucket."""

    def rows(some):
        h, n = (np.concatenate(x) for x in zip(*some))
        part, low, n = zip(*_by_bucket(h.view(np.uint64) | RARE, tails, n))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(low, pa.binary()), pa.array(n, pa.binary())], ["part", "low", "n"])

    def run(batches):
        some = []
        for b in batches:
            if len(b):
                some.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(h) for h, _ in some) >= 1 << 20:
                yield rows(some)
                some = []
        if some:
            yield rows(some)

    return run


def _add_up(batches):
    """Each text's row from its slice's row and the answers to it, which come together."""
    base, doc, got = None, None, []

    def done():
        d = doc.copy()
        for at, value in got:
            if len(at):
                value = value.reshape(-1, len(at))
                d["score"][at] += value[0]
                if len(value) > 1:
                    d["base"][at] += value[1]
                    d["n_known"][at] += value[2].astype(np.int64)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        return pa.RecordBatch.from_arrays([pa.array(d["doc_id"], mask=~d["known"]), *(pa.array(np.ascontiguousarray(d[k])) for k in names[1:])], [*names[:4], "base_score", "score"])

    for b in batches:
        for key, texts, sums, docs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
            if key != base:
                if base is not None:
                    yield done()
                base, doc, got = key, None, []
            if docs.is_valid:
                doc = np.frombuffer(docs.as_buffer(), _DOC)
            else:
                got.append((np.frombuffer(texts.as_buffer(), np.uint32), np.frombuffer(sums.as_buffer(), np.float64)))
    if base is not None:
        yield done()


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``.

    Learns from rows whose crc32(doc_id) modulo 5 is not 1; a null id is held
    out. Null and empty texts have the end token alone. Rows that repeat count,
    and come out, as often as they stand. Very long texts are one row like others; other
    columns play no part. Without training rows N = V = 0.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "bloom-lm")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(True))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    train = text.where(~F.col("held_out")).select("text")
    seen = train.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n_docs, size = seen[0], seen[1] or 0
    words = stage.table("words", map_texts(train, _CountWords(), "word string, h long, n long", SLICE).groupBy("word").agg(F.min("h").alias("h"), F.sum("n").alias("n")))
    sums = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_tokens = (sums[1] or 0) + n_docs
    least = _head_count(words, BROADCAST if HEAD is None else HEAD)
    top = words.where(F.col("n") >= least).select("h", "n").toArrow()
    head = Head(top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), HEAD is not None)
    model = Model(head, n_tokens, sums[0], n_docs)
    sc = spark.sparkContext
    buckets, tails = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // TAIL_BYTES))
    counted = map_texts(train, _CountPairs(sc.broadcast(head), buckets, tails), "bucket long, kind int, pair binary, other binary, n binary", SLICE)
    merged = counted.repartition(buckets + tails, "bucket").mapInArrow(freeing(_merge_pairs(buckets)), "pair long, n long, tail struct<part: int, kind: int, key: binary, other: binary, n: binary>")
    kept = stage.table("pairs", merged)
    pairs = kept.where("pair >= 0").select("pair", "n")
    regions = LogCounts.sized(model.learn(kept))
    shared = sc.broadcast(model)
    least_pair = _head_count(pairs, HOT)
    top = pairs.where(F.col("n") >= least_pair).toArrow()
    hot_h, hot_n = mix(top.column("pair").to_numpy().view(np.uint64)), top.column("n").to_numpy()
    hot = LogCounts(LogCounts.sized(int(level(hot_n).sum())))
    if len(hot_h):
        hot.add(hot_h, level(hot_n))
    # a pair counts as hot if its level is that of the least hot count; one that is only as frequent by its level may be either
    hot = sc.broadcast((int(VALUES[level(np.array([least_pair]))[0] - 1]), hot))
    bits = stage.table("filter", fill(pairs, regions))
    rare = words.where(F.col("n") < least).select("h", "n").mapInArrow(freeing(_pack_words(tails)), "part int, low binary, n binary")
    part_regions = min(MOST_REGIONS, max(PART_REGIONS, regions // PARTS))
    filters = -(-regions // part_regions)
    kinds = "part int, kind int, region int, bits binary, base long, low binary, high binary, n binary, texts binary"
    both = map_texts(text, _Probe(shared, hot, regions, part_regions, tails), kinds, SLICE)
    tail = kept.where("pair < 0").select("tail.*")
    for held in (
        bits.select(F.floor(F.col("region") / part_regions).cast("int").alias("part"), F.lit(0).alias("kind"), "region", "bits"),
        rare.select((F.col("part") + filters).alias("part"), F.lit(_RARE).alias("kind"), "low", "n"),
        tail.select((F.col("part") + filters).alias("part"), (F.col("kind") + _KEPT).alias("kind"), F.col("key").alias("low"), F.col("other").alias("high"), "n"),
    ):
        both = both.unionByName(held, allowMissingColumns=True)
    dealt = both.repartition(4 * (filters + tails), "part").sortWithinPartitions("part", "kind")  # by hash: few parts share a task
    answers = stage.table("answers", dealt.mapInArrow(freeing(_answer(shared, regions, part_regions, tails)), _ANSWER))
    stage.drop("filter", "pairs")
    asked = answers.where("part is not null").select("part", F.lit(_ASKED).alias("kind"), "base", "texts", "sums", "low", "n")
    asked = asked.unionByName(rare.withColumn("kind", F.lit(_RARE)), allowMissingColumns=True)
    rest = asked.repartition(tails, "part").sortWithinPartitions("part", "kind").mapInArrow(freeing(_complete(shared)), _ANSWER)
    every = answers.where("part is null").unionByName(rest).select("base", "texts", "sums", "docs")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = stage.table("scored", every.repartition("base").sortWithinPartitions("base").mapInArrow(freeing(_add_up), schema))
    stage.drop("answers", "words")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
