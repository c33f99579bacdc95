"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into runs of GRAM words. One pass over the documents notes
every place where such a run stands and takes the passage around it, as word
hashes. Every run is a seed. A passage is aligned with the item unless so few of
the item's words stand in it that no alignment can reach the threshold; this
bound loses nothing. The alignment is local over words: +1 for an equal word,
-1 for another word, an extra or a missing one, divided by the item's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import Words, freeing, gram_hashes, gram_places, layout, lowered, map_texts
from graphloom.storage import Stage

GRAM, THRESHOLD = 5, 0.5
#: Words of test items that one pass over the documents holds.
ITEM_WORDS = 2_000_000


class Items:
    """Word hashes of the test items and their runs; items without words take no part."""

    def __init__(self, ids: list, texts: list, threshold: float = THRESHOLD):
        self.threshold = threshold
        data, offsets = layout(pa.array([t or "" for t in texts], pa.string()))
        data = lowered(data)
        words = Words(data, offsets)
        h = words.hashes(data)
        self.ids, self.words = [], []
        for i, item in enumerate(ids):
            own = h[words.first[i] : words.first[i + 1]]
            if len(own):
                self.ids.append(item)
                self.words.append(own)
        gram, owner, place = [], [], []
        for i, own in enumerate(self.words):
            g = gram_hashes(own, min(GRAM, len(own)))
            gram.append(g)
            owner.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.gram, self.owner, self.place = cat(gram, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.owner, self.place = self.gram[order], self.owner[order], self.place[order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.lengths = sorted({min(GRAM, int(n)) for n in self.sizes})

    def slack(self, size):
        """No fewer words than an alignment that reaches the threshold can have extra or missing."""
        return np.ceil(size * max(0.0, 1 - self.threshold)).astype(np.int64) + 2

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the gram, entry of the item runs) of every equal pair."""
        table = np.zeros(1 << 20, bool)
        mask = np.uint64((1 << 20) - 1)
        table[(self.gram & mask).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(grams & mask).astype(np.int64)])
        left, right = (np.searchsorted(self.gram, grams[maybe], side) for side in ("left", "right"))
        count = right - left
        which = np.repeat(maybe, count)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        return which, entry


class _Find:
    """Rows (doc_id, item, at, passage): one for each item and stretch of alignments of a document that may reach the threshold."""

    def __init__(self, items):
        self.shared = items

    def __call__(self, batch: pa.RecordBatch):
        self.items = self.shared.value
        data, offsets = layout(batch.column("text"))
        data = lowered(data)
        words = Words(data, offsets)
        h = words.hashes(data)
        it = self.items
        place, entry = [], []
        for n in it.lengths:
            g = gram_hashes(h, n)
            ok = np.zeros(len(g), bool)
            ok[gram_places(words, n)] = True
            which, e = it.hits(g)
            good = ok[which] & (np.minimum(it.sizes[it.owner[e]], GRAM) == n)
            place.append(which[good])
            entry.append(e[good])
        place, entry = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, entry))
        if not len(place):
            return
        text = words.text[place]
        item = it.owner[entry]
        slack = it.slack(it.sizes[item])
        bucket = (place - words.first[text] - it.place[entry]) // slack
        order = np.lexsort((bucket, item, text))
        text, item, bucket, slack = (x[order] for x in (text, item, bucket, slack))
        new = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(bucket) != 0))))
        lo = np.maximum((bucket[new] - 1) * slack[new], 0)
        hi = (bucket[new] + 2) * slack[new] + it.sizes[item[new]]
        first, last = words.first[text[new]], words.first[text[new] + 1]
        places = [(min(f + a, z), min(f + b, z)) for f, a, b, z in zip(first.tolist(), lo.tolist(), hi.tolist(), last.tolist())]
        keep = np.array([self.reaches(i, h[a:z]) for i, (a, z) in zip(item[new].tolist(), places)])
        new, lo = new[keep], lo[keep]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()).take(pa.array(text[new])),
                pa.array(item[new], pa.int32()),
                pa.array(lo, pa.int64()),
                pa.array([h[a:z].tobytes() for (a, z), k in zip(places, keep.tolist()) if k], pa.binary()),
            ],
            ["doc_id", "item", "at", "passage"],
        )

    def reaches(self, item: int, passage: np.ndarray) -> bool:
        """Whether enough of the item's words stand in the passage: a score is at most their share."""
        own = self.items.words[item]
        return int(np.isin(own, passage).sum()) / len(own) >= self.items.threshold


def smith_waterman(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, place in the passage after its end) of each row pair; 0 pads items, 1 passages."""
    rows, size = passages.shape
    h = np.zeros((rows, size + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    j = np.arange(size + 1, dtype=np.int32)[None]
    for i in range(items.shape[1]):
        s = np.where(passages == items[:, i : i + 1], 1, -1)
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + s, h[:, 1:] - 1), 0)
        h = np.maximum.accumulate(new + j, 1) - j  # gaps along the passage
        top = h.argmax(1)
        value = h[np.arange(rows), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best, end


class _Align:
    def __init__(self, items):
        self.shared = items

    def __call__(self, batches):
        it = self.shared.value
        for b in batches:
            keep: list[list] = [[] for _ in range(5)]
            doc, item, at = (b.column(i).to_pylist() for i in range(3))
            order = sorted(range(len(doc)), key=lambda i: it.sizes[item[i]])  # noqa: B023
            for a in range(0, len(order), 512):
                rows = order[a : a + 512]
                wide = max(int(it.sizes[item[r]]) for r in rows)
                texts = [np.frombuffer(b.column(3)[r].as_buffer(), np.uint64) for r in rows]
                x, y = np.zeros((len(rows), wide), np.uint64), np.ones((len(rows), max(map(len, texts))), np.uint64)
                for k, r in enumerate(rows):
                    x[k, : it.sizes[item[r]]] = it.words[item[r]]
                    y[k, : len(texts[k])] = texts[k]
                best, end = smith_waterman(x, y)
                for k, r in enumerate(rows):
                    score = int(best[k]) / int(it.sizes[item[r]])
                    if score >= it.threshold:
                        for col, v in zip(keep, (doc[r], it.ids[item[r]], item[r], at[r] + int(end[k]), score)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(keep, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "item", "end_word", "score"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, end_word, score): documents that hold a test item whole, edited or in large part.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. One row for each
    document id and item with its best alignment (ties: the first); ``end_word`` is
    the word after which it ends. Items without words and null texts take no part; an
    item of under GRAM words is one run, so it must stand whole. Very long texts are read whole. Null ids pass as they
    are, equal items give a row each, rows that repeat give one. Items are held
    ITEM_WORDS words at a time, each share with a pass of its own over the documents.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    sized = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(1, -(-(words // 4) // ITEM_WORDS))
    out = None
    for k in range(shares):
        share = sized.where(F.pmod(F.xxhash64("text"), F.lit(shares)) == k) if shares > 1 else sized
        got = _share(text, share, threshold, Stage(spark, f"decontaminate{k}"))
        out = got if out is None else out.unionByName(got)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "end_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.end_word").alias("end_word"), (-F.col("b.s")).alias("score"))


def _share(docs: DataFrame, benchmark: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    rows = sorted(benchmark.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
    items = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], threshold))  # ITEM_WORDS words at most
    found = stage.table("passages", map_texts(docs, _Find(items), "doc_id long, item int, at long, passage binary"))
    aligned = found.mapInArrow(freeing(_Align(items)), "doc_id long, item_id long, item int, end_word long, score double")
    return aligned.select("doc_id", "item_id", "end_word", "score")
