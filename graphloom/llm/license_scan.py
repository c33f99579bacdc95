"""License notices: base phrases, and an exact set-similarity join of text blocks with notice templates.

A template's blocks are all runs of as many words as it has, and a quarter more
(two at least), that stand anywhere in a text, across its lines. Words are
ordered by their count over all documents, rarest first. A template of n
distinct words is met by a block that holds at least ``need = ceil(threshold * n)``
of them. Such a block holds one of the template's prefix, its ``n - need + 1``
rarest words; so only the stretch of blocks around a prefix word is looked at.
The word at place i of the prefix counts as the block's first in that order, so
the stretch must hold ``need`` of the template's n - i words from there on
(positional filter) or an earlier prefix word proposes it; a stretch of under
``need`` words is passed over (length filter). What passes is counted block by
block. All of it is exact: no block that meets the threshold is missed. Of
overlapping blocks of templates, one whose words all stand in the other's (CC BY in
CC BY-NC) does not count.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import WORD, Hasher, Words, layout, lowered, map_texts

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice templates by label. Letters are lower case.
TEMPLATES = {
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"],
    "lgpl": ["licensed under the gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "all-rights-reserved": ["copyright all rights reserved"],
}
THRESHOLD = 0.95
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_SEP = 0xFF  # never in UTF-8


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, tuple[bytes, ...]]]:
    """(label, words in their order) of each template that has any."""
    return [(label, tuple(w.encode() for w in text.split())) for label, texts in sorted(templates.items()) for text in texts if text.split()]


class Index:
    """Templates in global frequency order, their prefixes inverted; words are numbered by ``vocabulary``."""

    def __init__(self, templates: list[tuple[str, tuple[bytes, ...]]], counts: dict[bytes, int], threshold: float):
        self.vocabulary = sorted({w for _, words in templates for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.labels = [label for label, _ in templates]
        self.words = [sorted({number[w] for w in words}, key=lambda i: (counts.get(self.vocabulary[i], 0), i)) for _, words in templates]
        self.sets = [frozenset(w) for w in self.words]
        self.need = [max(1, math.ceil(threshold * len(w) - 1e-9)) for w in self.words]
        self.length = [len(words) + max(2, len(words) // 4) for _, words in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.words):
            for i, w in enumerate(own[: len(own) - self.need[t] + 1]):
                self.prefix.setdefault(w, []).append((t, i))

    def blocks(self, t: int, place: np.ndarray, lo: int, hi: int, last: int) -> list[tuple[int, int]]:
        """(start, distinct words of template t) of each block that starts at ``lo`` up to ``hi`` and holds enough; blocks end with the text at ``last``."""
        own, size, held, out = self.sets[t], self.length[t], {}, []
        end = lo
        for start in range(lo, hi):
            while end < min(start + size, last):
                w = int(place[end])
                if w in own:
                    held[w] = held.get(w, 0) + 1
                end += 1
            if len(held) >= self.need[t]:
                out.append((start, len(held)))
            w = int(place[start])
            if w in held:
                held[w] -= 1
                if not held[w]:
                    del held[w]
        return out

    def met(self, place: np.ndarray, first: int, last: int) -> dict[int, float]:
        """Containment of each template that has a block among words ``first`` to ``last`` of one text, but of those within another."""
        reach: dict[int, list[list[int]]] = {}  # for each template the stretches of starts
        for at in (np.flatnonzero(np.isin(place[first:last], list(self.prefix))) + first).tolist():
            for t, i in self.prefix[int(place[at])]:
                lo, hi = max(first, at - self.length[t] + 1), min(last, at + self.length[t])
                if hi - lo < self.need[t]:
                    continue
                near = set(place[lo:hi].tolist())
                if sum(w in near for w in self.words[t][i:]) >= self.need[t] or any(w in near for w in self.words[t][:i]):
                    own = reach.setdefault(t, [])
                    if own and lo <= own[-1][1]:
                        own[-1][1] = at + 1
                    else:
                        own.append([lo, at + 1])
        found = {t: [x for lo, hi in own for x in self.blocks(t, place, lo, hi, last)] for t, own in reach.items()}
        starts = {t: np.array([s for s, _ in x]) for t, x in found.items() if x}
        out = {}
        for t, s in starts.items():
            free = np.ones(len(s), bool)
            for u, v in starts.items():
                if self.sets[t] < self.sets[u]:
                    # the u-block that starts next before the end of a t-block is the one to overlap it
                    k = np.searchsorted(v, s + self.length[t])
                    free &= (k == 0) | (v[np.maximum(k, 1) - 1] + self.length[u] <= s)
            if free.any():
                out[t] = max(n for (_, n), ok in zip(found[t], free.tolist()) if ok) / len(self.words[t])
        return out


class _Count:
    """Occurrences of the templates' words over all texts."""

    def __init__(self, vocabulary: list[bytes]):
        self.words, self.total = vocabulary, Counter()

    def __call__(self, batch):
        data, offsets = layout(batch.column("text"))
        data = lowered(data)
        words = Words(data, offsets)
        index = _lookup(data, words, self.words)
        for w, n in zip(self.words, np.bincount(index[index >= 0], minlength=len(self.words)).tolist()):
            self.total[w] += n
        return iter(())

    def finish(self):
        rows = [(k, v) for k, v in self.total.items() if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[0].decode() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])


def _lookup(data: np.ndarray, words: Words, vocabulary: list[bytes]) -> np.ndarray:
    """Place of each word in the vocabulary, or -1: found by hash, then compared byte by byte."""
    out = np.full(len(words.start), -1, np.int64)
    if not vocabulary or not len(out):
        return out
    ends = np.cumsum([len(w) for w in vocabulary])
    key = Hasher(np.frombuffer(b"".join(vocabulary), np.uint8)).slices(ends - [len(w) for w in vocabulary], ends)
    order = np.argsort(key)
    key = key[order]
    if (key[1:] == key[:-1]).any():
        raise ValueError("two words of the templates have one hash")
    h = words.hashes(data)
    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
    maybe = np.flatnonzero(key[at] == h)
    which = order[at[maybe]]
    size = words.end[maybe] - words.start[maybe]
    good = size == np.array([len(w) for w in vocabulary])[which]
    maybe, which, size = maybe[good], which[good], size[good]
    table = np.zeros((len(vocabulary), max(map(len, vocabulary))), np.uint8)
    for i, w in enumerate(vocabulary):
        table[i, : len(w)] = np.frombuffer(w, np.uint8)
    same = np.ones(len(maybe), bool)
    for k in range(int(size.max(initial=0))):
        has = size > k
        same[has] &= data[words.start[maybe[has]] + k] == table[which[has], k]
    out[maybe[same]] = which[same]
    return out


class _Scan:
    def __init__(self, index_args, phrases: dict[str, str]):
        self.args, self.phrases, self.index = index_args, phrases, None

    def __call__(self, batch):
        if self.index is None:
            self.index = Index(*self.args)
            self.patterns = [(re.compile(_GAP.join(re.escape(w).encode() for w in p.split())), label) for p, label in self.phrases.items()]
        raw, offsets = layout(batch.column("text"))
        n = len(offsets) - 1
        data = lowered(raw)
        words = Words(data, offsets)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        base: list[set] = [set() for _ in range(n)]
        # texts parted by a byte that no text holds, so that no phrase crosses
        apart = np.full(len(data) + n, _SEP, np.uint8)
        apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        blob = apart.tobytes()
        for pattern, label in self.patterns:
            for m in pattern.finditer(blob):
                a, z = m.span()
                if (a and blob[a - 1] != _SEP and WORD[blob[a - 1]]) or (z < len(blob) and blob[z] != _SEP and WORD[blob[z]]):
                    continue
                doc = int(np.searchsorted(offsets + np.arange(n + 1), a, "right")) - 1
                w = int(np.searchsorted(words.start, a - doc)) - int(words.first[doc])
                n_base[doc] += 1
                first[doc] = w if first[doc] < 0 else min(first[doc], w)
                last[doc] = max(last[doc], w)
                base[doc].add(label)
        labels, score = self.similar(data, words, n)
        for d in range(n):
            if base[d]:
                score[d] = 1.0
                labels[d] |= base[d]
        join = lambda s: ",".join(sorted(s))
        none = first < 0
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(words.count, pa.int64()),
                pa.array(n_base),
                pa.array(first, pa.int64(), mask=none),
                pa.array(last, pa.int64(), mask=none),
                pa.array([join(s) for s in base], pa.string()),
                pa.array([join(s) for s in labels], pa.string()),
                pa.array(score, pa.float64()),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    def similar(self, data, words, n):
        labels, score = [set() for _ in range(n)], np.zeros(n)
        place = _lookup(data, words, self.index.vocabulary)
        hits = np.flatnonzero(np.isin(place, list(self.index.prefix)))
        for doc in np.unique(words.text[hits]).tolist():
            for t, share in self.index.met(place, int(words.first[doc]), int(words.first[doc + 1])).items():
                labels[doc].add(self.index.labels[t])
                score[doc] = max(score[doc], share)
        return labels, score


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs(doc_id, text)``.

    Null and empty texts have no words, no labels and score 0; very long ones are
    read whole. ``score`` is the highest containment among the labels, 1 with a
    base label. Rows that repeat stay, other columns play no part. What reaches the driver is bounded by the templates' words.
    """
    sets = template_words(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = map_texts(text.select("text"), _Count(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(text, _Scan((sets, counts, threshold), PHRASES if phrases is None else phrases), schema)
