"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

A batch's texts lie end to end in one buffer; words, their hashes and n-gram
hashes are computed with numpy over that buffer, never text by text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one call of a batch function gets, at least one row.
SLICE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Bytes that words are made of: digits, letters, and all of any non-ASCII character.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Bytes of whitespace-separated tokens.
TOKEN = np.ones(256, bool)
TOKEN[0x20] = TOKEN[9:14] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


#: Called at the end of each task for what modules keep between batches.
AT_TASK_END: list[Callable[[], None]] = []


def release() -> None:
    """Hands memory back that a reused worker would hold on to: kept tables, and what Arrow and malloc have free."""
    for forget in AT_TASK_END:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def freeing(fn: Callable) -> Callable:
    """A function for ``mapInArrow`` that releases memory at the end of its task."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` whose function gets batches of about ``slice_bytes`` of column ``text``.

    ``fn`` may have a ``finish`` attribute, called at the end of each task for
    what it still holds; ``fn`` is pickled anew for each task.
    """

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            if not len(col):
                continue
            sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(col):
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + slice_bytes, "right")))
                yield from fn(batch.slice(at, to - at))
                at = to
        if hasattr(fn, "finish"):
            yield from fn.finish()

    return df.mapInArrow(freeing(run), schema)


def layout(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _forget() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


AT_TASK_END.append(_forget)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of any slices of one buffer, equal for equal slices."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, self.inverse = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(48)))

    def grams(self, q: int) -> np.ndarray:
        """Of the q bytes from each place."""
        n = max(0, len(self.sums) - q)
        return mix((self.sums[q : q + n] - self.sums[:n]) * self.inverse[:n])


class Words:
    """Words of a batch: starts, ends, the text that holds each, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD):
        flag = table[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], flag)) if len(flag) else np.zeros(1, bool)
        now = np.concatenate((flag, [False])) if len(flag) else np.zeros(1, bool)
        self.start = np.flatnonzero(now & (~before | edge))
        self.end = np.flatnonzero(before & (~now | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Hasher(data).slices(self.start, self.end)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by the place of its first word."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out + hashes[k : k + size]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(31)
    return mix(out)


def gram_places(words: Words, n: int) -> np.ndarray:
    """First words of the n-word runs that stay within one text."""
    left = np.repeat(words.first[1:], words.count) - np.arange(len(words.text))
    return np.flatnonzero(left >= n)


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text has a character of a Unicode letter category."""
    got = pc.fill_null(pc.match_substring_regex(col, r"\pL"), False)
    return got.to_numpy(zero_copy_only=False)


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + count[i] - 1, end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.arange(total) - np.repeat(shift, count) + np.repeat(start, count)
