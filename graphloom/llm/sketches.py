"""Arrays of a fixed size gathered from all tasks: count sketches and bit sets.

Each task folds its rows into one array and hands it on in CHUNK-sized pieces;
pieces of one chunk meet in one task, which folds them as they stream by. What
the driver collects, and broadcasts, is one array of the stated size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.textbytes import freeing, mix

CHUNK = 1 << 14  # entries
PIECES = "chunk int, piece binary"


def pieces(array: np.ndarray):
    """The chunks of an array that hold anything, packed."""
    rows = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(array.reshape(-1, min(CHUNK, array.size))) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "piece"])


def folded(df: DataFrame, size: int, dtype, fold: Callable = np.add) -> np.ndarray:
    """The one array of ``size`` entries that the pieces of ``df`` give."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype)
                held[k] = fold(held[k], part) if k in held else part
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for _, v in rows], pa.binary())], ["chunk", "piece"])

    out = np.zeros(size, dtype)
    chunk = min(CHUNK, size)
    parts = max(1, min(64, size // chunk))
    for r in df.repartition(parts, "chunk").mapInArrow(freeing(run), PIECES).toLocalIterator():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(r["piece"])), dtype)
    return out


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


class KeySet:
    """Bloom filter of 64-bit keys with a fixed number of bits; a full one holds every key, so it never loses any."""

    def __init__(self, bits: int, probes: int = 3):
        self.bits, self.probes, self.array = bits, probes, np.zeros(bits // 8, np.uint8)

    @classmethod
    def of(cls, keys: DataFrame, bits: int = 1 << 25, probes: int = 3) -> KeySet:
        """From the first column of ``keys``; nulls are left out."""
        made = cls(bits, probes)

        def run(batches):
            own = cls(bits, probes)
            for b in batches:
                own.add(b.column(0).drop_null().to_numpy())
            yield from pieces(own.array)

        made.array = folded(keys.mapInArrow(freeing(run), PIECES), bits // 8, np.uint8, np.bitwise_or)
        return made

    def add(self, keys: np.ndarray) -> None:
        for k in range(self.probes):
            at = mixed(keys, k) & np.uint64(self.bits - 1)
            np.bitwise_or.at(self.array, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for k in range(self.probes):
            at = mixed(keys, k) & np.uint64(self.bits - 1)
            out &= (self.array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out
