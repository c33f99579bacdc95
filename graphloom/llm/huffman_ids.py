"""Token ids in files of canonical, length-limited Huffman codes.

Format. A folder holds ``codebook`` (one row: the code length of every id) and
``blocks`` (Parquet, one folder for each range ``part=N`` in ascending doc_id
order, rows within by ``before``). A block is coded on its own:

    magic "GLH1", longest code, checkpoint step, documents, ids, bits   (header)
    doc_id int64 and n int32 of each document, 1 byte each for a null id
    uint32 bit offset of every ``step``-th id
    the codes, most significant bit first, in big-endian 32-bit words

Codes follow from the lengths alone (shorter first, then by id). The decoder
starts a lane at each checkpoint and steps all lanes at once through a table
indexed by the next ``longest`` bits. A block holds whole documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.textbytes import freeing
from graphloom.llm.token_table import token_table, unpack
from graphloom.storage import Stage

STEP = 256
BLOCK_IDS = 1 << 19
_HEAD = struct.Struct("<4sBHIQQ")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, items = [], leaf
    kinds = np.ones(len(leaf), bool)
    for _ in range(limit - 1):
        levels.append(kinds)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaf, pairs))
        kind = np.concatenate((np.ones(len(leaf), bool), np.zeros(len(pairs), bool)))
        at = np.argsort(both, kind="stable")
        items, kinds = both[at], kind[at]
    levels.append(kinds)
    take, length = 2 * len(leaf) - 2, np.zeros(len(leaf) + 1, np.int64)
    for kinds in reversed(levels):
        leaves = int(kinds[:take].sum())
        length[leaves] += 1
        take = 2 * (take - leaves)
    out[order] = np.cumsum(length[::-1])[::-1][1:]
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.uint64)
        longest = int(size[-1])
        width = np.uint64(1) << (np.uint64(longest) - size)
        start = np.concatenate(([0], np.cumsum(width)[:-1])).astype(np.uint64)
        codes[order] = start >> (np.uint64(longest) - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(longest code, id and length by the next bits)."""
    longest = int(lengths.max()) if len(lengths) else 0
    ids, size = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (longest - lengths[order].astype(np.int64))
    n = int(width.sum())
    ids[:n], size[:n] = np.repeat(order, width), np.repeat(lengths[order], width)
    return longest, ids, size


def encode_block(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    words = (bits + 31) // 32 + 2
    word = at >> 5
    # codes never share a bit, so the sums are exact and below 2**32
    first = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    second = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    stream = (first + second).astype(">u4")
    head = _HEAD.pack(b"GLH1", int(lengths.max()), STEP, len(doc_ids), len(ids), bits)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((head, keys.tobytes(), sizes.astype("<i4").tobytes(), null.tobytes(), at[::STEP].astype("<u4").tobytes(), stream.tobytes()))


def decode_block(blob: bytes, table: tuple[int, np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, count of each document, ids)."""
    magic, longest, step, docs, n, _bits = _HEAD.unpack_from(blob)
    if magic != b"GLH1" or longest != table[0]:
        raise ValueError("not a block of this codebook")
    o = _HEAD.size
    keys = np.frombuffer(blob, "<i8", docs, o)
    sizes = np.frombuffer(blob, "<i4", docs, o + 8 * docs).astype(np.int64)
    null = np.frombuffer(blob, np.uint8, docs, o + 12 * docs)
    o += 13 * docs
    lanes = -(-n // step)
    pos = np.frombuffer(blob, "<u4", lanes, o).astype(np.int64)
    stream = np.frombuffer(blob, ">u4", -1, o + 4 * lanes).astype(np.uint64)
    pair = (stream[:-1] << np.uint64(32)) | stream[1:]
    out = np.zeros((step, lanes), "<u4")
    _, sym, size = table
    shift, mask, last = 64 - longest, np.uint64((1 << longest) - 1), len(pair) - 1
    for k in range(step):
        window = (pair[np.minimum(pos >> 5, last)] >> (shift - (pos & 31)).astype(np.uint64)) & mask
        out[k] = sym[window]
        pos = pos + size[window]
    ids = out.T.reshape(-1)[:n]
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist())], sizes, ids


def _histogram(batches):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for n, blob in zip(b.column(0).to_pylist(), b.column(1)):
            got = np.bincount(unpack(blob.as_buffer(), n))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _blocks(lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def run(batches):
        held: list = []

        def flush():
            sizes = np.array([len(x[3]) for x in held], np.int64)
            blob = encode_block([x[2] for x in held], sizes, np.concatenate([x[3] for x in held]), lengths, codes)
            row = [[held[0][0]], [held[0][1]], [len(held)], [int(sizes.sum())], [blob]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["part", "before", "docs", "ids", "payload"])

        room = 0
        for b in batches:
            for part, before, doc_id, n, blob in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                ids = unpack(blob.as_buffer(), n)
                if held and (held[0][0] != part or room + len(ids) > BLOCK_IDS):
                    yield flush()
                    room = 0
                held.append((part, before, doc_id, ids))
                room += len(ids)
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, limit: int = 16) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the coded ids in ascending doc_id order to ``path``.

    Null texts are empty; nulls among the ids come first; an empty table gives
    files without blocks. The counts that reach the driver are bounded by the
    vocabulary. ``limit`` grows when the vocabulary needs longer codes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "huffman")
    tokens = token_table(docs, stage, tokenizer_path, end_id)
    rows = tokens.select("n", "ids").mapInArrow(freeing(_histogram), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max(limit, int(np.ceil(np.log2(max(2, len(rows))))) + 1 if len(rows) > 1 << (limit - 1) else limit))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    blocks = tokens.select("part", "before", "doc_id", "n", "ids").mapInArrow(freeing(_blocks(lengths)), "part int, before long, docs int, ids long, payload binary")
    blocks.sortWithinPartitions("part", "before").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    stage.drop("tokens")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0]), np.uint8)
    table = decode_table(lengths)
    blocks = spark.read.schema("before long, docs int, ids long, payload binary, part int").parquet(f"{path}/blocks")

    def run(batches):
        for b in batches:
            for part, before, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                keys, sizes, flat = decode_block(blob.as_buffer(), table)
                ends = np.cumsum(sizes)
                cut = list(zip((ends - sizes).tolist(), ends.tolist()))
                cols = [
                    pa.array([part] * len(keys), pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(ends - sizes + before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(flat[a:z]) for a, z in cut], pa.int64()),
                ]
                if ids:
                    cols.append(pa.array([flat[a:z].astype(np.int32) for a, z in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kinds = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    docs = blocks.select("part", "before", "payload").mapInArrow(freeing(run), kinds)
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("total"))  # one row for each range
    starts = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    return docs.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
