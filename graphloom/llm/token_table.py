"""Documents as token ids in ascending ``doc_id`` order, kept as a table in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textbytes import map_texts
from graphloom.llm.wordpieces import Encoder
from graphloom.storage import Stage

#: Bytes of text that are encoded at once.
SLICE = 8 << 20
SCHEMA = "part int, queue string, before long, doc_id long, n int, ids binary"


class _Tokenise:
    """Keeps, over one task, the ids seen so far in each queue."""

    def __init__(self, tokenizer_path: str, end_id: int):
        self.path, self.end = tokenizer_path, end_id
        self.seen: dict[str | None, int] = {}

    def __call__(self, batch: pa.RecordBatch):
        flat, count = Encoder.of(self.path).encode(batch.column("text"))
        ends = np.cumsum(count)
        ids = np.insert(flat, ends, self.end).astype("<u4")
        queues, before = batch.column("queue").to_pylist(), []
        sizes = (count + 1).tolist()
        for q, n in zip(queues, sizes):
            at = self.seen.get(q, 0)
            before.append(at)
            self.seen[q] = at + n
        wide = int(ids.max()) >= 1 << 16
        packed = ids if wide else ids.astype("<u2")
        off = np.concatenate(([0], np.cumsum(count + 1))) * packed.itemsize
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(sizes), pa.int32()),
                pa.array(queues, pa.string()),
                pa.array(before, pa.int64()),
                batch.column("doc_id").cast(pa.int64()),
                pa.array(-np.array(sizes) if wide else np.array(sizes), pa.int32()),
                blob.cast(pa.binary()),
            ],
            ["part", "queue", "before", "doc_id", "n", "ids"],
        )


def unpack(blob, n: int) -> np.ndarray:
    """Ids of one row; a negative ``n`` marks 32-bit storage."""
    return np.frombuffer(blob, "<u4" if n < 0 else "<u2").astype("<u4")


def token_table(docs: DataFrame, stage: Stage, tokenizer_path: str, end_id: int, queue: str | None = None) -> DataFrame:
    """``docs(doc_id, text[, queue])`` -> rows of SCHEMA, written and reread.

    Null texts are empty and hold the end id alone. Order: doc_id ascending,
    nulls first, equal ids by text; the range partition takes the text's hash as
    second key, so that one repeated id is not one task. ``part`` counts the
    ranges in order, ``before`` the ids of the same part and queue before a row.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    cols.append((F.col(queue).cast("string") if queue else F.lit(None).cast("string")).alias("queue"))
    ranged = docs.select(*cols).withColumn("_h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text", "queue")
    return stage.table("tokens", map_texts(ranged.select("doc_id", "text", "queue"), _Tokenise(tokenizer_path, end_id), SCHEMA, SLICE))
