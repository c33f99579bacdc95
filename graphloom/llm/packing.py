"""Mixture-controlled packing of whole documents into sequences of a fixed window.

Every source is a queue of tokens in ascending doc_id order, with a weight. A
token's credit date is (place in its queue + 1) / weight: the moment at which
deficit round-robin with a quantum of one token has saved enough credit to send
it. Windows are filled in order of credit date (ties in queue order), so each
window takes from a queue its weight's share, the fraction of a token that is
left over stays as the queue's deficit for the next window, and an empty queue
passes its share to the others. A token's rank in that order has a closed form
in the queue lengths and weights, hence each task cuts its own documents alone
and deficits pass over windows and partitions without any task waiting.
Default weights are the sources' token totals, scaled to WEIGHT_BITS bits.
The rest after the last whole window goes into sequences whose lengths are
powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.textbytes import freeing
from graphloom.llm.token_table import token_table, unpack
from graphloom.storage import Stage, bounded_broadcast

WEIGHT_BITS = 30
#: Rows of (part, queue) offsets up to which they are broadcast.
OFFSET_ROWS = 1_000_000


class Schedule:
    """The order in which deficit round-robin with a quantum of one token sends the queues' tokens.

    Tokens go by credit date, (place + 1) / weight, ties in queue order; a queue
    that has ended sends no more. Time and memory of a call grow with the number
    of queues, not with its square.
    """

    #: Ranks times queues that are worked on at once.
    CELLS = 1 << 20

    def __init__(self, totals: np.ndarray, weights: np.ndarray):
        self.totals, self.weights = totals.astype(np.float64), weights.astype(np.float64)
        self.total = int(totals.sum())
        ends = self.totals / self.weights
        order = np.argsort(ends)
        self.ends = np.concatenate(([0.0], ends[order]))
        speed = self.weights.sum() - np.concatenate(([0.0], np.cumsum(self.weights[order])))[:-1]
        self.by_end = np.concatenate(([0.0], np.cumsum(np.diff(self.ends) * speed)))  # tokens until each end, as if they could be parted

    def until(self, date: np.ndarray) -> np.ndarray:
        """Tokens of each queue up to a date, one row for each date."""
        date = date[:, None]
        n = np.floor(date * self.weights)
        n += (n + 1) / self.weights <= date
        n -= n / self.weights > date
        return np.minimum(n, self.totals)

    def date(self, rank: np.ndarray) -> np.ndarray:
        """Date of the last of the first ``rank`` tokens, ``rank`` at least 1."""
        near = lambda x: np.interp(x, self.by_end, self.ends)
        lo, hi = near(rank - 2.0) * (1 - 1e-9), near(rank + len(self.totals) + 2.0) * (1 + 1e-9)
        lo = np.where(self.until(lo).sum(1) < rank, lo, 0.0)
        hi = np.where(self.until(hi).sum(1) >= rank, hi, self.ends[-1])
        out, open_ = hi.copy(), np.arange(len(rank))
        while len(open_):
            n = self.until(lo)
            after = np.where(n < self.totals, (n + 1) / self.weights, np.inf).min(1)  # the first date after lo
            mid = np.clip((lo + hi) / 2, after, hi)
            n = self.until(mid)
            enough = n.sum(1) >= rank[open_]
            hi = np.where(enough, np.where(n > 0, n / self.weights, 0).max(1), hi)  # the last date up to mid
            lo = np.where(enough, lo, mid)
            out[open_] = hi
            more = ~(enough & (hi <= after))
            lo, hi, open_ = lo[more], hi[more], open_[more]
        return out

    def sent(self, rank: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first ``rank`` tokens, one row for each rank."""
        out = np.zeros((len(rank), len(self.totals)), np.int64)
        some = np.flatnonzero(rank > 0)
        step = max(1, self.CELLS // max(1, len(self.totals)))
        for a in range(0, len(some), step):
            at = some[a : a + step]
            date = self.date(rank[at])
            n = self.until(date)
            tied = (n > 0) & (n / self.weights == date[:, None])
            over = n.sum(1) - rank[at]  # of the tokens of this very date the last queues' wait
            n -= tied & (np.cumsum(tied[:, ::-1], 1)[:, ::-1] <= over[:, None])
            out[at] = n
        return out

    def rank(self, queue: int, place: int) -> int:
        """Tokens sent before the ``place``-th of a queue."""
        date = np.array([(place + 1) / self.weights[queue]])
        n = self.until(date)[0]
        return int(n.sum()) - int(((n > 0) & (n / self.weights == date))[queue:].sum())


def scaled(totals: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
    share = totals if shares is None else shares
    share = np.asarray(share, np.float64)
    return np.maximum(1, np.round(share / max(share.sum(), 1e-300) * (1 << WEIGHT_BITS))).astype(np.int64)


def tail_sequences(total: int, length: int) -> list[tuple[int, int]]:
    """(first token rank, length) of the sequences after the last whole window."""
    at, out = total // length * length, []
    for bit in reversed(range(length.bit_length())):
        if (total - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


class _Cut:
    def __init__(self, queues: list, schedule: Schedule, length: int, with_ids: bool):
        self.index = {q: i for i, q in enumerate(queues)}
        self.schedule, self.length, self.with_ids = schedule, length, with_ids
        self.whole = schedule.total // length
        self.tail = tail_sequences(schedule.total, length)

    def bounds(self, queue: int, first: int, last: int) -> tuple[np.ndarray, ...]:
        """(sequences that hold tokens first..last of a queue, first token there, offset there, end)."""
        lo, hi = (self.schedule.rank(queue, x) // self.length for x in (first, last))
        seq = list(range(lo, min(hi, self.whole - 1) + 1))
        rank, size = [w * self.length for w in seq], [self.length] * len(seq)
        if hi >= self.whole:
            seq += [self.whole + k for k in range(len(self.tail))]
            rank += [at for at, _ in self.tail]
            size += [n for _, n in self.tail]
        rank = np.array(rank, np.int64)
        edges, back = np.unique(np.concatenate((rank, rank + np.array(size, np.int64))), return_inverse=True)
        begin, end = np.split(self.schedule.sent(edges)[back], 2)
        return np.array(seq), begin[:, queue], (end - begin)[:, :queue].sum(1), end[:, queue]

    def __call__(self, batches):
        for b in batches:
            names = b.schema.names
            get = lambda c: b.column(names.index(c))  # noqa: B023, E731
            rows = [(q, base + before, doc, n, blob) for q, base, before, doc, n, blob in zip(*(get(c).to_pylist() for c in ("queue", "base", "before", "doc_id", "n")), get("ids"))]
            rows.sort(key=lambda r: (r[0], r[1]))
            out: list[list] = [[] for _ in range(8)]
            at = 0
            while at < len(rows):  # documents that follow one another in one queue
                to, end = at + 1, rows[at][1] + abs(rows[at][3])
                while to < len(rows) and rows[to][0] == rows[at][0] and rows[to][1] == end:
                    end += abs(rows[to][3])
                    to += 1
                self.cut(rows[at:to], end, out)
                at = to
            kinds = (pa.int64(),) * 7 + (pa.list_(pa.int32()),)
            cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + self.with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds[: len(cols)])], cols)

    def cut(self, rows: list, end_place: int, out: list[list]) -> None:
        queue, place = self.index[rows[0][0]], rows[0][1]
        seq, at, off, end = (x.tolist() for x in self.bounds(queue, place, end_place - 1))
        k = 0
        for _q, _place, doc_id, n, blob in rows:
            ids, n = unpack(blob.as_buffer(), n), abs(n)
            done = 0
            while done < n:
                while end[k] <= place:
                    k += 1
                take = min(n - done, end[k] - place)
                piece = ids[done : done + take]
                for col, v in zip(out, (doc_id, done, take, zlib.crc32(piece), n, seq[k], off[k] + place - at[k])):
                    col.append(v)
                if self.with_ids:
                    out[7].append(piece.astype(np.int32))
                done += take
                place += take


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, source: str = "source", shares: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``docs(doc_id, text, <source>)``. Null and empty texts hold the end id alone;
    null sources form a queue of their own; repeated rows are packed as often as
    they come; an empty table gives no piece. ``shares`` sets target proportions
    by source (absent ones: their natural share). Each source has a queue of its
    own, however many there are. ``length`` must be a power of two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    tokens = token_table(docs.select("doc_id", "text", named.alias("queue")), stage, tokenizer_path, end_id, "queue")
    sums = stage.table("sums", tokens.groupBy("part", "queue").agg(F.sum(F.abs("n").cast("long")).alias("total")))
    rows = sums.groupBy("queue").agg(F.sum("total").alias("total")).orderBy("queue").collect()
    queues, totals = [r["queue"] for r in rows], np.array([r["total"] for r in rows], np.int64)
    wanted = None
    if shares:
        wanted = np.array([shares.get(q[1:], t / totals.sum()) for q, t in zip(queues, totals)])
    offsets = sums.select("part", "queue", (F.sum("total").over(W.partitionBy("queue").orderBy("part")) - F.col("total")).alias("base"))
    offsets, _ = bounded_broadcast(offsets, OFFSET_ROWS)
    cut = _Cut(queues, Schedule(totals, scaled(totals, wanted)), length, with_ids) if rows else (lambda batches: iter(()))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return tokens.join(offsets, ["part", "queue"]).select("queue", "base", "before", "doc_id", "n", "ids").mapInArrow(freeing(cut), kinds)
