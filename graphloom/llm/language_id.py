"""Language of each document by a byte convolutional network over fixed-length windows of the whole text.

The network is trained with numpy on every window of every labelled document.
Training starts from a small network that the driver fits on a few documents
(``SAMPLE_DOCS`` a language, by a hash of their id, ``SAMPLE_WINDOWS`` windows of
each). Then come ROUNDS rounds, in one of which each document stands by its hash:
every task trains the network on all windows of its documents, where they are,
and the tasks' networks are averaged by their windows. Languages keep the balance
of the start. A document's class probabilities are the mean over all its windows,
weighted by the bytes in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.convnet import ConvNet
from graphloom.llm.textbytes import expand, freeing, has_letter, layout, map_texts

WINDOW = 256
SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_STEPS = 500, 4, 1500  # of the start only
ROUNDS, RATE, BATCH = 3, 0.001, 128
#: Tasks that add up the tasks' networks before the driver does.
ADDERS = 16


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key's text, modulo the number of folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zeros, text of each, bytes in each); an empty text has none."""
    count = -(-np.diff(offsets) // WINDOW)
    text = np.repeat(np.arange(len(count)), count)
    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    size = np.minimum(offsets[text + 1] - start, WINDOW)
    x = np.zeros((len(text), WINDOW), np.uint8)
    x.reshape(-1)[expand(np.arange(len(text)) * WINDOW, size)] = data[expand(start, size)]
    return x, text, size


def _sampled(batch: pa.RecordBatch):
    data, offsets = layout(batch.column("text"))
    x, text, size = windows(data, offsets)
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    total = np.bincount(text, minlength=len(offsets) - 1)[text]
    keep = np.flatnonzero((rank * SAMPLE_WINDOWS // total != (rank - 1) * SAMPLE_WINDOWS // total) | (rank == 0))
    lang = batch.column("lang").take(pa.array(text[keep]))
    yield pa.RecordBatch.from_arrays([lang, pa.array([x[i].tobytes() for i in keep], pa.binary())], ["lang", "x"])


class _Learn:
    """(task, n, flat): the network after all windows of a task's texts, times their number."""

    def __init__(self, classes: list[str], net: ConvNet, weight: np.ndarray):
        self.index, self.net, self.weight = {c: i for i, c in enumerate(classes)}, net, weight
        self.state, self.n = {}, 0

    def __call__(self, batch: pa.RecordBatch):
        x, text, _ = windows(*layout(batch.column("text")))
        y = np.array([self.index[c] for c in batch.column("lang").to_pylist()])[text]
        self.net.fit(x, y, 1, BATCH, RATE, weight=self.weight, state=self.state)
        self.n += len(x)
        return iter(())

    def finish(self):
        if self.n:
            yield _network(TaskContext.get().partitionId(), self.n, self.net.flat() * float(self.n))


def _network(task: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], ["task", "n", "flat"])


def _add(batches):
    task, n, total = None, 0, 0.0
    for b in batches:
        for t, k, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            task, n, total = t if task is None else task, n + k, total + np.frombuffer(flat.as_buffer(), np.float64)
    if n:
        yield _network(task, n, total / n)


def learn(known: DataFrame, classes: list[str], net: ConvNet, weight: np.ndarray) -> ConvNet:
    """``net`` trained on every window of ``known(text, lang)``, task by task, and averaged."""
    schema = "task long, n long, flat binary"
    made = map_texts(known, _Learn(classes, net, weight), schema)
    added = made.repartition(ADDERS, F.pmod("task", F.lit(ADDERS))).sortWithinPartitions("task").mapInArrow(freeing(_add), schema)
    return net.averaged(sorted(added.collect(), key=lambda r: r["task"]))


def train(docs: DataFrame, usable: Column) -> tuple[list[str], ConvNet | None]:
    """(classes, network) from ``docs(doc_id, text, lang)``; the network is None below two classes."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return [], None
    classes = sorted(sizes)
    if len(classes) == 1:
        return classes, None
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    limit = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, min(1 << 40, int((1 << 40) * 2 * SAMPLE_DOCS / n)))))
    few = known.withColumn("_h", h).where(F.col("_h") <= limit[F.col("lang")])
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_h", "text"))).where(F.col("_r") <= SAMPLE_DOCS)
    rows = map_texts(few.select("lang", "text"), _sampled, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(len(rows), WINDOW)
    y = np.array([classes.index(r["lang"]) for r in rows])
    net = ConvNet(len(classes)).fit(x, y, epochs=max(4, TRAIN_STEPS * 64 // len(x)))
    n = np.array([sizes[c] for c in classes], np.float64)
    weight = np.minimum(n, SAMPLE_DOCS) / n
    weight = (weight * n.sum() / (weight * n).sum()).astype(np.float32)
    for k in range(ROUNDS):
        net = learn(known.where(F.pmod(h, F.lit(ROUNDS)) == k).select("text", "lang"), classes, net, weight)
    return classes, net


class _Predict:
    def __init__(self, classes: list[str], net: ConvNet | None):
        self.classes, self.net = classes, net

    def __call__(self, batch: pa.RecordBatch):
        n = len(batch)
        lang, score = np.full(n, "und", object), np.zeros(n)
        good = has_letter(batch.column("text"))
        if self.classes and self.net is None:
            lang[good], score[good] = self.classes[0], 1.0
        elif self.classes:
            data, offsets = layout(batch.column("text"))
            total = np.zeros((n, len(self.classes)))
            step = max(1, (1 << 20) // WINDOW)
            x, text, size = windows(data, offsets)
            for a in range(0, len(x), step):
                prob = self.net.probabilities(x[a : a + step]) * size[a : a + step, None]
                np.add.at(total, text[a : a + step], prob)
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(1)
            lang[good] = np.array(self.classes, object)[best[good]]
            score[good] = np.clip(total[np.arange(n), best], 0, 1)[good]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])


class Accept:
    """Batch function that keeps the rows whose language is known with at least ``least`` probability."""

    def __init__(self, model: tuple[list[str], ConvNet | None], least: float):
        self.judge, self.least = _Predict(*model), least

    def __call__(self, batch: pa.RecordBatch):
        (got,) = self.judge(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"]))
        lang, score = got.column(0).to_numpy(zero_copy_only=False), got.column(1).to_numpy()
        yield batch.filter(pa.array((lang != "und") & (score >= self.least)))


def predict(docs: DataFrame, model: tuple[list[str], ConvNet | None], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs(text, ...)`` with ``lang_pred`` and ``score``; und and 0 for a null text or one without a letter."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", lang_pred string, score double"
    return map_texts(docs.select(*keep, "text"), _Predict(*model), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs(doc_id, text, lang)``.

    Trained on rows whose crc32(doc_id) modulo 4 is not 2 (a null id is never
    trained on and counts as held out). Without labelled rows all is ``und``; with one language,
    every text with a letter is of it. Repeated rows are judged alike.
    """
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True))
    model = train(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
