"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and reread. All but the last return the
columns of ``documents``. Stages tell rows apart by a number of their own, so
null and repeated doc_ids are judged row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from graphloom.llm.queries import read, word_tokenizer
from graphloom.llm.textbytes import freeing, map_texts
from graphloom.storage import Stage

#: A text's language counts as unknown if its probability is under this multiple of an even guess.
LEAST_LANGUAGE = 1.2


#: Rows of one set of bits, as a power of two.
CHUNK = 16


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a lasting row number, and the number's column, which no column of ``docs`` is named like.

    Rows of Parquet files are numbered by file and place in it, so the texts are
    not written again; others are kept as a table.
    """
    row = _free(docs, "_row")
    try:
        at = docs.metadataColumn("_metadata")
        file = _free(docs, "_file")
        placed = docs.withColumns({file: at.getField("file_path"), row: at.getField("row_index")})
        files = sorted(r[0] for r in placed.select(file).distinct().collect())
    except AnalysisException:
        return Stage(docs.sparkSession, name).table("rows", docs.withColumn(row, F.monotonically_increasing_id())), row
    number = _free(docs, "_number")
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"`{file}` string, `{number}` long")
    placed = placed.join(F.broadcast(numbers), file)
    return placed.withColumn(row, F.shiftleft(number, 40) + F.col(row)).select(*(f"`{c}`" for c in docs.columns), row), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``rows`` but those whose number stands in ``gone``, without the number. A bit for each row is broadcast, no text is shuffled."""

    def bits(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.column(0).to_numpy()
            for k in np.unique(n >> CHUNK).tolist():
                flag = held.setdefault(k, np.zeros(1 << CHUNK, bool))
                flag[n[n >> CHUNK == k] & ((1 << CHUNK) - 1)] = True
        chunks = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([zlib.compress(np.packbits(held[k]).tobytes(), 1) for k in chunks], pa.binary())], ["chunk", "bits"])

    key = gone.columns[0]
    dealt = gone.select(F.col(key).cast("long")).where(F.col(key).isNotNull()).repartition(F.shiftright(key, CHUNK))
    found = {r["chunk"]: bytes(r["bits"]) for r in dealt.mapInArrow(freeing(bits), "chunk long, bits binary").toLocalIterator()}
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def keep(batches):
        sets: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.column(b.num_columns - 1).to_numpy()
            ok = np.ones(len(n), bool)
            for k in np.unique(n >> CHUNK).tolist():
                if k in shared.value:
                    if k not in sets:
                        sets[k] = np.unpackbits(np.frombuffer(zlib.decompress(shared.value[k]), np.uint8)).view(bool)
                    own = np.flatnonzero(n >> CHUNK == k)
                    ok[own] = ~sets[k][n[own] & ((1 << CHUNK) - 1)]
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(ok))

    columns = [c for c in rows.columns if c != row]
    return rows.select(*(f"`{c}`" for c in columns), row).mapInArrow(freeing(keep), rows.drop(row).schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language (no letter, or no class probable enough) go."""
    known = F.coalesce(language_id.fold(F.col("doc_id"), 4) != 2, F.lit(False))
    model = language_id.train(docs, known)
    return map_texts(docs, language_id.Accept(model, min(1.0, LEAST_LANGUAGE / max(1, len(model[0])))), docs.schema)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one of least row number; rows without words stay."""
    rows, row = _numbered(docs, "dedup-rows")
    groups = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    gone = groups.where("doc_id <> class_id").select(F.col("doc_id").alias(row))
    return _without(rows, row, gone)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item, whole or edited, go."""
    rows, row = _numbered(docs, "leak-rows")
    found = decontaminate.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(rows, row, found.select(F.col("doc_id").alias(row)).distinct())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten; every row stays."""
    model = secret_scan.train(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    return map_texts(docs, secret_scan.Redact(model), docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at most, in the mixture of the sources."""
    return packing.pack(docs, word_tokenizer(), end_id=1, length=2048)


STAGES = [("language", language), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets), ("packing", pack)]

#: No stage of these can be put in SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the last one's rows."""
    stage = Stage(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = stage.table(f"{k}-{name}", fn(spark, docs, sf_dir))
        if k:
            stage.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
