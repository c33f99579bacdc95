"""Registered queries of the ten operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bloom_lm, decontaminate, huffman_ids, language_id, license_scan, near_dedup, packing, secret_scan, suffix_dedup, threshold_topk
from graphloom.storage import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    huffman_ids.write_token_files(read(spark, sf_dir, "documents"), path, word_tokenizer(), end_id=2)
    return huffman_ids.read_token_files(spark, path, ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of each document, then what is left of its text; a character that a cut parts is replaced there."""
    found = suffix_dedup.dedup_substrings(read(spark, sf_dir, "documents"), with_text=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_tokenizer(), end_id=1, length=2048)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_texts(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_huffman_token_files, op2_near_dedup, op3_license_scan, op4_decontaminate, op5_threshold_topk, op6_suffix_dedup, op7_language_id, op8_secret_scan, op9_mixture_packing, op10_bloom_lm)}
ORACLES: dict[str, str] = {
    "op5_threshold_topk": """
WITH good AS (
    SELECT row_number() OVER () AS rw, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT rw, vec_id, unnest(v) AS x, unnest(range(len(v))) AS d, len(v) AS n FROM good),
scored AS (
    SELECT q.rw, c.rw AS other, min(q.vec_id) AS query_id, min(c.vec_id) AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM parts q JOIN parts c ON q.d = c.d AND q.n = c.n AND q.rw <> c.rw
    WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rw ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
}
