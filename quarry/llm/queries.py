"""The registered queries of the training-data operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bound_packing, huffman_ids, line_edit_join, multiprobe_lsh, pu_quality, simhash_bk, source_mixing, subsequence_svm, taat_topk, warc_salvage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def _scored(scores: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = subsequence_svm.fit(spark, documents, labels, fold(3) != 1)
    return _scored(subsequence_svm.score(spark, documents, model), fold(3) == 1, 0.7)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_edit_join.dedup(spark, _table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_salvage.round_trip(spark, _table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taat_topk.top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = pu_quality.fit(spark, documents, labels, fold(5) != 0)
    return _scored(pu_quality.score(spark, documents, model), fold(5) == 0, 0.3)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.components(spark, _table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(spark, _table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_packing.pack_documents(spark, _table(spark, sf_dir, "documents"))


def op10_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe_lsh.search(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_huffman_ids": op8_huffman_ids,
    "op9_packing": op9_packing,
    "op10_multiprobe": op10_multiprobe,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), w AS (
            SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN winner <> page_id THEN winner END AS refers_to
        FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND payload_bytes >= 1000
    """,
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
}
