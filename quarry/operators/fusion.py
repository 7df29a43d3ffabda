"""Fusing ranked lists ``(list, id, score)`` over any id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def ranked(results: DataFrame) -> DataFrame:
    """With ``rank`` from 0 within each list."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return results.withColumn("rank", F.row_number().over(order) - 1)


def as_list(results: DataFrame, name: str) -> DataFrame:
    return results.select(F.lit(name).alias("list"), "id", "score")


def reciprocal_rank(results: DataFrame, k: float = RRF_K) -> DataFrame:
    """``id, score``: the sum of ``1 / (k + rank + 1)`` over the lists."""
    return ranked(results).groupBy("id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"))


def weighted(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``id, score``: the weighted sum of scores scaled to 0..1 within each list (1 where a list has one value)."""
    every = Window.partitionBy("list")
    low, high = F.min("score").over(every), F.max("score").over(every)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("list") == name, F.lit(float(w))).otherwise(weight)
    return results.withColumn("part", weight * scaled).groupBy("id").agg(F.sum("part").alias("score"))


def two_weights(share: float) -> dict[str, float]:
    """The share of the lexical list, within 0 and 1; the rest is the semantic list's."""
    w = min(1.0, max(0.0, share))
    return {"lexical": w, "semantic": 1.0 - w}


def top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "id").limit(k)
