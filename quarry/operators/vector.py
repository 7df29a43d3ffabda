"""Nearest neighbours by cosine, exact; vectors in a table, deletions as a second one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V


class DimensionError(ValueError):
    """A vector that does not have the index's dimension."""


@dataclass
class VectorIndex:
    """``vectors(id, embedding)`` of one dimension, and ``deleted(id)``."""

    vectors: DataFrame
    dim: int
    deleted: DataFrame | None = None

    def live(self) -> DataFrame:
        return self.vectors if self.deleted is None else self.vectors.join(self.deleted.select("id").distinct(), "id", "left_anti")

    def count(self) -> DataFrame:
        return self.live().agg(F.count("*").alias("vectors"))

    def add(self, more: DataFrame) -> VectorIndex:
        """With further vectors; a vector of another dimension or a negative id is an error when read."""
        bad = (F.size("embedding") != self.dim) | (F.col("id") < 0)
        checked = more.select("id", F.when(bad, F.raise_error(F.lit(f"expected ids from 0 and {self.dim} dimensions"))).otherwise(F.col("embedding")).alias("embedding"))
        return VectorIndex(self.vectors.unionByName(checked), self.dim, self.deleted)

    def delete(self, ids: DataFrame) -> VectorIndex:
        gone = ids.select("id")
        return VectorIndex(self.vectors, self.dim, gone if self.deleted is None else self.deleted.unionByName(gone))

    def compact(self) -> VectorIndex:
        return VectorIndex(self.live(), self.dim)

    def search(self, query: list[float], k: int) -> DataFrame:
        """``id, score`` of the ``k`` nearest live vectors, ties to the smaller id."""
        if len(query) != self.dim:
            raise DimensionError(f"the query has {len(query)} dimensions, the index {self.dim}")
        q = F.array(*(F.lit(float(x)) for x in query))
        return self.live().select("id", V.cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, id, score`` for ``queries(query_id, embedding)``: every query against all vectors, in blocks.

    Norms are taken once per vector.  The stated queries are the small side; each task keeps only k rows per query
    ahead of the shuffle (window group limit).
    """
    v = vectors.select("id", V.normalize(F.col("embedding")).alias("u"))
    q = queries.select("query_id", V.normalize(F.col("embedding")).alias("w"))
    scored = v.join(q).select("query_id", "id", F.when(F.size("u") == F.size("w"), V.dot(F.col("u"), F.col("w"))).otherwise(F.lit(0.0)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def write(index: VectorIndex, where: str) -> None:
    index.compact().vectors.write.mode("overwrite").parquet(where)


def read(spark: SparkSession, where: str, dim: int) -> VectorIndex:
    return VectorIndex(spark.read.parquet(where), dim)
