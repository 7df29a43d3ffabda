"""From hits to results: hydration, symbol-aware reranking, overlap removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Factors of a symbol that equals the query, that holds it (or is held), that does so as written; of rows in the top row's file.
EQUAL, HOLDS, HOLDS_AS_WRITTEN, SAME_FILE = 1.25, 1.10, 1.08, 1.05


def with_rank(hits: DataFrame) -> DataFrame:
    """``rank`` from 0 by score, ties to the smaller id; for a bounded list of hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def hydrate(ranked: DataFrame, chunks: DataFrame, files: DataFrame, lines: int = T.SNIPPET_LINES) -> DataFrame:
    """Results of ranked hits ``(id, score, rank)``; hits without a chunk are left out.

    The hits are few: they are broadcast to the chunks, not the other way round.
    """
    found = chunks.join(F.broadcast(ranked), chunks["chunk_id"] == ranked["id"]).join(files.select("file_id", F.col("path").alias("file")), "file_id")
    return found.select("rank", "file", "symbol", "kind", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "score", T.head_lines(F.col("content"), lines).alias("snippet"), "chunk_id")


def symbol_factor(symbol: Column, query: str) -> Column:
    plain = "".join(c for c in query if c.isalnum()).lower()
    raw = query.lower()
    name = T.normalize_token(symbol)
    low = F.lower(symbol)
    either = lambda a, b: F.contains(a, F.lit(b)) | F.contains(F.lit(b), a)
    return (
        F.when(symbol.isNull(), F.lit(1.0))
        .when((name != "") & (name == plain), F.lit(EQUAL))
        .when((name != "") & F.lit(plain != "") & either(name, plain), F.lit(HOLDS))
        .when(either(low, raw), F.lit(HOLDS_AS_WRITTEN))
        .otherwise(F.lit(1.0))
    )


def rerank(results: DataFrame, query: str) -> DataFrame:
    """Rescored by symbol and by nearness to the first result's file; a new ``rank``."""
    every = Window.orderBy("rank")
    first = F.first_value("file").over(every)
    near = F.when((F.col("rank") > 0) & (F.col("file") == first), F.lit(SAME_FILE)).otherwise(F.lit(1.0))
    scored = results.withColumn("score", F.col("score") * symbol_factor(F.col("symbol"), query) * near)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank")) - 1)


def drop_overlaps(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """In rank order per file, a result goes if it shares more than ``threshold`` of the shorter of both with one that stays."""
    size = lambda r: F.greatest(r["end"] - r["start"] + 1, F.lit(0))
    shared = lambda a, b: F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1, F.lit(0))

    def covers(a, b):
        least = F.least(size(a), size(b))
        return (least > 0) & (shared(a, b) / least > threshold)

    names = [c for c in results.columns if c not in ("rank", "file")]
    row = F.struct("rank", *names)
    grouped = results.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", none, lambda done, r: F.when(F.exists(done, lambda k: covers(k, r)), done).otherwise(F.concat(done, F.array(r))))
    return grouped.select("file", F.inline(kept)).select(*results.columns)
