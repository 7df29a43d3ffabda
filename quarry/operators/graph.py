"""Call graphs: a bounded breadth-first walk over resolved calls.

The walk is a loop over levels, each a join of the distinct frontier with the calls; the loop is bounded by the
depth asked for, not by data.  A chunk is expanded once at every depth at which it is met, so cycles
repeat their edges at each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 3


def label(callee: Column, receiver: Column) -> Column:
    return F.concat_ws(".", receiver, callee)


def frontiers(calls: DataFrame, root: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``depth, chunk_id``: the chunks met at each depth, from ``root(chunk_id)`` at 0."""
    resolved = calls.where("resolved_chunk_id is not null").select(F.col("caller_chunk_id").alias("chunk_id"), F.col("resolved_chunk_id").alias("__next")).distinct()
    level = root.select("chunk_id")
    out = level.select(F.lit(0).alias("depth"), "chunk_id")
    for d in range(1, depth + 1):
        level = level.join(resolved, "chunk_id").select(F.col("__next").alias("chunk_id")).distinct()
        out = out.unionByName(level.select(F.lit(d).alias("depth"), "chunk_id"))
    return out


def walk(calls: DataFrame, root: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``depth, caller_chunk_id, call_id, resolved_chunk_id, callee_name, receiver, target_kind, call_line, call_column``:
    the calls of each frontier chunk above the last depth."""
    at = frontiers(calls, root, max(depth - 1, 0)).where(F.col("depth") < depth)
    cols = ["call_id", "resolved_chunk_id", "callee_name", "receiver", "target_kind", F.col("line").alias("call_line"), F.col("column").alias("call_column")]
    return at.join(calls, at["chunk_id"] == calls["caller_chunk_id"]).select("depth", "caller_chunk_id", *cols)


def build(calls: DataFrame, root: DataFrame, files: DataFrame, chunks: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes ``id, symbol, file, line, depth, target_kind``, edges ``from, to, call_line, call_column``).

    Nodes and edges come from one walk, which is kept while they are read.  A node is a chunk, or the label and kind of an unresolved target.  Ids count from 1 in the order of
    depth, calling chunk, line and column.  The graph of one root is bounded by its reach, so nodes are numbered in one window.
    """
    edges = walk(calls, root, depth)
    name = label(F.col("callee_name"), F.col("receiver"))
    key = F.when(F.col("resolved_chunk_id").isNotNull(), F.concat(F.lit("#"), F.col("resolved_chunk_id").cast("string"))).otherwise(F.concat_ws("|", F.lit("?"), "target_kind", name))
    edges = edges.withColumn("key", key).withColumn("name", name).withColumn("order", F.struct("depth", "caller_chunk_id", "call_line", "call_column", "call_id")).persist()
    start = root.select(F.concat(F.lit("#"), F.col("chunk_id").cast("string")).alias("key"), F.col("chunk_id").alias("node_chunk"), F.lit(None).cast("string").alias("name"), F.lit("project").alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["order"].dataType).alias("order"))
    met = edges.select("key", F.col("resolved_chunk_id").alias("node_chunk"), "name", F.col("target_kind").alias("kind"), (F.col("depth") + 1).alias("depth"), "order")
    firsts = start.unionByName(met).groupBy("key").agg(F.min(F.struct("depth", "order", "node_chunk", "name", "kind")).alias("f")).select("key", "f.*")
    numbered = firsts.withColumn("id", F.row_number().over(Window.orderBy("depth", F.col("order").asc_nulls_first(), "key")))
    places = chunks.select(F.col("chunk_id").alias("node_chunk"), F.col("symbol").alias("__symbol"), F.col("start_line").alias("line"), "file_id").join(files.select("file_id", F.col("path").alias("file")), "file_id").drop("file_id")
    nodes = numbered.join(places, "node_chunk", "left")
    ids = nodes.select("key", F.col("id").alias("to"))
    origins = nodes.where("node_chunk is not null").select(F.col("node_chunk").alias("caller_chunk_id"), F.col("id").alias("from"))
    linked = edges.join(ids, "key").join(origins, "caller_chunk_id")
    return (
        nodes.select("id", F.coalesce("__symbol", "name").alias("symbol"), "file", "line", "depth", F.col("kind").alias("target_kind")),
        linked.select("from", "to", "call_line", "call_column"),
    )
