"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Vectors are cut to integers, ``floor(scale * x)``, and read as sparse rows: a term is a dimension, a posting
the weight of a vector there.  Rows are packed in blocks, queries in blocks.  Query blocks are broadcast in rounds of at most
``ROUND`` bytes; in a round each candidate block meets each query block where it lies, and no candidate travels.  For a pair,
the postings of one term after another, weighted by the queries that
hold the term, are scattered into a dense array of scores (queries x rows of the block); a partition selects
the k best of the block, a task keeps the k best of its blocks, and the tasks' selections are merged per query.

Scores are exact integers; a score that might not fit 64 bits raises.  Vectors that are null or hold null or non-finite components, and
rows whose ``vec_id`` is null, take no part; a vector
shorter than others has no postings beyond its end; repeated ids are rows of their own, and a query skips all
rows of its own id and is answered as often as it occurs; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace

ROWS, QUERIES = 4096, 256
ROUND = 32 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)


def pack_blocks(rows: DataFrame, column: str, size: int, tag: str) -> DataFrame:
    """Blocks of at most ``size`` rows of one partition each: ``tag, ids, data, width``.

    ``data``: little-endian 64-bit integers of ``floor`` values, row after row.
    """

    def run(batches, column: str = column):
        from pyspark import TaskContext

        part, n, ids, data = TaskContext.get().partitionId(), 0, [], []

        def close():
            nonlocal n
            width = max(map(len, data))
            dense = np.zeros((len(data), width), np.int64)
            for i, x in enumerate(data):
                dense[i, : len(x)] = x
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) | n]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([dense.astype("<i8").tobytes()], pa.binary()), pa.array([width], pa.int32())], [tag, "ids", "data", "width"])
            n += 1
            ids.clear()
            data.clear()
            return row

        for b in batches:
            for key, v in zip(b.column("vec_id").to_pylist(), b.column(column).to_pylist()):
                ids.append(key)
                data.append(v)
                if len(ids) == size:
                    yield close()
        if ids:
            yield close()

    return rows.select("vec_id", column).mapInArrow(run, f"{tag} long, ids binary, data binary, width int")


def scatter_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), one term after another."""
    terms = min(queries.shape[1], rows.shape[1])
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * terms
    if bound >= 1 << 63:
        raise OverflowError("scores may pass 64 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(rows)), kind)
    columns, weights = np.ascontiguousarray(rows.T, kind), queries.astype(kind)
    for t in range(terms):
        holders, posted = np.flatnonzero(weights[:, t]), np.flatnonzero(columns[t])
        if len(holders) == 0 or len(posted) == 0:
            continue
        if 2 * len(posted) > len(rows):  # a long posting list is scattered as a whole column
            for q in holders.tolist():
                scores[q] += weights[q, t] * columns[t]
        else:
            scores[np.ix_(holders, posted)] += np.outer(weights[holders, t], columns[t, posted])
    return scores


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, score) of the k best rows of each query, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    lo, hi = int(scores.min(initial=0)), int(scores.max(initial=0))
    if (hi - lo + 2) * n < 1 << 62:
        key = (scores.astype(np.int64) - lo + 1) * n + (n - 1 - np.arange(n))
        for q in range(len(query_ids)):
            a, b = np.searchsorted(ids, query_ids[q], "left"), np.searchsorted(ids, query_ids[q], "right")
            key[q, a:b] = -1
        top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
        q, c = np.repeat(np.arange(len(query_ids)), top.shape[1]), top.reshape(-1)
        keep = key[q, c] >= 0
        return q[keep], c[keep], scores[q, c][keep]
    picked = []
    for q in range(len(query_ids)):
        order = np.lexsort((ids, -scores[q]))
        order = order[ids[order] != query_ids[q]][:k]
        picked.append((np.full(len(order), q), order))
    q, c = (np.concatenate(x) for x in zip(*picked))
    return q, c, scores[q, c]


def _best_of(held: tuple | None, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among those held and new ones."""
    if held is not None:
        q, ids, scores = (np.concatenate(x) for x in zip(held, (q, ids, scores)))
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], ids[order][place < k], scores[order][place < k]


def _rounds(asked: DataFrame) -> list[tuple[int, int]]:
    """(first, last) block of each round: two numbers for every ``QUERIES`` queries are what the driver sees."""
    out, size = [], 0
    for block, n in asked.select("block", F.octet_length("data")).orderBy("block").toLocalIterator():
        if not out or size + n > ROUND:
            out.append((block, block))
            size = 0
        out[-1] = (out[-1][0], block)
        size += n
    return out


def _meet(spark: SparkSession, candidates: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``asked, query_id, vec_id, score``: the k best of each query in each partition of the candidates."""
    shared = spark.sparkContext.broadcast(queries)

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            for raw, data, width in zip(*(b.column(c).to_pylist() for c in ("ids", "data", "width"))):
                got = np.frombuffer(raw, "<i8")
                order = np.argsort(got, kind="stable")
                ids, rows = got[order], np.frombuffer(data, "<i8").reshape(len(got), width)[order]
                for block, q_ids, matrix in shared.value:
                    q, c, score = best(scatter_scores(matrix, rows), q_ids, ids, k)
                    held[block] = _best_of(held.get(block), q, ids[c], score.astype(np.int64), k)
        for block, q_ids, _ in shared.value:
            if block in held:
                q, ids, score = held[block]
                yield pa.RecordBatch.from_arrays([pa.array(block * QUERIES + q), pa.array(q_ids[q]), pa.array(ids), pa.array(score)], ["asked", "query_id", "vec_id", "score"])

    return candidates.select("ids", "data", "width").mapInArrow(run, "asked long, query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query against all rows but its own."""
    ws = Workspace(spark, "taat")
    ids = ws.table(usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("w")), "integers")
    candidates = ws.table(pack_blocks(ids, "w", ROWS, "block"), "candidates")
    asked = ws.table(pack_blocks(ids.where(is_query), "w", QUERIES, "block"), "queries")
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = None
    for part in _rounds(asked):
        queries = [(r["block"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<i8").reshape(-1, r["width"])) for r in asked.where(F.col("block").between(*part)).collect()]  # at most ROUND bytes
        met = ws.table(_meet(spark, candidates, queries, k), "met")
        found = met if found is None else found.unionByName(met)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
