"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Each table cuts ``m`` Gaussian projections into cells of width ``w``.  A row lies in one cell per table.  A
neighbour's projections lie around the query's, drawn towards the centre of all rows, with a normal spread; so the
chance that it lies in a perturbed cell is a product of normal integrals, and the cells are visited in the order of that
chance, until it adds up to ``reach`` in each table.  The rows in visited cells are the candidates; their
distances are computed exactly, in double precision, where they lie, and the tables' nearest are merged without repeats.

The number of tables and projections, the width and the reach are those of least predicted cost (rows compared, and cells
visited) among ``GRID`` whose recall is at least ``recall``.  Both are measured on a bounded sample: the exact neighbours of
``sample_queries`` rows, found by one pass over all rows, and the cells of ``sample_rows`` rows.  All rows are indexed.
Rows without structure, all nearly as far from the query as its neighbours, leave little to skip: then most rows are visited, and
``visited`` says so.  Cells are dealt in groups; a cell with more than
``SPLIT`` rows is dealt over several groups, each of which its queries visit.  A query that finds fewer
rows than there are meets every cell of one table, which is exact.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows whose ``vec_id`` is null, take no
part; rows of another dimension than the query's are no candidates; a query skips all rows of its own id; every row is a
candidate and every query row is answered, ids repeated or not; an empty table gives no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, small_enough
from quarry.llm.taat_topk import usable

SPLIT = 4096
_MOST = 20_000  # cells that one query may visit in one table
#: What a visited cell costs, in rows compared.
_CELL = 30
GRID = ([(m, w) for m in (4, 6, 8, 12, 16, 20) for w in (1.5, 2.5, 4.0)], (1, 2, 4, 8), (0.3, 0.5, 0.7, 0.85, 0.95, 0.99))


@dataclass(frozen=True)
class Params:
    recall: float = 0.95
    sample_rows: int = 2048
    sample_queries: int = 24
    group_rows: int = 8192
    seed: int = 5


@dataclass(frozen=True)
class Hashing:
    """``w`` and ``spread`` in the units of the vectors; a neighbour lies around ``centre + pull * (query - centre)``."""

    tables: int
    m: int
    w: float
    reach: float
    spread: float
    pull: float
    centre: np.ndarray
    seed: int

    def project(self, x: np.ndarray, towards: bool = False) -> np.ndarray:
        """(rows, tables, m) cell coordinates, not yet cut; ``towards``: where neighbours of the rows are looked for."""
        rng = np.random.default_rng([self.seed, x.shape[1]])
        a = rng.standard_normal((x.shape[1], self.tables * self.m))
        if towards and x.shape[1] == len(self.centre):
            x = self.centre + self.pull * (x - self.centre)
        return (x @ a / self.w + rng.random(self.tables * self.m)).reshape(len(x), self.tables, self.m)


def cell_keys(cells: np.ndarray, table: np.ndarray | int, dim: int) -> np.ndarray:
    """64-bit names of cells; the last axis of ``cells`` holds their coordinates."""
    h = np.broadcast_to(np.asarray(table, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim), cells.shape[:-1]).copy()
    for i in range(cells.shape[-1]):
        h ^= cells[..., i].astype(np.int64).view(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz and Stegun 7.1.26, error under 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * e)


def _chances(coordinates: np.ndarray, low: np.ndarray, levels: int, spread: float) -> np.ndarray:
    """(m, levels): the chance that a projection falls in each of the cells from ``low`` on; ``spread`` in cells."""
    edges = (low[:, None] + np.arange(levels + 1)[None, :] - coordinates[:, None]) / spread
    return np.maximum(np.diff(_phi(edges), axis=1), 1e-12)


def probe_cells(coordinates: np.ndarray, h: Hashing) -> np.ndarray:
    """The perturbed cells of one table in the order of their chance, until they add up to the reach."""
    spread = h.spread / h.w
    side = max(1, math.ceil(4 * spread))
    low = np.floor(coordinates) - side
    steps = np.arange(2 * side + 1)
    chance = _chances(coordinates, low, len(steps), spread)
    floor = 0.05
    while True:  # every cell with a chance above the floor, which sinks until they are enough
        p, cells = np.ones(1), np.zeros((1, 0))
        ahead = np.r_[np.cumprod(chance.max(1)[::-1])[::-1][1:], 1.0]
        for i in range(len(low)):
            p2 = (p[:, None] * chance[i][None, :]).reshape(-1)
            keep = np.flatnonzero(p2 * ahead[i] > floor)
            cells = np.concatenate([cells[keep // len(steps)], (low[i] + steps[keep % len(steps)])[:, None]], axis=1)
            p = p2[keep]
        if p.sum() >= h.reach or len(p) >= _MOST or floor < 1e-12:
            break
        floor /= 8
    order = np.argsort(-p, kind="stable")
    need = int(np.searchsorted(np.cumsum(p[order]), h.reach)) + 1
    return cells[order[:need]].astype(np.int64)


def _matrix(batch, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers by dimension and their vectors."""
    col = batch.column(column)
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)


def _sample(vectors: DataFrame, k: int, p: Params) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sample rows, queries among them, the exact k nearest rows of each query), all of the commonest dimension."""
    some = vectors.select("row", "v").orderBy(F.xxhash64("row", F.lit(p.seed)), "row").limit(p.sample_rows).toArrow()
    size = np.diff(some.column("v").combine_chunks().offsets.to_numpy())
    dim = int(np.bincount(size).argmax())
    rows = some.to_batches()
    x = np.concatenate([m for b in rows for at, m in _matrix(b, "v") if m.shape[1] == dim])
    own = np.concatenate([b.column("row").to_numpy()[at] for b in rows for at, m in _matrix(b, "v") if m.shape[1] == dim])
    q, own = x[: p.sample_queries], own[: p.sample_queries]
    shared = vectors.sparkSession.sparkContext.broadcast((q, own))  # sample_queries vectors

    def nearest(batches):
        q, own = shared.value
        best_d, best_v = [np.zeros(0)] * len(q), [np.zeros((0, dim))] * len(q)
        for b in batches:
            ids = b.column("row").to_numpy()
            for at, m in _matrix(b, "v"):
                if m.shape[1] != dim:
                    continue
                d = ((m**2).sum(1)[None, :] + (q**2).sum(1)[:, None]) - 2 * q @ m.T
                d[own[:, None] == ids[at][None, :]] = np.inf
                for i in range(len(q)):
                    near = np.argpartition(d[i], k - 1)[:k] if len(at) > k else np.arange(len(at))
                    both_d, both_v = np.r_[best_d[i], d[i, near]], np.concatenate([best_v[i], m[near]])
                    keep = np.argsort(both_d, kind="stable")[:k]
                    best_d[i], best_v[i] = both_d[keep], both_v[keep]
        for i in range(len(q)):
            keep = np.isfinite(best_d[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), i)), pa.array(best_d[i][keep]), pa.array([v.tobytes() for v in best_v[i][keep].astype("<f8")], pa.binary())], ["i", "d", "v"])

    order = Window.partitionBy("i").orderBy("d", "v")
    found = vectors.select("row", "v").mapInArrow(nearest, "i long, d double, v binary").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()  # k per sample query
    return x, q, [np.array([np.frombuffer(r["v"], "<f8") for r in found if r["i"] == i]).reshape(-1, dim) for i in range(len(q))]


def fit(vectors: DataFrame, rows: int, k: int, p: Params) -> Hashing:
    """The hashing of least predicted cost whose recall on the sample suffices, else that of most recall."""
    x, q, near = _sample(vectors, k, p)
    centre = x.mean(0)
    pairs = [(a - centre, b - centre) for a, n in zip(q, near) for b in n]
    if not pairs:
        return Hashing(1, 1, 1.0, 0.99, 1.0, 1.0, centre, p.seed)
    a, b = (np.array(z) for z in zip(*pairs))
    pull = float((a * b).sum() / max((a * a).sum(), 1e-300))
    spread = max(float(np.sqrt(((b - pull * a) ** 2).sum(1).mean())), 1e-9 * (1 + float(np.abs(x).max())))
    many, reaches = GRID[1], GRID[2]
    best = None
    for m, width in GRID[0]:
        h = Hashing(max(many), m, width * spread, 0.0, spread, pull, centre, p.seed)
        cells, aims = np.floor(h.project(x)).astype(np.int64), h.project(q, towards=True)
        theirs = [np.floor(h.project(n)).astype(np.int64) for n in near]
        low = np.minimum(cells.min(0), np.floor(aims.min(0)).astype(np.int64)) - 4
        levels = int((np.maximum(cells.max(0), np.ceil(aims.max(0)).astype(np.int64)) + 5 - low).max())
        rng = np.random.default_rng(p.seed)
        draws = rng.standard_normal((512, m)) / width
        met = np.zeros((len(many), len(reaches), 2))
        visits = np.zeros(len(reaches))
        for i in range(len(q)):
            hit = np.zeros((len(reaches), len(near[i])), bool)
            compared = np.zeros(len(reaches))
            for t in range(h.tables):
                chance = np.log(_chances(aims[i, t], low[t], levels, 1 / width))
                score = lambda c, t=t, chance=chance: chance[np.arange(m), np.clip(c - low[t], 0, levels - 1)].sum(1)
                drawn = np.sort(score(np.floor(aims[i, t] + draws).astype(np.int64)))[::-1]
                least = drawn[[min(len(drawn) - 1, int(r * len(drawn))) for r in reaches]]
                hit |= score(theirs[i][:, t])[None, :] >= least[:, None]
                compared += (score(cells[:, t])[None, :] >= least[:, None]).mean(1)
                visits += [np.exp(-drawn[drawn >= z]).sum() / len(drawn) for z in least]
                if t + 1 in many:
                    at = many.index(t + 1)
                    met[at, :, 0] += hit.sum(1)
                    met[at, :, 1] += compared
        visits /= len(q) * h.tables
        for at, tables in enumerate(many):
            for j, reach in enumerate(reaches):
                if visits[j] > _MOST / 2:
                    continue
                recall = met[at, j, 0] / len(pairs)
                cost = met[at, j, 1] / len(q) * rows + _CELL * tables * visits[j]
                rank = (recall < p.recall, cost if recall >= p.recall else -recall)
                if best is None or rank < best[0]:
                    best = (rank, Hashing(tables, m, h.w, reach, spread, pull, centre, p.seed))
    return best[1]


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, p: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score, visited``: the k nearest found of each query, by Euclidean distance, and how many rows
    it was compared with, counted in each table."""
    ws = Workspace(spark, "multiprobe")
    rows = ws.table(usable(vectors).where(F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited long")
    h = fit(rows, total, k, p)
    groups = max(1, -(-total // p.group_rows))

    def index(batches):
        for b in batches:
            ids, places = b.column("vec_id").to_numpy(), b.column("row").to_numpy()
            for at, x in _matrix(b, "v"):
                keys = cell_keys(np.floor(h.project(x)), np.arange(h.tables), x.shape[1])
                raw = pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())
                for t in range(h.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(keys[:, t]), pa.array(ids[at]), pa.array(places[at]), raw], ["tab", "cell", "id", "row", "v"])

    def probe(batches):
        for b in batches:
            for at, x in _matrix(b, "v"):
                ids, places, where = b.column("vec_id").to_numpy()[at], b.column("row").to_numpy()[at], h.project(x, towards=True)
                for i in range(len(at)):
                    cells = [cell_keys(probe_cells(where[i, t], h), t, x.shape[1]) for t in range(h.tables)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(h.tables, ids[i])), pa.array(np.full(h.tables, places[i])), pa.array([x[i].astype("<f8").tobytes()] * h.tables, pa.binary()), pa.array(np.arange(h.tables, dtype=np.int32)), pa.array(cells, pa.list_(pa.int64()))], ["id", "row", "v", "tab", "cells"])

    indexed = ws.table(rows.mapInArrow(index, "tab int, cell long, id long, row long, v binary"), "index")
    large = ws.table(indexed.groupBy("tab", "cell").count().where(F.col("count") > SPLIT).select(F.col("tab").alias("lt"), F.col("cell").alias("lc"), F.ceil(F.col("count") / SPLIT).cast("int").alias("pieces")), "large")
    wide = F.broadcast(large) if small_enough(spark, large.count(), 24) else large
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # few rows, but much work each: dealt evenly, whatever adaptive coalescing makes of their size
    asked = rows.where(is_query).select("vec_id", "row", "v").repartition(n)

    def deal(df: DataFrame) -> DataFrame:
        return df.join(wide, (F.col("tab") == F.col("lt")) & (F.col("cell") == F.col("lc")), "left")

    group = lambda piece: F.pmod(F.xxhash64("tab", "cell", piece), F.lit(groups)).cast("int")
    own = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("row"), F.col("pieces").cast("long"))).otherwise(F.lit(0).cast("long"))
    data = deal(indexed).select("tab", group(own).alias("grp"), F.lit(0).alias("kind"), "cell", "id", "row", "v", F.lit(None).cast("array<long>").alias("cells"))
    probes = ws.table(asked.mapInArrow(probe, "id long, row long, v binary, tab int, cells array<long>"), "probes")
    pieces = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("pieces") - 1, F.lit(0)).cast("long"))
    visited = deal(probes.select("row", "tab", F.explode("cells").alias("cell"))).select("row", "tab", "cell", F.explode(pieces).alias("piece")).select("row", "tab", "cell", group(F.col("piece")).alias("grp"))
    visited = visited.groupBy("row", "tab", "grp").agg(F.collect_set("cell").alias("cells"))
    visits = visited.join(probes.select("id", "row", "tab", "v"), ["row", "tab"]).select("tab", "grp", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("cell"), "id", "row", "v", "cells")
    found = ws.table(_merge(ws.table(_meet(spark, data.unionByName(visits), k), "near"), k), "found")

    # Queries that found fewer rows than there are: every cell of table 0.
    have = found.groupBy("asked").agg(F.count("*").alias("n"))
    wanting = asked.join(have, asked["row"] == F.col("asked"), "left").where(F.coalesce("n", F.lit(0)) < min(k, total - 1)).select(F.col("vec_id").alias("id"), "row", "v")
    wanting = ws.table(wanting, "wanting")
    if wanting.isEmpty():
        return found.drop("asked")

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([np.array(v, "<f8").tobytes() for v in b.column("v").to_pylist()], pa.binary())], ["id", "row", "v"])

    every = wanting.mapInArrow(raw, "id long, row long, v binary").select(F.lit(0).alias("tab"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("cell"), "id", "row", "v", F.lit(None).cast("array<long>").alias("cells"))
    full = _merge(ws.table(_meet(spark, data.where("tab = 0").unionByName(every), k), "near"), k)
    return found.join(wanting.select(F.col("row").alias("asked")), "asked", "left_anti").unionByName(full).drop("asked")


def _meet(spark: SparkSession, both: DataFrame, k: int) -> DataFrame:
    """``asked, query_id, row, vec_id, score``: the k nearest rows of each query within each group of cells it visits, and a row
    without ``row`` whose ``score`` is how many it was compared with."""

    def answer(query: bytes, own: int, at: np.ndarray, x: np.ndarray, ids: np.ndarray):
        q = np.frombuffer(query, "<f8")
        at = at[ids[at] != own]
        d = np.sqrt(((x[at] - q) ** 2).sum(1))
        if len(at) > k:
            some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # all ties of the last
            at, d = at[some], d[some]
        order = np.lexsort((ids[at], d))[:k]
        return at[order], d[order]

    def run(batches):
        key, ids, places, vecs, cells, packed = None, [], [], [], [], None
        for b in batches:
            out: list[tuple] = []
            for tab, grp, kind, cell, i, row, v, visits in zip(*(b.column(c).to_pylist() for c in ("tab", "grp", "kind", "cell", "id", "row", "v", "cells"))):
                if (tab, grp) != key:
                    key, ids, places, vecs, cells, packed = (tab, grp), [], [], [], [], None
                if kind == 0:
                    ids.append(i)
                    places.append(row)
                    vecs.append(v)
                    cells.append(cell)
                    continue
                if packed is None:
                    packed = {}
                    names, owner = np.unique(np.array(cells, np.int64), return_inverse=True)
                    widths = np.fromiter(map(len, vecs), np.int64, len(vecs))
                    n_ids, n_rows = np.array(ids, np.int64), np.array(places, np.int64)
                    for w in np.unique(widths).tolist():
                        at = np.flatnonzero(widths == w)
                        packed[w] = (np.frombuffer(b"".join(vecs[j] for j in at.tolist()), "<f8").reshape(len(at), w // 8), n_ids[at], n_rows[at], owner[at], names)
                    vecs = []
                if len(v) not in packed:
                    continue
                x, n_ids, n_rows, owner, names = packed[len(v)]
                if visits is None:
                    at = np.arange(len(n_ids))
                else:
                    seen = np.zeros(len(names), bool)
                    want = np.array(visits, np.int64)
                    pos = np.searchsorted(names, want)
                    seen[pos[(pos < len(names)) & (names[np.minimum(pos, len(names) - 1)] == want)]] = True
                    at = np.flatnonzero(seen[owner])
                if len(at):
                    got, d = answer(v, i, at, x, n_ids)
                    out += zip([row] * len(got), [i] * len(got), n_rows[got].tolist(), n_ids[got].tolist(), d.tolist())
                    out.append((row, i, None, None, float(len(at))))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()])], ["asked", "query_id", "row", "vec_id", "score"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(n, "tab", "grp").sortWithinPartitions("tab", "grp", "kind").mapInArrow(run, "asked long, query_id long, row long, vec_id long, score double")


def _merge(near: DataFrame, k: int) -> DataFrame:
    """``asked, query_id, rank, vec_id, score, visited`` of the k nearest rows that any group found."""
    once = near.where("row is not null").groupBy("asked", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    visited = near.where("row is null").groupBy("asked").agg(F.sum("score").cast("long").alias("visited"))
    order = Window.partitionBy("asked").orderBy("score", "vec_id", "row")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(visited, "asked").select("asked", "query_id", "rank", "vec_id", "score", "visited")
