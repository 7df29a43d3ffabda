"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

A fingerprint has a bit set if more than half of the shingle hashes (XXH64, seed 42) have it.  Two
fingerprints link if they differ in at most ``radius`` bits; a component is what links join.

Scale.  Equal fingerprints are one node, so a group of copies of any size costs one row.  Each
fingerprint enters ``radius + 1`` shards, named by the value of one of as many bit blocks; two that
link must agree on a whole block, so each link is found inside a shard.  A shard is a BK-tree: children
are keyed by their integer Hamming distance to the parent, and a search follows only the edges
within the radius of the distance at hand.  Trees of all documents have no bound that
would let them be broadcast, nor may all fingerprints meet on the driver, so the shards travel by shuffle in place of a broadcast.
A shard of more than ``SPLIT`` fingerprints is cut into trees of at most about as many: a fingerprint enters one of them and
searches it and those after it.  What many rows share, a fingerprint of over ``HOT`` rows, is joined by broadcast, as there are few.

Defined results: null and wordless texts have fingerprint zero and link like any other; repeated rows
are returned as often as they come; a null ``doc_id`` never names a component that has another id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quarry.llm.runtime import Workspace, connected_components, small_enough

_SLAB = 1 << 15
SPLIT = 1 << 15
HOT = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _SLAB):
        part = np.array(hashes[lo : lo + _SLAB], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, width: int = 3, mark: Column | None = None) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) and ``mark`` (a long, zero if none is given) of every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), b.column("mark")], ["doc_id", "fp", "mark"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", (F.lit(0).cast("long") if mark is None else mark).alias("mark"))
    return rows.mapInArrow(run, "doc_id long, fp long, mark long")


class BKTree:
    """Distinct integers; children hang on edges labelled with their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """The stored values within ``radius`` of ``value``."""
        found, values, edges = [], self.values, self.edges
        stack = [0] if values else []
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(values[node])
            for edge, child in edges[node].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)
        return found

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """The stored values within ``radius`` of ``value``, which is then stored."""
        found, values, edges, at, new = self.near(value, radius), self.values, self.edges, 0, len(self.values)
        values.append(value)
        edges.append({})
        while new:  # descend to the free edge
            d = (values[at] ^ value).bit_count()
            if d not in edges[at]:
                edges[at][d] = new
                break
            at = edges[at][d]
        return found


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the ``radius + 1`` blocks of a fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def links(ws: Workspace, distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: the pairs of distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits."""
    parts = blocks(radius)
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for i, (lo, bits) in enumerate(parts)))
    shards = distinct.select("fp", F.explode(keys).alias("k")).select("k.block", "k.value", "fp")
    large = shards.groupBy("block", "value").count().where(F.col("count") > SPLIT).select("block", "value", F.ceil(F.col("count") / SPLIT).cast("int").alias("trees"))
    large = ws.table(large, "large")  # at most (radius + 1) / SPLIT of the fingerprints
    shards = shards.join(F.broadcast(large) if small_enough(ws.spark, large.count(), 24) else large, ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("trees", F.lit(1)).cast("long")).cast("int")
    visits = F.transform(F.sequence(own, F.coalesce(F.col("trees") - 1, F.lit(0))), lambda t: F.struct(t.alias("tree"), (t != own).cast("int").alias("visit")))
    shards = shards.select("block", "value", "fp", F.explode(visits).alias("t")).select("block", "value", "t.tree", "t.visit", "fp")

    def search(batches):
        key, tree = None, BKTree()
        for b in batches:
            a, c = [], []
            for block, value, part, visit, fp in zip(*(b.column(n).to_numpy().tolist() for n in ("block", "value", "tree", "visit", "fp"))):
                if (block, value, part) != key:
                    key, tree = (block, value, part), BKTree()
                u = fp & 0xFFFFFFFFFFFFFFFF
                for v in tree.near(u, radius) if visit else tree.near_then_add(u, radius):
                    # a pair that agrees on an earlier block too is reported there
                    if all((u ^ v) >> lo & ((1 << bits) - 1) for lo, bits in parts[:block]):
                        a.append(fp)
                        c.append(v - (1 << 64) if v >> 63 else v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "block", "value", "tree").sortWithinPartitions("block", "value", "tree", "visit", "fp").mapInArrow(search, "a long, b long")


def _linked(ws: Workspace, rows: DataFrame, order: Column, radius: int) -> DataFrame:
    """``fp, first, component`` of every fingerprint: the least ``order`` among its rows, and what links join."""
    nodes = ws.table(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("rows")), "nodes")
    roots = connected_components(ws, ws.table(links(ws, nodes.select("fp"), radius), "links"))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return ws.table(named.select("fp", "first", "component", "rows"), "named")


def components(spark: SparkSession, documents: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``documents``."""
    ws = Workspace(spark, "simhash")
    fps = ws.table(fingerprints(documents, width).drop("mark"), "fingerprints")
    named = _linked(ws, fps, F.col("doc_id"), radius)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = ws.table(named.join(smallest, "component").select("fp", "component_id", "rows"), "by_fp")
    hot = by_fp.where(F.col("rows") > HOT).select(F.col("fp").alias("hot"), F.col("component_id").alias("its"))  # at most one for every HOT rows
    hot = F.broadcast(hot) if small_enough(spark, hot.count(), 16) else hot
    marked = fps.join(hot, F.col("fp") == F.col("hot"), "left")
    cold = marked.where("hot is null").select("doc_id", "fp").join(by_fp, "fp").select("doc_id", "fp", "component_id")
    every = cold.unionByName(marked.where("hot is not null").select("doc_id", "fp", F.col("its").alias("component_id")))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mark(documents: DataFrame) -> Column:
    """Tells rows that share a ``doc_id`` apart: a hash of their plain columns, and of whether there is a text, as nulls are skipped."""
    return F.xxhash64(F.col("text").isNull(), *(F.col(f"`{f.name}`") for f in documents.schema if isinstance(f.dataType, AtomicType)))


def keep_first(spark: SparkSession, documents: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row of each component, all columns: that of the smallest ``doc_id``, a null one last.

    A row is known by its ``doc_id`` and a hash of the row, as ids may be null or shared by different
    texts; of rows that repeat each other one stays.
    """
    ws = Workspace(spark, "simhash-keep")
    fps = ws.table(fingerprints(documents, width, _mark(documents)).groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "n")
    firsts = _linked(ws, fps, order, radius).groupBy("component").agg(F.min("first").alias("first"))
    firsts = ws.table(firsts.select(F.col("first.doc_id").alias("__first"), F.col("first.mark").alias("__row"), F.col("first.n").alias("__n")), "firsts")
    marked = documents.withColumn("__mark", _mark(documents))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__first")) & (F.col("__mark") == F.col("__row"))
    # whatever the size, the ids are what is hashed, and the documents stream past them unsorted
    single = marked.join(firsts.where("__n = 1").hint("shuffle_hash"), same, "left_semi")
    several = marked.join(firsts.where("__n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__mark"])
    return single.unionByName(several).drop("__mark")
