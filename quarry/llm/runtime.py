"""Shared plumbing of the training-data operators: written tables, file access, components, ordered sums.

Intermediate results live as tables in the folder that ``spark.checkpoint.dir`` names, so that they
outlive any executor.  Only where that setting is absent *and* the master is local is a temporary
folder of the machine used.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS = 1024
#: Rows of one node of a graph beyond which it is no matter of a single task.
HUB = 1 << 16

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only on a local master without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _LOCAL_DIR[0]


class Workspace:
    """A folder of written tables below the shared folder, removed when the JVM ends or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        self.root = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
        self._path(self.root)[1].deleteOnExit(self._path(self.root)[0])
        self._n = 0

    def _path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the written files."""
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._quarry_path = where
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete written tables that no later plan reads."""
        for t in tables:
            where = t if isinstance(t, str) else getattr(t, "_quarry_path", None)
            if where:
                path, fs = self._path(where)
                fs.delete(path, True)


def by_bytes(batches, column: str, limit: int = 8 << 20):
    """Arrow batches joined until the strings of ``column`` fill ``limit`` bytes: what is held does not depend on the number of rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def files(uri: str):
    """(file system, path) of pyarrow for a URI; used by tasks that write or read whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_once(uri: str, data: bytes) -> None:
    """Write a whole file so that a repeated or speculative task leaves one complete copy."""
    system, path = files(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def small_enough(spark: SparkSession, rows: int, row_bytes: int, limit: int = 8 << 20) -> bool:
    """Whether a side of so many counted rows may be broadcast."""
    return rows * row_bytes <= limit


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph ``edges(a long, b long)`` -> ``(node, component)``.

    Alternates the large-star and small-star steps until a step changes nothing; every step is a
    grouped minimum and a join, written as a table, so the driver sees only two numbers per round.
    ``component`` is the smallest node id reachable.  Nodes without an edge are not returned.
    """

    def largest_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def with_low(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
        """``rows`` of ``a, b`` with their ``m``; hubs, of more than ``HUB`` rows, meet it by broadcast and not in one task."""
        if n <= HUB or not small_enough(ws.spark, -(-n // HUB), 16):
            return rows.join(low.drop("rows"), "a")
        hubs = F.broadcast(low.where(F.col("rows") > HUB).select(F.col("a").alias("h"), F.col("m").alias("hm")))  # at most n / HUB rows
        met = rows.join(hubs, F.col("a") == F.col("h"), "left")
        plain = met.where("h is null").select("a", "b").join(low.where(F.col("rows") <= HUB).drop("rows"), "a")
        return plain.union(met.where("h is not null").select("a", "b", F.col("hm").alias("m")))

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
        return largest_first(with_low(both, low, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame, n: int) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        moved = with_low(e, low, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = low.drop("rows")
        return largest_first(moved.union(low.select("a", F.col("m").alias("b"))))

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["x"]

    e = ws.table(largest_first(edges), "edges")
    seen = mark(e)
    while seen[0]:
        after = ws.table(small(large(e, seen[0]), seen[0]), "stars")
        now = mark(after)
        ws.drop(e)
        e = after
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def running_sum(ws: Workspace, df: DataFrame, group: str, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``group`` in the given order.

    A group may hold any share of the rows: rows are dealt by range of (group, order), summed per
    (range, group), and only those sums, at most ranges + groups of them, are added up across ranges.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = ws.table(df.repartitionByRange(n, F.col(group).asc_nulls_last(), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__range", group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("__range").alias("__r"), F.col(group).alias("__g"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(base, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.col("__base") + F.col("__in")).drop("__range", "__r", "__g", "__base", "__in")
