"""Consecutive numbers over rows of any count, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.scratch import settle

_ROWS = (1 << 33) - 1


def number(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: numbers from ``first`` on, in the order given.

    Rows are dealt by range and sorted within; a row's number is its place in its range plus what the ranges
    before hold.  Only the counts of the ranges reach the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = settle(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], first
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    base = F.element_at(F.array(*map(F.lit, starts)), (part + 1).cast("int")) if starts else F.lit(first)
    return dealt.withColumn(name, (base + F.col("__at").bitwiseAND(F.lit(_ROWS))).cast("long")).drop("__at")
