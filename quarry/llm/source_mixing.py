"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight, from a hash of the document, so a
rerun draws alike.  Within a source, documents in ascending key are prefix-summed to the token
budget.  A target of several times its source takes complete epochs first; only the remainder is sampled.
A document at the budget's edge is taken if that brings the sum nearer.

Targets: the sources, by code point and null last, weigh 1, 2, 3, repeating, and share the sum of all
sizes; a target stops at ``limit`` times its source, the excess is shared anew by weight.  A source may
hold any share of the rows: prefix sums run over ranges of (source, key), not over one group.

Defined results: a null text has size 0; a source without words has target 0 and takes nothing; repeated rows
are documents of their own with equal keys; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, running_sum, small_enough

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of letters among what is no white space, squared."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    share = F.when(solid > 0, letters / solid).otherwise(F.lit(0.0))
    return F.greatest(F.coalesce(share * share, F.lit(0.0)), F.lit(0.05))


def exponential_key(weight: Column, *parts: Column | str, seed: int = 11) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of ``parts``."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _number_sources(ws: Workspace, sources: DataFrame) -> DataFrame:
    """``sources`` with ``weight``: 1, 2, 3, repeating in the order of code points, null last."""
    ranked = running_sum(ws, sources.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), "__all", [F.col("source").asc_nulls_last()], "__one", "__rank")
    return ranked.select("source", "source_size", (F.col("__rank") % 3 + 1).cast("double").alias("weight"))


def targets(ws: Workspace, sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The level rises until no target is above ``limit`` times its source; every turn is one sum over the sources.
    """
    named = ws.table(_number_sources(ws, sources), "weights")
    cap = limit * F.col("source_size")
    level = 0.0
    total = float(named.agg(F.sum("source_size")).first()[0] or 0)
    while total:
        full = cap <= level * F.col("weight")
        capped, weight = named.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        now = (total - (capped or 0.0)) / weight
        if now <= level:
            break
        level = now
    return named.select("source", "source_size", F.least(cap, level * F.col("weight")).alias("target"))


def mix(spark: SparkSession, documents: DataFrame, columns: list[str] = []) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row, and the named further columns."""
    ws = Workspace(spark, "mixing")
    sized = ws.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            exponential_key(quality_weight(F.col("text")), "doc_id", "text").alias("key"), *columns,
        ),
        "sizes",
    )
    sources = ws.table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = ws.table(targets(ws, sources), "targets").withColumnRenamed("source", "__source")
    goal = F.broadcast(goal) if small_enough(spark, sources.count(), 64) else goal
    summed = running_sum(ws, sized, "source", [F.col("key"), F.col("doc_id").asc_nulls_first()], "size", "before")
    joined = summed.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("source_size") > 0) & (F.col("before") + F.col("size") / 2 <= rest) & (rest > 0)
    out = joined.withColumn("epochs", epochs).withColumn("copies", (F.col("epochs") + chosen.cast("int")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *columns)


def repeat_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``documents``, all columns, each row as often as the mix takes it.

    Copies of one id with one text are interchangeable, so rows find their number by (id, hash of the text):
    the copies of equal rows are summed and dealt evenly, the remainder to as many of them.
    """
    ws = Workspace(spark, "mixing-docs")
    mark = F.xxhash64("doc_id", "source", "text")
    mixed = mix(spark, documents.withColumn("__mark", mark), ["__mark"])
    wanted = mixed.groupBy("__mark").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    wanted = ws.table(wanted.withColumnRenamed("__mark", "__m"), "copies")
    # whatever the size, the numbers are what is hashed, and the documents stream past them unsorted
    kept = documents.withColumn("__mark", mark).join(wanted.hint("shuffle_hash"), F.col("__mark") == F.col("__m"))
    single = kept.where("__rows = 1").withColumn("__n", F.col("__copies"))
    order = Window.partitionBy("__m").orderBy("__m")
    several = kept.where("__rows > 1").withColumn("__i", F.row_number().over(order)).withColumn("__n", F.expr("__copies div __rows + int(__i <= __copies % __rows)")).drop("__i")
    each = single.unionByName(several).where("__n > 0")
    return each.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*(F.col(f"`{c}`") for c in documents.columns))
