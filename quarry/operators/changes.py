"""Change detection and maintenance of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.numbering import number


def detect(current: DataFrame, tracked: DataFrame, key: str = "path") -> DataFrame:
    """``key, change`` of files added, modified or deleted between two snapshots ``(key, mtime, size, content_hash)``.

    A file with the tracked time and size is unchanged, whatever its hash.
    """
    old = tracked.select(F.col(key).alias("__key"), F.col("mtime").alias("__mtime"), F.col("size").alias("__size"), F.col("content_hash").alias("__hash"))
    both = current.join(old, F.col(key) == F.col("__key"), "full_outer")
    touched = ~(F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("size").eqNullSafe(F.col("__size")))
    change = (
        F.when(F.col("__key").isNull(), F.lit("added"))
        .when(F.col(key).isNull(), F.lit("deleted"))
        .when(touched & ~F.col("content_hash").eqNullSafe(F.col("__hash")), F.lit("modified"))
    )
    return both.select(F.coalesce(F.col(key), F.col("__key")).alias(key), change.alias("change")).where("change is not null")


def touched(listing: DataFrame, tracked: DataFrame, key: str = "path") -> DataFrame:
    """The rows of a listing whose content must be read: new ones and those of another time or size."""
    same = tracked.select(key, "mtime", "size")
    return listing.join(same, [key, "mtime", "size"], "left_anti")


def to_index(changes: DataFrame, key: str = "path") -> DataFrame:
    return changes.where(F.col("change").isin("added", "modified")).select(key)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def assign_ids(old: DataFrame, new: DataFrame, key: str, id_column: str, after: int) -> DataFrame:
    """``new`` with the id of ``old`` for known keys, and ids above ``after``, in key order, for the others.

    Ids are never used again: ``after`` is the largest ever given.
    """
    known = new.join(old.select(key, id_column), key)
    fresh = new.join(old.select(key), key, "left_anti")
    return known.unionByName(number(fresh, [key], id_column, after + 1))


def delete_files(files: DataFrame, chunks: DataFrame, tombstones: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, tombstones) without the files of ``gone(path)``; their chunks become tombstones, each once."""
    dead_files = files.join(gone.select("path").distinct(), "path", "left_semi")
    dead = chunks.join(dead_files.select("file_id"), "file_id", "left_semi")
    return (
        files.join(gone.select("path").distinct(), "path", "left_anti"),
        chunks.join(dead_files.select("file_id"), "file_id", "left_anti"),
        bury(tombstones, dead, now),
    )


def bury(tombstones: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """With a tombstone for each chunk that has none."""
    new = chunks.select("chunk_id").distinct().join(tombstones.select("chunk_id"), "chunk_id", "left_anti")
    return tombstones.unionByName(new.select("chunk_id", now.cast("long").alias("deleted_at")))


def live(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    return chunks.join(tombstones.select("chunk_id"), "chunk_id", "left_anti")


def counts(files: DataFrame, chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: ``file_count, chunk_count, tombstone_count``."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "file_count").join(one(chunks, "chunk_count")).join(one(tombstones, "tombstone_count"))


def consistency(chunk_count: Column, lexical: Column, vectors: Column, dirty: Column) -> Column:
    """``dirty``, ``lexical``, ``vectors`` or ``ok``: vectors count only where there are any."""
    return F.when(dirty, "dirty").when(lexical != chunk_count, "lexical").when((vectors > 0) & (vectors != chunk_count), "vectors").otherwise("ok")
