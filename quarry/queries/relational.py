"""Queries over maintenance and joins: change detection, merges, tombstones, counts, caller and callee joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import changes
from quarry.queries import corpus as C

_FROM, _UNTIL_A, _UNTIL_B = "2024-01-02", "2024-01-03", "2024-01-04"


def snapshot(spark: SparkSession, sf_dir: str, after: str | None, before: str) -> DataFrame:
    """``path, mtime, size, content_hash``: the latest event of each user and type in a span, as a file."""
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    events = C.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).where(F.col("ts") < at(before))
    events = events if after is None else events.where(F.col("ts") >= at(after))
    latest = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("e"))
    return latest.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.timestamp_diff("SECOND", at("1970-01-01"), F.col("e.ts")).alias("mtime"), F.length(F.col("e.event_id").cast("string")).cast("long").alias("size"), F.col("e.event_id").alias("content_hash"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return snapshot(spark, sf_dir, None, _UNTIL_A), snapshot(spark, sf_dir, _FROM, _UNTIL_B)


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.detect(new, old)


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_detect(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


def files_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.touched(new, old).select("path")


def files_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.to_index(change_detect(spark, sf_dir))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files keep their place, changed ones get new state, new ones are added."""
    old, new = _snapshots(spark, sf_dir)
    return changes.upsert(old, new, "path")


def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ids: kept for known paths, fresh and above all given ones, in path order, for new paths."""
    files = C.files(spark, sf_dir)
    old, new = files.where("file_id % 3 <> 0").select("path", "file_id"), files.where("file_id % 2 = 0").select("path")
    after = old.agg(F.max("file_id")).first()[0]
    return changes.assign_ids(old, new, "path", "file_id", after)


_SNAP = "SELECT user_id || '/' || event_type AS path, max_by(event_id, (ts, event_id)) AS content_hash, floor(epoch(max(ts))) AS mtime FROM events WHERE {where} GROUP BY user_id, event_type"
_SNAPS = f"""s AS ({_SNAP.format(where=f"ts < TIMESTAMP '{_UNTIL_A}'")}), t AS ({_SNAP.format(where=f"ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '{_UNTIL_B}'")}),
    a AS (SELECT path, content_hash, CAST(mtime AS BIGINT) AS mtime, length(CAST(content_hash AS VARCHAR)) AS size FROM s),
    b AS (SELECT path, content_hash, CAST(mtime AS BIGINT) AS mtime, length(CAST(content_hash AS VARCHAR)) AS size FROM t)"""
CHANGES_SQL = f"""
    WITH {_SNAPS}, c AS (
        SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
               WHEN (a.mtime <> b.mtime OR a.size <> b.size) AND a.content_hash <> b.content_hash THEN 'modified' END AS change
        FROM b FULL JOIN a ON a.path = b.path)
    SELECT path, change FROM c WHERE change IS NOT NULL
"""


# -- chunks of a file that goes, tombstones, counts -----------------------------------------------------------


def _maintained(spark: SparkSession, sf_dir: str):
    """Files, chunks and tombstones before and after the files of bad labels go; some of their chunks are buried already."""
    files, chunks = C.files(spark, sf_dir).select("file_id", "path"), C.windows(spark, sf_dir).select((F.col("file_id") * 100000 + F.col("start_line")).alias("chunk_id"), "file_id")
    buried = chunks.where("chunk_id % 7 = 0").select("chunk_id", F.lit(1).cast("long").alias("deleted_at"))
    gone = files.join(C.table(spark, sf_dir, "labels").where("quality = 0"), F.col("file_id") == F.col("doc_id"), "left_semi").select("path")
    return files, chunks, buried, gone


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones after the deletion: each chunk once, with its first time."""
    files, chunks, buried, gone = _maintained(spark, sf_dir)
    return changes.delete_files(files, chunks, buried, gone, F.lit(2))[2]


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, buried, _ = _maintained(spark, sf_dir)
    return changes.live(chunks, buried).groupBy("file_id").agg(F.count("*").alias("n"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, buried, gone = _maintained(spark, sf_dir)
    return changes.counts(*changes.delete_files(files, chunks, buried, gone, F.lit(2)))


def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, embeddings and labels of each residue class compared as an index's counts would be."""
    per = lambda t, key, name: C.table(spark, sf_dir, t).groupBy((F.col(key) % 10).alias("part")).agg(F.count("*").alias(name))
    joined = per("documents", "doc_id", "chunks").join(per("orders", "o_orderkey", "lexical"), "part", "left").join(per("embeddings", "vec_id", "vectors"), "part", "left").fillna(0)
    verdict = changes.consistency(F.col("chunks"), F.when(F.col("part") < 6, F.col("chunks")).otherwise(F.col("lexical")), F.when(F.col("part") < 4, F.col("vectors")).otherwise(F.lit(0)), F.col("part") == 2)
    return joined.select("part", verdict.alias("verdict"))


_WINDOW_IDS = f"WITH {C.windows_sql()}, ch AS (SELECT file_id * 100000 + start_line AS chunk_id, file_id FROM windows), bad AS (SELECT doc_id FROM labels WHERE quality = 0)"


# -- joins ---------------------------------------------------------------------------------------------------


def inner_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of many ids with their parents' names: orders, customers, nations."""
    orders, customers, nations = (C.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


def callers_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a set of names with caller and place."""
    files = C.files(spark, sf_dir)
    calls = C.calls(spark, sf_dir).where(F.col("callee_name").isin("the", "of", "und"))
    return calls.join(files, F.col("caller_chunk_id") == F.col("file_id")).select("call_id", "callee_name", F.col("symbol").alias("caller_symbol"), F.col("path").alias("caller_file"), "column")


def callees_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, missing where the part is expensive."""
    parts = C.table(spark, sf_dir, "part").where("p_retailprice < 1200").select("p_partkey", "p_name")
    return C.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_partkey", "p_name")


def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def semi_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are reset for calls of files in the set, others stay."""
    bad = C.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("caller_chunk_id"))
    calls = C.calls(spark, sf_dir).withColumn("target", F.col("caller_chunk_id") % 97)
    return calls.join(bad, "caller_chunk_id", "left_anti").select("call_id", "target").unionByName(calls.join(bad, "caller_chunk_id", "left_semi").select("call_id", F.lit(None).cast("long").alias("target")))


def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered output in path, line, column order, null columns first."""
    from pyspark.sql import Window

    calls = callers_three_way(spark, sf_dir).withColumn("column", F.when(F.col("column") % 3 != 0, F.col("column")))
    order = Window.partitionBy("caller_file").orderBy(F.col("column").asc_nulls_first(), "call_id")
    return calls.select("caller_file", "column", "call_id", F.row_number().over(order).cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    change_detect, change_counts, files_to_read, files_to_index, upsert_latest, assign_ids, delete_cascade, live_chunks, status_counts,
    consistency_check, inner_hydrate, callers_three_way, callees_left, in_list, semi_update, ordered_lookup,
)}
_CALLERS = f"WITH {C.FILES_SQL}, {C.CALLS_SQL} SELECT call_id, callee_name, f.symbol AS caller_symbol, path AS caller_file, \"column\" FROM calls JOIN files f ON f.file_id = caller_chunk_id WHERE callee_name IN ('the', 'of', 'und')"
SQL = {
    "change_detect": CHANGES_SQL,
    "change_counts": f"SELECT change, count(*) AS n FROM ({CHANGES_SQL}) GROUP BY 1",
    "files_to_read": f"WITH {_SNAPS} SELECT path FROM b ANTI JOIN a USING (path, mtime, size)",
    "files_to_index": f"SELECT path FROM ({CHANGES_SQL}) WHERE change <> 'deleted'",
    "upsert_latest": f"WITH {_SNAPS} SELECT path, mtime, size, content_hash FROM b UNION ALL SELECT path, mtime, size, content_hash FROM a ANTI JOIN b USING (path)",
    "assign_ids": f"""
        WITH {C.FILES_SQL}, new AS (SELECT path, file_id FROM files WHERE file_id % 2 = 0), top AS (SELECT max(file_id) AS m FROM files WHERE file_id % 3 <> 0)
        SELECT path, file_id FROM new WHERE file_id % 3 <> 0
        UNION ALL SELECT path, m + row_number() OVER (ORDER BY path) FROM new, top WHERE file_id % 3 = 0""",
    "delete_cascade": f"{_WINDOW_IDS} SELECT chunk_id, CASE WHEN chunk_id % 7 = 0 THEN 1 ELSE 2 END AS deleted_at FROM ch WHERE chunk_id % 7 = 0 OR file_id IN (SELECT doc_id FROM bad)",
    "live_chunks": f"{_WINDOW_IDS} SELECT file_id, count(*) AS n FROM ch WHERE chunk_id % 7 <> 0 GROUP BY 1",
    "status_counts": f"""{_WINDOW_IDS}
        SELECT (SELECT count(*) FROM files WHERE file_id NOT IN (SELECT doc_id FROM bad)) AS file_count, (SELECT count(*) FROM ch WHERE file_id NOT IN (SELECT doc_id FROM bad)) AS chunk_count,
               (SELECT count(*) FROM ch WHERE chunk_id % 7 = 0 OR file_id IN (SELECT doc_id FROM bad)) AS tombstone_count""",
    "consistency_check": """
        WITH d AS (SELECT doc_id % 10 AS part, count(*) AS c FROM documents GROUP BY 1), o AS (SELECT o_orderkey % 10 AS part, count(*) AS l FROM orders GROUP BY 1), e AS (SELECT vec_id % 10 AS part, count(*) AS v FROM embeddings GROUP BY 1)
        SELECT part, CASE WHEN part = 2 THEN 'dirty' WHEN part >= 6 AND coalesce(l, 0) <> c THEN 'lexical' WHEN part < 4 AND coalesce(v, 0) > 0 AND v <> c THEN 'vectors' ELSE 'ok' END AS verdict
        FROM d LEFT JOIN o USING (part) LEFT JOIN e USING (part)""",
    "inner_hydrate": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "callers_three_way": _CALLERS,
    "callees_left": "SELECT l_orderkey, l_partkey, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_retailprice < 1200) ON l_partkey = p_partkey",
    "in_list": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "semi_update": f"WITH {C.FILES_SQL}, {C.CALLS_SQL} SELECT call_id, CASE WHEN caller_chunk_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN NULL ELSE caller_chunk_id % 97 END AS target FROM calls",
    "ordered_lookup": f"""SELECT caller_file, CASE WHEN "column" % 3 <> 0 THEN "column" END AS "column", call_id,
        row_number() OVER (PARTITION BY caller_file ORDER BY CASE WHEN "column" % 3 <> 0 THEN "column" END NULLS FIRST, call_id) AS n FROM ({_CALLERS})""",
}
