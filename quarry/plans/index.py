"""Building and updating a project's index."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import content_hash
from quarry.operators import changes, embedding, lexical, parsing, resolve
from quarry.operators.vector import VectorIndex
from quarry.plans.numbering import number
from quarry.plans.project import Project, ProjectError
from quarry.plans.search import SearchEngine
from quarry.sources import files as sources
from quarry.sources.config import ModelRegistry


def walk_options(project: Project) -> sources.WalkOptions:
    c = project.config().index
    return sources.WalkOptions(use_gitignore=c.respect_gitignore, exclude=tuple(c.exclude), extensions=tuple(c.extensions), max_bytes=c.max_file_size, lossy=c.lossy_utf8)


def index(spark: SparkSession, project: Project, full: bool = False, registry: ModelRegistry | None = None, now: int | None = None) -> dict[str, int]:
    """Bring the index up to date; returns what was done.

    Unchanged files are told by time and size, then by hash.  All tables of a new version are written before the manifest
    is replaced; calls are resolved last, over all files.
    """
    now = int(time.time()) if now is None else now
    registry = registry or ModelRegistry()
    model = registry.get(project.config().model) or registry.default_model()
    manifest = project.manifest()
    full = full or project.dirty() or manifest.version == 0
    if not full and manifest.dimensions != model.dimensions:
        raise ProjectError(f"the index has {manifest.dimensions} dimensions, the model {model.dimensions}; index all")
    options = walk_options(project)
    old = {n: (spark.createDataFrame([], project.table(spark, n).schema) if full else project.table(spark, n)) for n in ("files", "chunks", "imports", "calls", "states", "vectors", "postings", "lengths", "tombstones")}
    found = sources.listing(spark, str(project.root), options)
    candidates = changes.touched(found, old["states"].select("path", "mtime", "size"))
    decoded = sources.decode(sources.contents(spark, str(project.root), candidates, options), options.lossy, options.max_bytes)
    decoded = decoded.withColumn("content_hash", content_hash(F.col("raw"))).drop("raw").persist()
    same = decoded.join(old["states"].select("path", F.col("content_hash").alias("__old")), "path", "left").where(F.col("content_hash").eqNullSafe(F.col("__old"))).select("path")
    fresh = decoded.join(same, "path", "left_anti").persist()
    gone = old["files"].select("path").join(found.select("path"), "path", "left_anti").persist()
    tally = {r["status"]: r["count"] for r in fresh.groupBy("status").count().collect()}
    deleted = gone.count()
    if not full and not tally and not deleted:
        for df in (decoded, fresh, gone):  # a kept plan would answer the next run
            df.unpersist()
        return {"indexed": 0, "skipped": 0, "failed": 0, "deleted": 0, "chunks": 0}
    project.begin()
    version = manifest.version + 1
    readable = fresh.where(F.col("status") == sources.READ)
    parsed = parsing.parse_files(readable).persist()
    # files: known paths keep their id, ids are never given twice
    placed = changes.assign_ids(old["files"], readable.select("path", "language", "size", "content_hash"), "path", "file_id", manifest.next_file_id - 1)
    new_files = placed.select("file_id", "path", F.col("language").alias("lang"), F.col("content_hash").alias("file_hash"), F.col("size").alias("size_bytes"), F.lit(now).cast("long").alias("indexed_at")).persist()
    replaced = old["files"].join(new_files.select("path").unionByName(gone), "path", "left_semi").select("file_id").persist()
    ids = new_files.select("file_id", "path")
    new_chunks = number(parsing.chunks(readable, parsed).join(ids, "path"), ["path", "start_line", "ord"], "chunk_id", manifest.next_chunk_id).withColumn("content_hash", content_hash(F.col("content"))).persist()
    new_calls = number(new_chunks.select("chunk_id", F.posexplode("calls").alias("n", "c")).select(F.col("chunk_id").alias("caller_chunk_id"), "n", "c.*"), ["caller_chunk_id", "n"], "call_id", manifest.next_call_id)
    new_imports = number(parsing.imports(parsed).join(ids, "path"), ["path", "ord"], "import_id", manifest.next_import_id)
    dead = old["chunks"].join(replaced, "file_id", "left_semi").select("chunk_id").persist()
    keep = lambda df, key: df.join(dead.select(F.col("chunk_id").alias(key)), key, "left_anti")
    columns = lambda df, like: df.select(*old[like].columns)
    new_calls = new_calls.withColumn("resolved_chunk_id", F.lit(None).cast("long"))
    lex = lexical.Index.build(new_chunks, "chunk_id", {"content": F.col("content"), "symbol": F.col("symbol"), "kind": F.col("kind"), "file": F.col("path")})
    put = {
        "files": old["files"].join(replaced, "file_id", "left_anti").unionByName(new_files),
        "chunks": keep(old["chunks"], "chunk_id").unionByName(columns(new_chunks, "chunks")),
        "imports": old["imports"].join(replaced, "file_id", "left_anti").unionByName(columns(new_imports, "imports")),
        "vectors": keep(old["vectors"], "id").unionByName(embedding.embed_column(new_chunks, "chunk_id", "content", model)),
        "postings": keep(old["postings"], "id").unionByName(lex.postings),
        "lengths": keep(old["lengths"], "id").unionByName(lex.lengths),
        # what is dead is left out of every table above, so tombstones need no keeping
        "tombstones": old["tombstones"].limit(0),
    }
    for name, df in put.items():
        project.write(df, name, version)
    t = lambda name: project.table(spark, name, version)
    calls = keep(old["calls"], "caller_chunk_id").unionByName(columns(new_calls, "calls"))
    project.write(resolve.resolve(calls, t("files"), t("chunks"), t("imports")), "calls", version)
    states = fresh.select("path", "content_hash", "mtime", "size").unionByName(decoded.join(same, "path", "left_semi").select("path", "content_hash", "mtime", "size"))
    project.write(changes.upsert(old["states"].join(gone, "path", "left_anti"), states, "path"), "states", version)
    top = lambda df, key, least: max(least, (df.agg(F.max(key)).first()[0] or 0) + 1)
    done = {"indexed": tally.get(sources.READ, 0), "skipped": tally.get(sources.SKIPPED, 0), "failed": tally.get(sources.FAILED, 0), "deleted": deleted, "chunks": new_chunks.count()}
    project.commit(
        replace(
            manifest, version=version, dimensions=model.dimensions, model=model.model_id, next_file_id=top(t("files"), "file_id", manifest.next_file_id), next_chunk_id=top(t("chunks"), "chunk_id", manifest.next_chunk_id),
            next_call_id=top(t("calls"), "call_id", manifest.next_call_id), next_import_id=top(t("imports"), "import_id", manifest.next_import_id),
        )
    )
    project.end()
    for df in (decoded, fresh, gone, parsed, new_files, replaced, new_chunks, dead):
        df.unpersist()
    return done


def open_engine(spark: SparkSession, project: Project) -> SearchEngine:
    """The search engine over a project's current version."""
    m = project.manifest()
    if m.version == 0:
        raise ProjectError("nothing is indexed yet")
    t = lambda name: project.table(spark, name)
    return SearchEngine(lexical.Index(t("postings"), t("lengths")), VectorIndex(t("vectors"), m.dimensions), t("chunks"), t("files"))
