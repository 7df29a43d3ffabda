"""A project's index: tables in versions, a manifest swapped in at the end, a marker while work is under way.

Layout below ``<root>/.quarry``: ``config.toml``, ``manifest.json`` (the current version and what it holds),
``v<N>/<table>`` as Parquet.  A run writes a whole new version and then replaces the manifest, so a run that dies
leaves the last version in force; the marker it leaves makes the next run a full one.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.config import Config

DIR, MANIFEST, MARKER, CONFIG = ".quarry", "manifest.json", "indexing.dirty", "config.toml"
FORMAT = 1
SCHEMAS = {
    "files": "file_id long, path string, lang string, file_hash binary, size_bytes long, indexed_at long",
    "chunks": "chunk_id long, file_id long, symbol string, kind string, start_line int, end_line int, content_hash binary, content string, parent string",
    "imports": "import_id long, file_id long, ord int, source string, symbol string, alias string, is_default boolean",
    "calls": "call_id long, caller_chunk_id long, callee_name string, line int, column int, is_method boolean, receiver string, resolved_chunk_id long",
    "states": "path string, content_hash binary, mtime long, size long",
    "vectors": "id long, embedding array<float>",
    "postings": "id long, field string, term string, tf int, positions array<int>",
    "lengths": "id long, field string, n int",
    "tombstones": "chunk_id long, deleted_at long",
}


class ProjectError(RuntimeError):
    pass


@dataclass
class Manifest:
    version: int = 0
    format: int = FORMAT
    dimensions: int = 384
    model: str = "bytes-384"
    next_file_id: int = 1
    next_chunk_id: int = 1
    next_call_id: int = 1
    next_import_id: int = 1
    values: dict[str, str] = field(default_factory=dict)


class Project:
    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()
        self.dir = self.root / DIR

    @classmethod
    def init(cls, root: str | Path, profile: str = "default", force: bool = False) -> Project:
        p = cls(root)
        if p.dir.exists() and not force:
            raise ProjectError(f"already initialised: {p.root}")
        p.dir.mkdir(parents=True, exist_ok=True)
        (p.dir / CONFIG).write_text(Config(profile=profile).dump())
        return p

    @classmethod
    def find(cls, start: str | Path) -> Project:
        """The project of a folder or of one above it."""
        at = Path(start).resolve()
        for folder in (at, *at.parents):
            if (folder / DIR).is_dir():
                return cls(folder)
        raise ProjectError(f"no project at or above {at}")

    def config(self) -> Config:
        return Config.load_or_default(self.dir / CONFIG)

    def manifest(self) -> Manifest:
        at = self.dir / MANIFEST
        if not at.is_file():
            return Manifest()
        m = Manifest(**json.loads(at.read_text()))
        if m.format != FORMAT:
            raise ProjectError(f"index format {m.format} is not {FORMAT}")
        return m

    def commit(self, manifest: Manifest) -> None:
        """The new version takes force at once; versions before the last two go."""
        part = self.dir / (MANIFEST + ".tmp")
        part.write_text(json.dumps(vars(manifest), indent=1))
        os.replace(part, self.dir / MANIFEST)
        for old in self.dir.glob("v*"):
            if old.name[1:].isdigit() and int(old.name[1:]) < manifest.version - 1:
                shutil.rmtree(old)

    def table(self, spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
        at = self.dir / f"v{self.manifest().version if version is None else version}" / name
        if not at.is_dir():
            return spark.createDataFrame([], SCHEMAS[name])
        return spark.read.schema(SCHEMAS[name]).parquet(f"file://{at}")

    def write(self, df: DataFrame, name: str, version: int) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        out = df.select(*columns)
        if name == "postings":  # a query's terms prune row groups
            out = out.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        out.write.mode("overwrite").parquet(f"file://{self.dir}/v{version}/{name}")

    def dirty(self) -> bool:
        return (self.dir / MARKER).exists()

    def begin(self) -> None:
        (self.dir / MARKER).write_text("")

    def end(self) -> None:
        (self.dir / MARKER).unlink(missing_ok=True)

    def clean(self) -> None:
        """Everything but the configuration goes."""
        for entry in self.dir.iterdir():
            if entry.name != CONFIG:
                shutil.rmtree(entry) if entry.is_dir() else entry.unlink()

    def status(self, spark: SparkSession) -> DataFrame:
        """``file_count, chunk_count, tombstone_count, lexical_docs, vectors, verdict``."""
        from quarry.operators import changes

        counts = changes.counts(self.table(spark, "files"), self.table(spark, "chunks"), self.table(spark, "tombstones"))
        lexical = self.table(spark, "lengths").agg(F.countDistinct("id").alias("lexical_docs"))
        vectors = self.table(spark, "vectors").agg(F.count("*").alias("vectors"))
        out = counts.join(lexical).join(vectors)
        return out.withColumn("verdict", changes.consistency(F.col("chunk_count"), F.col("lexical_docs"), F.col("vectors"), F.lit(self.dirty())))
