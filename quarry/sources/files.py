"""Source trees as tables: listing by metadata, reading and decoding."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P

#: Of the project itself, read as one more ignore file.
IGNORE_FILE = ".quarryignore"
MAX_BYTES = 1 << 20

READ, SKIPPED, FAILED = "read", "skipped", "failed"
TOO_LARGE, BINARY, INVALID_UTF8, UNSUPPORTED = "too_large", "binary", "invalid_utf8", "unsupported_language"


@dataclass(frozen=True)
class WalkOptions:
    """``exclude`` holds further patterns (a leading ``!`` is tolerated), ``include`` takes paths back in."""

    hidden: bool = False
    use_gitignore: bool = True
    use_ignore_file: bool = True
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    max_bytes: int = MAX_BYTES
    lossy: bool = True
    supported_only: bool = True
    patterns: tuple[str, ...] = field(default=())


def _lines(at: str) -> list[str]:
    if not os.path.isfile(at):
        return []
    with open(at, encoding="utf-8", errors="replace") as f:
        return f.read().splitlines()


def ignore_files(root: str, folders: DataFrame, names: list[str]) -> list[tuple[str, str, str]]:
    """(folder, name, text) of the ignore files of ``folders(folder)``; read where the tasks run, so only these texts travel."""
    from pyspark.sql.types import StringType, StructField, StructType

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                at = [f"{base.rstrip('/')}/{folder + '/' if folder else ''}{n}" for n in names]
                for name, info in zip(names, system.get_file_info(at)):
                    if info.type == fs.FileType.File:
                        with system.open_input_stream(info.path) as f:
                            rows.append((folder, name, f.read().decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["folder", "name", "text"])

    schema = StructType([StructField(n, StringType()) for n in ("folder", "name", "text")])
    return [tuple(r) for r in folders.mapInArrow(read, schema).collect()]


def _placed(folder: str, line: str) -> str | None:
    """A pattern of an ignore file as one of the root's: it holds below the file's folder."""
    text = line.strip()
    if not text or text.startswith("#") or not folder:
        return text or None
    back, body = text.startswith("!"), text.removeprefix("!")
    anchored = "/" in body.rstrip("/")
    return f"{'!' if back else ''}/{folder}/{body.lstrip('/') if anchored else '**/' + body}"


def _patterns(root: str, options: WalkOptions, paths: DataFrame) -> list[str]:
    """All patterns, those that decide later: the user's, the repository's, the folders' from the top down, and the options'."""
    local, out = root.removeprefix("file://"), []
    if options.use_gitignore:
        home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        out += _lines(os.path.join(home, "git/ignore")) + _lines(os.path.join(local, ".git/info/exclude"))
        folder = P.dirname(F.col("path"))
        parts = F.split(folder, "/", -1)
        above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        found = ignore_files(root, paths.select(F.explode(above).alias("folder")).distinct(), [".gitignore"])
        for folder, _, text in sorted(found, key=lambda f: (f[0].count("/") + (f[0] != ""), f[0])):
            out += [p for p in (_placed(folder, line) for line in text.splitlines()) if p]
    if options.use_ignore_file:
        out += _lines(os.path.join(local, IGNORE_FILE))
    return out + [p.removeprefix("!") for p in options.exclude] + [f"!{p}" for p in options.include] + list(options.patterns)


def listing(spark: SparkSession, root: str, options: WalkOptions = WalkOptions()) -> DataFrame:
    """``path, language, size, mtime`` of the files below ``root``; no content is read.

    Paths are relative, with forward slashes; ``mtime`` in unix seconds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    found = files.select(P.relative_to(root, F.col("path")).alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))
    found = found.withColumn("language", P.language(F.col("path"))).where(F.col("size") <= options.max_bytes)
    found = found.where(~P.default_excluded(F.col("path")) & ~P.ignored(F.col("path"), _patterns(root, options, found.select("path"))) & P.extension_filter(F.col("path"), list(options.extensions)))
    if not options.hidden:
        found = found.where(~F.col("path").rlike(r"(?:^|/)\."))
    if options.supported_only:
        found = found.where(F.col("language").isNotNull())
    return found.select("path", "language", "size", "mtime")


def contents(spark: SparkSession, root: str, wanted: DataFrame, options: WalkOptions = WalkOptions()) -> DataFrame:
    """``path, language, size, mtime, raw`` of the wanted paths; no other file is opened, and one that is gone has no bytes."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for b in batches:
            for at in range(b.num_rows):  # a file at a time: what is held does not depend on their number
                row = b.slice(at, 1)
                raw = None
                info = system.get_file_info(f"{base.rstrip('/')}/{row.column('path')[0].as_py()}")
                if info.type == fs.FileType.File and info.size <= options.max_bytes:
                    with system.open_input_stream(info.path) as f:
                        raw = f.read()
                if info.type == fs.FileType.File and raw is None:
                    continue  # grown beyond the limit since it was listed
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw], pa.binary())], [*b.schema.names, "raw"])

    listed = wanted.select("path", *(c for c in wanted.columns if c != "path"))
    return listed.mapInArrow(read, StructType([*listed.schema.fields, StructField("raw", BinaryType())]))


def decode(files: DataFrame, lossy: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files(path, language, size, raw)`` with ``status, reason, content, was_lossy``.

    Bytes with a NUL are binary; invalid UTF-8 is read with replacement characters, or skipped if ``lossy`` is off.
    """
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    reason = (
        F.when(F.octet_length("raw") > max_bytes, TOO_LARGE)
        .when(F.contains(F.col("raw"), F.lit(bytearray(b"\0"))), BINARY)
        .when(~valid & F.lit(not lossy), INVALID_UTF8)
        .when(F.col("language").isNull(), UNSUPPORTED)
    )
    out = files.withColumn("reason", F.when(F.col("raw").isNull(), F.lit("unreadable")).otherwise(reason))
    status = F.when(F.col("raw").isNull(), FAILED).when(F.col("reason").isNotNull(), SKIPPED).otherwise(READ)
    text = F.when(F.col("reason").isNull(), F.make_valid_utf8(F.col("raw").cast("string")))
    return out.withColumn("status", status).withColumn("content", text).withColumn("was_lossy", F.col("reason").isNull() & ~valid)
