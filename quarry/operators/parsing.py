"""Parsing sources in bulk: one Python pass over files, with nested results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import parsers
from quarry.functions import text as T
from quarry.operators import chunking

CALL = "struct<callee_name:string,line:int,column:int,is_method:boolean,receiver:string>"
CHUNK = f"struct<ord:int,symbol:string,kind:string,start_line:int,end_line:int,content:string,parent:string,calls:array<{CALL}>>"
IMPORT = "struct<ord:int,source:string,symbol:string,alias:string,is_default:boolean>"
_SCHEMA = f"path string, chunks array<{CHUNK}>, imports array<{IMPORT}>, calls array<{CALL}>"
_CALL = pa.struct([("callee_name", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("is_method", pa.bool_()), ("receiver", pa.string())])
_CHUNK = pa.struct([("ord", pa.int32()), ("symbol", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("parent", pa.string()), ("calls", pa.list_(_CALL))])
_IMPORT = pa.struct([("ord", pa.int32()), ("source", pa.string()), ("symbol", pa.string()), ("alias", pa.string()), ("is_default", pa.bool_())])


def parse_files(files: DataFrame) -> DataFrame:
    """``path, chunks, imports, calls`` of ``files(path, language, content)``."""

    def run(batches):
        for b in batches:
            chunks, imports, calls = [], [], []
            for text, language in zip(b.column("content").to_pylist(), b.column("language").to_pylist()):
                p = parsers.parse(text or "", language)
                chunks.append([{"ord": i, **vars(c), "calls": [vars(x) for x in c.calls]} for i, c in enumerate(p.chunks)])
                imports.append([{"ord": i, **vars(x)} for i, x in enumerate(p.imports)])
                calls.append([vars(x) for x in p.calls])
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(chunks, pa.list_(_CHUNK)), pa.array(imports, pa.list_(_IMPORT)), pa.array(calls, pa.list_(_CALL))], ["path", "chunks", "imports", "calls"])

    return files.select("path", "language", "content").mapInArrow(run, _SCHEMA)


def chunks(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``path, ord, symbol, kind, start_line, end_line, content, parent, calls``: parsed chunks, or line windows where there are none.

    The first window of a file carries the calls of the whole file.
    """
    names = ["ord", "symbol", "kind", "start_line", "end_line", "content", "parent", "calls"]
    found = parsed.select("path", F.explode("chunks").alias("c")).select("path", *(F.col(f"c.{n}").alias(n) for n in names))
    found = found.withColumn("content", T.normalize_content(F.col("content")))
    bare = files.select("path", "content").join(parsed.where(F.size("chunks") == 0).select("path", F.col("calls").alias("__calls")), "path")
    windows = chunking.line_windows(bare)
    first = F.col("start_line") == 1
    rest = windows.select(
        "path", F.floor((F.col("start_line") - 1) / (chunking.WINDOW - chunking.OVERLAP)).cast("int").alias("ord"), "symbol", "kind", "start_line", "end_line", "content",
        F.lit(None).cast("string").alias("parent"), F.when(first, F.col("__calls")).otherwise(F.array().cast(f"array<{CALL}>")).alias("calls"),
    )
    return found.unionByName(rest)


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("imports"))
