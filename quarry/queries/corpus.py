"""The stand-in corpus: the driver's tables read as files, chunks and call sites, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.plans.scratch import scratch

WINDOW, OVERLAP = 10, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "rs").when(F.col("lang") == "fr", "ts").otherwise("go")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.lit("").alias("lang"), T.first_token(F.col("text")).alias("symbol"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document: ``chunk_id, file_id, symbol, kind, start_line, end_line, content``."""
    n = F.size(T.lines(F.col("text")))
    return files(spark, sf_dir).select(F.col("file_id").alias("chunk_id"), "file_id", "symbol", F.lit("function").alias("kind"), F.lit(1).alias("start_line"), n.alias("end_line"), F.col("text").alias("content"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of the documents: ``file_id, path, start_line, end_line, content`` and more."""
    return chunking.line_windows(files(spark, sf_dir).select("file_id", "path", F.col("text").alias("content")), size=WINDOW, overlap=OVERLAP)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: the tokens of all lines of a document, but for the one that opens the first line."""
    return call_sites(files(spark, sf_dir))


def call_sites(texts: DataFrame, *kept: str) -> DataFrame:
    """The call sites of ``texts(file_id, text)``, and the columns to keep."""
    lines = texts.select("file_id", *kept, F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    at = lines.select("file_id", *kept, (F.col("line") + 1).alias("line"), F.posexplode(T.tokens(F.col("words"))).alias("pos", "callee_name")).where("pos > 0 or line > 1")
    return at.select(
        ((F.col("file_id") * 100000 + F.col("line")) * 100000 + F.col("pos")).alias("call_id"), F.col("file_id").alias("caller_chunk_id"), "callee_name", "line",
        F.col("pos").alias("column"), F.lit(False).alias("is_method"), F.lit(None).cast("string").alias("receiver"), *kept,
    )


_BUILT: dict[tuple, str] = {}


def built(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of an index over ``documents``: written when first asked for, and anew where the table has changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, name, status.getModificationTime(), status.getLen())
    if key not in _BUILT:
        where = scratch(spark, name)
        write(where)
        _BUILT[key] = where
    return _BUILT[key]


def no_imports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "import_id long, file_id long, ord int, source string, symbol string, alias string, is_default boolean")


# The same in DuckDB, as the leading part of a WITH clause.
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND length(t) <= 40)"


def tokens_sql(x: str) -> str:
    return TOKENS_SQL.format(x=x)


FILES_SQL = f"""files AS (
    SELECT doc_id AS file_id, 'src/' || source || '/' || doc_id || '.' ||
           CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'rs' WHEN 'fr' THEN 'ts' ELSE 'go' END AS path,
           ({tokens_sql("text")})[1] AS symbol, text
    FROM documents WHERE text IS NOT NULL
)"""
LINES_SQL = "CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) END"


def lines_sql(x: str) -> str:
    return LINES_SQL.format(x=x)


NORMAL_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+\\z', ''), '\\A\\n+', ''), '\\n+\\z', '')"


def normal_sql(x: str) -> str:
    return NORMAL_SQL.format(x=x)


def windows_sql(size: int = WINDOW, overlap: int = OVERLAP) -> str:
    """CTEs ``files, lined, windows(file_id, path, start_line, end_line, content)``."""
    step = size - overlap
    return f"""{FILES_SQL}, lined AS (SELECT file_id, path, {lines_sql("text")} AS lines FROM files),
    windows AS (
        SELECT file_id, path, s + 1 AS start_line, least(s + {size}, n) AS end_line,
               {normal_sql(f"array_to_string(lines[s + 1 : s + {size}], chr(10))")} AS content
        FROM (SELECT *, len(lines) AS n, unnest(list_transform(generate_series(0, CASE WHEN len(lines) <= {size} THEN 0 ELSE CAST(ceil((len(lines) - {size}) / {step}.0) AS BIGINT) END), lambda i: i * {step})) AS s FROM lined)
    )"""


CALLS_SQL = f"""calls AS (
    SELECT (file_id * 100000 + line) * 100000 + pos AS call_id, file_id AS caller_chunk_id, callee_name, line, pos AS "column"
    FROM (SELECT file_id, line, unnest(t) AS callee_name, unnest(generate_series(0, len(t) - 1)) AS pos
          FROM (SELECT file_id, line, {tokens_sql("words")} AS t
                FROM (SELECT file_id, unnest(string_split(text, chr(10))) AS words, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM files)) WHERE len(t) > 0)
    WHERE pos > 0 OR line > 1
), lone AS (
    SELECT symbol, min(file_id) AS chunk_id FROM files WHERE symbol IS NOT NULL GROUP BY symbol HAVING count(*) = 1
), in_file AS (SELECT file_id, symbol FROM files WHERE symbol IS NOT NULL),
resolved AS (
    SELECT c.*, coalesce(i.file_id, l.chunk_id) AS resolved_chunk_id
    FROM calls c LEFT JOIN in_file i ON i.file_id = c.caller_chunk_id AND i.symbol = c.callee_name
                 LEFT JOIN lone l ON l.symbol = c.callee_name
)"""
