"""Queries over text: chunks, paths, names, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import hashing, vectors
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import chunking, lexical
from quarry.queries import corpus as C


def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windows(spark, sf_dir).select("file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "kind", F.md5("content").alias("content_md5"))


def fallback_chunks_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.line_windows(C.files(spark, sf_dir).select("file_id", F.col("text").alias("content")))
    return out.select("file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "kind", F.md5("content").alias("content_md5"))


def _chunks_sql(size: int, overlap: int) -> str:
    return f"WITH {C.windows_sql(size, overlap)} SELECT file_id, start_line, end_line, 'block' AS kind, md5(content) AS content_md5 FROM windows"


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.files(spark, sf_dir).select("path").unionByName(C.table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return files.select("path", P.language(F.col("path")).alias("language"))


_LANGUAGES = ", ".join(f"('{k}', '{v}')" for k, v in P.LANGUAGE_OF.items())
_EXT = "nullif(regexp_extract(lower(path), '[^/]\\.([^./]*)$', 1), '')"
LANGUAGE_SQL = f"""
    WITH {C.FILES_SQL}, f AS (SELECT path FROM files UNION ALL SELECT url FROM pages), known(ext, language) AS (VALUES {_LANGUAGES})
    SELECT path, language FROM f LEFT JOIN known ON ext = {_EXT}
"""


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_detect(spark, sf_dir).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).where(P.extension_filter(F.col("path"), [".PY", " rs ", ""])).select("file_id", "path")


def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).where(F.octet_length("text") <= 2000).select("file_id", F.octet_length("text").cast("long").alias("size"))


def default_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls and files below some directories that are excluded and some that are not."""
    dirs = F.array(*map(F.lit, ("src/", "node_modules/", "a/build/", "a/.git/", "pkg.egg-info/", "coverages/", "lib/vendor/")))
    names = F.array(*map(F.lit, (".py", ".min.js", ".map", ".js", ".lock")))
    files = C.files(spark, sf_dir).select("file_id", F.concat(F.try_element_at(dirs, (F.col("file_id") % 7 + 1).cast("int")), F.col("file_id").cast("string"), F.try_element_at(names, (F.col("file_id") % 5 + 1).cast("int"))).alias("path"))
    return files.where(~P.default_excluded(F.col("path"))).select("file_id", "path")


EXCLUSIONS_SQL = """
    SELECT doc_id AS file_id, p AS path FROM (
        SELECT doc_id, ['src/', 'node_modules/', 'a/build/', 'a/.git/', 'pkg.egg-info/', 'coverages/', 'lib/vendor/'][doc_id % 7 + 1] || doc_id ||
               ['.py', '.min.js', '.map', '.js', '.lock'][doc_id % 5 + 1] AS p FROM documents WHERE text IS NOT NULL)
    WHERE NOT regexp_matches(p, '(^|/)(node_modules|build|\\.git|vendor|[^/]*\\.egg-info)/') AND NOT regexp_matches(p, '\\.(min\\.js|map|lock)$')
"""


def custom_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns as in an ignore file: the last that matches decides."""
    patterns = ["# a comment", "src/src1*/", "*.go", "!src/src12/", "/src/src3/**"]
    return C.files(spark, sf_dir).where(~P.ignored(F.col("path"), patterns)).select("file_id", "path")


IGNORE_SQL = f"""
    WITH {C.FILES_SQL} SELECT file_id, path FROM files
    WHERE NOT CASE WHEN regexp_matches(path, '^src/src3/') THEN true WHEN regexp_matches(path, '^src/src12/') THEN false
                   WHEN path LIKE '%.go' THEN true WHEN regexp_matches(path, '^src/src1[^/]*/') THEN true ELSE false END
"""


def preprocess_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier splitting over texts, part names and order priorities joined like identifiers."""
    texts = C.files(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("file_id").cast("string")).alias("key"), F.col("text").alias("x"))
    parts = C.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.regexp_replace(F.initcap("p_name"), " ", "").alias("x"))
    orders = C.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.regexp_replace(F.initcap("o_orderpriority"), "[ -]", "").alias("x"))
    return texts.unionByName(parts).unionByName(orders).select("key", F.md5(T.split_identifiers(F.col("x"))).alias("words_md5"))


_SPLIT_ONCE = "regexp_replace({x}, '([\\p{{Ll}}\\p{{Lu}}])(\\p{{Lu}})', '\\1 \\2', 'g')"
PREPROCESS_SQL = f"""
    WITH x AS (
        SELECT 'doc:' || doc_id AS key, text AS x FROM documents WHERE text IS NOT NULL
        UNION ALL
        SELECT 'part:' || p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') FROM part
        UNION ALL
        SELECT 'order:' || o_orderkey, replace(array_to_string(list_transform(string_split(o_orderpriority, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), '-', '') FROM orders
    )
    SELECT key, md5(trim(regexp_replace({_SPLIT_ONCE.format(x=_SPLIT_ONCE.format(x="substring(x, 1, 8192)"))}, '[\\s_]+', ' ', 'g'))) AS words_md5 FROM x
"""


def normalize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select("p_partkey", T.normalize_token(F.col("p_name")).alias("token")).unionByName(C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), T.normalize_token(F.col("s_name")).alias("token")))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", T.token_estimate(F.col("text")).alias("tokens"))


def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("chunk_id") % 3 == 0, "Outer")
    symbol = F.when(F.col("chunk_id") % 4 != 0, F.col("symbol"))
    return C.documents(spark, sf_dir).select("chunk_id", T.display_name(parent, symbol, F.col("kind"), F.col("start_line"), F.col("end_line")).alias("name"), T.line_count(F.col("start_line"), F.col("end_line")).cast("long").alias("lines"))


DISPLAY_SQL = f"""
    WITH {C.FILES_SQL}, d AS (SELECT *, len({C.lines_sql("text")}) AS n FROM files)
    SELECT file_id AS chunk_id,
           CASE WHEN file_id % 4 = 0 OR symbol IS NULL THEN 'function:1-' || n WHEN file_id % 3 = 0 THEN 'Outer.' || symbol ELSE symbol END AS name,
           greatest(n - 1, 0) + 1 AS lines FROM d
"""


def snippet_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", F.md5(T.head_lines(F.col("text"))).alias("snippet_md5"))


def excerpt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.output import excerpt

    return C.files(spark, sf_dir).select("file_id", F.md5(excerpt(F.col("text"), 3)).alias("excerpt_md5"))


def _head_sql(lines: str, n: int) -> str:
    return f"array_to_string(({lines})[1:{n}], chr(10)) || CASE WHEN len({lines}) > {n} THEN chr(10) || '...' ELSE '' END"


def tokenize_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical.field_tokens(C.files(spark, sf_dir), "file_id", {"content": F.col("text")})
    return lexical.postings(tokens).select(F.col("id").alias("file_id"), "term", F.col("tf").cast("long").alias("tf"))


POSTINGS_SQL = f"WITH {C.FILES_SQL}, t AS (SELECT file_id, unnest({C.tokens_sql('text')}) AS term FROM files) SELECT file_id, term, count(*) AS tf FROM t GROUP BY ALL"


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical.field_tokens(C.files(spark, sf_dir), "file_id", {"content": F.col("text"), "symbol": F.col("symbol")})
    return lexical.lengths(tokens).select(F.col("id").alias("file_id"), "field", F.col("n").cast("long").alias("n"))


LENGTHS_SQL = f"WITH {C.FILES_SQL} SELECT file_id, 'content' AS field, len({C.tokens_sql('text')}) AS n FROM files UNION ALL SELECT file_id, 'symbol', len({C.tokens_sql("coalesce(symbol, '')")}) FROM files"


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_postings(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def mock_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.byte_embedding(F.col("text"), 16)
    return C.files(spark, sf_dir).select("file_id", *(F.round(F.element_at(v, i + 1), 6).alias(f"e{i}") for i in range(4)))


_BYTES = "list_transform(generate_series(0, 15), lambda i: CASE WHEN i < strlen(text) THEN CAST('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2] AS INTEGER) / 255.0 - 0.5 ELSE 0.0 END)"
MOCK_SQL = f"""
    WITH e AS (SELECT doc_id AS file_id, {_BYTES} AS v FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
    SELECT file_id, {", ".join(f"round(CASE WHEN n = 0 THEN v[{i + 1}] ELSE v[{i + 1}] / n END, 6) AS e{i}" for i in range(4))} FROM n
"""


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", hashing.content_hash(F.col("text")).alias("xxh3"), hashing.sha256_hex(F.col("text").cast("binary")).alias("sha256"))


def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files(spark, sf_dir).select("file_id", hashing.sha256_hex(F.col("text").cast("binary")).alias("sha256"))


QUERIES = {f.__name__: f for f in (
    fallback_chunks, fallback_chunks_default, language_detect, supported_files, extension_filter, size_filter, default_exclusions, custom_ignore,
    preprocess_identifiers, normalize_token, token_estimate, display_name, snippet_12, excerpt_n, tokenize_postings, doc_lengths, term_df,
    mock_embed, content_hash, sha256,
)}
SQL = {
    "fallback_chunks": _chunks_sql(C.WINDOW, C.OVERLAP),
    "fallback_chunks_default": _chunks_sql(chunking.WINDOW, chunking.OVERLAP),
    "language_detect": LANGUAGE_SQL,
    "supported_files": f"SELECT language, count(*) AS n FROM ({LANGUAGE_SQL}) WHERE language IS NOT NULL GROUP BY 1",
    "extension_filter": f"WITH {C.FILES_SQL} SELECT file_id, path FROM files WHERE path LIKE '%.py' OR path LIKE '%.rs'",
    "size_filter": "SELECT doc_id AS file_id, strlen(text) AS size FROM documents WHERE strlen(text) <= 2000",
    "default_exclusions": EXCLUSIONS_SQL,
    "custom_ignore": IGNORE_SQL,
    "preprocess_identifiers": PREPROCESS_SQL,
    "normalize_token": "SELECT p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS token FROM part UNION ALL SELECT s_suppkey, lower(regexp_replace(s_name, '[^\\p{L}\\p{N}]', '', 'g')) FROM supplier",
    "token_estimate": "SELECT doc_id AS file_id, CAST(floor(strlen(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "display_name": DISPLAY_SQL,
    "snippet_12": f"WITH {C.FILES_SQL} SELECT file_id, md5({_head_sql(C.lines_sql('text'), 12)}) AS snippet_md5 FROM files",
    "excerpt_n": f"WITH {C.FILES_SQL} SELECT file_id, md5({_head_sql('string_split(text, chr(10))', 3)}) AS excerpt_md5 FROM files",
    "tokenize_postings": POSTINGS_SQL,
    "doc_lengths": LENGTHS_SQL,
    "term_df": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({POSTINGS_SQL}) GROUP BY 1",
    "mock_embed": MOCK_SQL,
    "sha256": "SELECT doc_id AS file_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
}
