"""Queries over retrieval: BM25, nearest neighbours, fusion, reranking, overlap removal, whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import fusion, lexical, ranking, vector
from quarry.plans.scratch import scratch
from quarry.plans.search import Fusion, SearchEngine
from quarry.queries import corpus as C

K = 10
WORDS = "the and of"
SYMBOL_QUERY = "the"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lexical_index(spark: SparkSession, sf_dir: str, *fields: str) -> lexical.Index:
    """Built once for a table and read by every search after that."""
    return lexical.Index.read(spark, C.built(spark, sf_dir, "lexical-" + "-".join(fields), lambda where: _build(spark, sf_dir, fields).write(where)))


def _build(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> lexical.Index:
    columns = {"content": F.col("text"), "symbol": F.col("symbol"), "file": F.col("path"), "kind": F.lit("function")}
    return lexical.Index.build(C.files(spark, sf_dir), "file_id", {f: columns[f] for f in fields})


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical index of contents and symbols, built and written anew: documents and postings of each field."""
    where = scratch(spark, "index")
    _build(spark, sf_dir, ("content", "symbol")).write(where)
    index = lexical.Index.read(spark, where)
    docs = index.lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    return docs.join(index.postings.groupBy("field").agg(F.count("*").alias("postings")), "field")


def _found(hits: DataFrame) -> DataFrame:
    return _round(hits.withColumnRenamed("id", "file_id"), "score")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content").search(WORDS, K))


def bm25_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content").search("idiot worthless", 100))


def bm25_two_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content", "symbol").search(WORDS, K))


def bm25_field_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content", "symbol", "file", "kind").search("symbol:the file:src3", K))


def bm25_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content").search("+with of -was", K))


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content").search('"of the"', K))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))


def bm25_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(lexical_index(spark, sf_dir, "content").delete(_deleted(spark, sf_dir)).search(WORDS, K))


def bm25_doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index(spark, sf_dir, "content", "symbol").delete(_deleted(spark, sf_dir)).count()


_FIELD = {"content": "text", "symbol": "coalesce(symbol, '')", "file": "path", "kind": "'function'"}


def _index_sql(fields: list[str], where: str = "true") -> str:
    """CTEs ``tok(id, field, t)``, ``len``, ``stat``, ``post``."""
    each = " UNION ALL ".join(f"SELECT file_id AS id, '{f}' AS field, {C.tokens_sql(_FIELD[f])} AS t FROM files WHERE {where}" for f in fields)
    return f"""{C.FILES_SQL}, tok AS ({each}),
    stat AS (SELECT field, count(*) AS docs, avg(len(t)) AS avg_n FROM tok GROUP BY field),
    post AS (SELECT id, field, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, field, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY id, field, term)"""


_WEIGHT = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n)))"


def bm25_sql(fields: list[str], clauses: list[tuple[str, list[str], str]], k: int = K, where: str = "true") -> str:
    """Single-term clauses (term, fields, occur)."""
    values = ", ".join(f"({i}, '{t}', '{f}', '{o}')" for i, (t, fs, o) in enumerate(clauses) for f in fs)
    must = " AND ".join(f"bool_or(clause = {i})" for i, c in enumerate(clauses) if c[2] == "must") or "true"
    never = " AND ".join(f"NOT bool_or(clause = {i})" for i, c in enumerate(clauses) if c[2] == "not") or "true"
    return f"""
        WITH {_index_sql(fields, where)}, q(clause, term, field, occur) AS (VALUES {values}),
        hit AS (SELECT q.clause, q.occur, p.*, count(*) OVER (PARTITION BY q.clause, p.field) AS df FROM post p JOIN q USING (term, field))
        SELECT id AS file_id, round(sum({_WEIGHT}) FILTER (occur <> 'not'), 6) AS score FROM hit JOIN stat USING (field)
        GROUP BY id HAVING {must} AND {never} AND count(*) FILTER (occur <> 'not') > 0 ORDER BY round(sum({_WEIGHT}) FILTER (occur <> 'not'), 9) DESC, id LIMIT {k}
    """


_should = lambda words, *fields: [(w, list(fields), "should") for w in words.split()]
PHRASE_SQL = f"""
    WITH {_index_sql(["content"])},
    hit AS (SELECT * FROM (SELECT id, len(t) AS n, len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM tok WHERE len(t) > 1) WHERE tf > 0),
    s AS (SELECT id, {_WEIGHT} AS score FROM (SELECT *, count(*) OVER () AS df FROM hit), stat)
    SELECT id AS file_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT {K}
"""


# -- vectors -------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in _vectors(spark, sf_dir).where("id = 7").first()["embedding"]]


def vector_index(spark: SparkSession, sf_dir: str) -> vector.VectorIndex:
    return vector.VectorIndex(_vectors(spark, sf_dir), 64)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(vector_index(spark, sf_dir).search(_query_vector(spark, sf_dir), K), "score")


def knn_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = C.table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return _round(vector_index(spark, sf_dir).delete(gone).search(_query_vector(spark, sf_dir), K), "score")


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with an id divisible by 50 as queries."""
    v = _vectors(spark, sf_dir)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return _round(vector.search_many(v, queries, 5), "score")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    after = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return v.join(after, "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = V.normalize(F.col("embedding"))
    return _vectors(spark, sf_dir).select("id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(unit), 6).alias("unit_norm"), F.round(F.element_at(unit, 1), 6).alias("first"))


def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = C.table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return vector_index(spark, sf_dir).delete(gone).compact().count()


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_V = f"v AS (SELECT vec_id AS id, {_D} AS e, label FROM embeddings)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_cos = lambda a, b: _COS.format(a=a, b=b)


def _knn_sql(where: str, k: int = K) -> str:
    return f"WITH {_V}, q AS (SELECT e AS q FROM v WHERE id = 7), s AS (SELECT id, {_cos('e', 'q')} AS score FROM v, q WHERE {where}) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {k}"


# -- fusion --------------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexical_index(spark, sf_dir, "content").search(WORDS, 50)
    sem = vector_index(spark, sf_dir).search(_query_vector(spark, sf_dir), 50)
    return fusion.as_list(lex, "lexical").unionByName(fusion.as_list(sem, "semantic"))


def rrf_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.top(fusion.reciprocal_rank(_lists(spark, sf_dir)), 20), "score")


def rrf_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = C.table(spark, sf_dir, "documents").select(F.lit("long").alias("list"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return _round(fusion.top(fusion.reciprocal_rank(_lists(spark, sf_dir).unionByName(longest), 10), 20), "score")


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.top(fusion.weighted(_lists(spark, sf_dir), fusion.two_weights(0.3)), 20), "score")


def weighted_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list whose scores are all equal counts as 1; a weight beyond 1 is cut; an unnamed list weighs 1."""
    flat = _lists(spark, sf_dir).withColumn("score", F.when(F.col("list") == "semantic", F.lit(0.5)).otherwise(F.col("score")))
    third = flat.where("list = 'semantic'").withColumn("list", F.lit("other"))
    return _round(fusion.top(fusion.weighted(flat.unionByName(third), fusion.two_weights(1.7)), 20), "score")


def _ranked_sql() -> str:
    lex = bm25_sql(["content"], _should(WORDS, "content"), 50).strip().removeprefix("WITH")
    cte, _, final = lex.rpartition("SELECT id AS file_id")
    final = final.replace("FILTER (occur <> 'not'), 6)", "FILTER (occur <> 'not'), 9)", 1)
    return f"""WITH {cte.strip()}, lex AS (SELECT id AS file_id{final}), {_V}, qv AS (SELECT e AS q FROM v WHERE id = 7),
        sem AS (SELECT id, {_cos('e', 'q')} AS score FROM v, qv ORDER BY score DESC, id LIMIT 50),
        lists AS (SELECT 'lexical' AS list, file_id AS id, score FROM lex UNION ALL SELECT 'semantic', id, score FROM sem)"""


_RRF = "SELECT id, round(sum(1.0 / ({k} + rank + 1)), 6) AS score FROM (SELECT id, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) - 1 AS rank FROM {lists}) GROUP BY id ORDER BY sum(1.0 / ({k} + rank + 1)) DESC, id LIMIT 20"
_SCALED = "CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END"
_MINMAX = "(SELECT *, min(score) OVER (PARTITION BY list) AS lo, max(score) OVER (PARTITION BY list) AS hi FROM {lists})"


def _weighted_sql(lists: str, case: str) -> str:
    part = f"CASE list {case} ELSE 1.0 END * {_SCALED}"
    return f"SELECT id, round(sum({part}), 6) AS score FROM {_MINMAX.format(lists=lists)} GROUP BY id ORDER BY sum({part}) DESC, id LIMIT 20"


# -- ranking -------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    hits = lexical_index(spark, sf_dir, "content").search(WORDS, n)
    files = C.files(spark, sf_dir).select("file_id", F.concat(F.lit("src/"), (F.col("file_id") % 9).cast("string")).alias("path"))
    return ranking.hydrate(ranking.with_rank(hits), C.documents(spark, sf_dir), files)


def rerank_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _results(spark, sf_dir).select("chunk_id", "symbol", (F.col("score") * ranking.symbol_factor(F.col("symbol"), SYMBOL_QUERY)).alias("score"))
    return _round(out, "score")


def rerank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranking.rerank(_results(spark, sf_dir), SYMBOL_QUERY).select("rank", "file", "symbol", "chunk_id", "score"), "score")


def _results_sql(n: int = 40) -> str:
    lex = bm25_sql(["content"], _should(WORDS, "content"), n).strip().removeprefix("WITH")
    cte, _, final = lex.rpartition("SELECT id AS file_id")
    final = final.replace("FILTER (occur <> 'not'), 6)", "FILTER (occur <> 'not'), 9)", 1)
    return f"""WITH {cte.strip()}, lex AS (SELECT id AS file_id{final}),
        res AS (SELECT row_number() OVER (ORDER BY score DESC, file_id) - 1 AS rank, 'src/' || (file_id % 9) AS file, symbol, file_id AS chunk_id, score FROM lex JOIN files USING (file_id)),
        sym AS (SELECT *, score * CASE WHEN symbol IS NULL THEN 1.0 WHEN symbol = '{SYMBOL_QUERY}' THEN 1.25
                    WHEN symbol <> '' AND (contains(symbol, '{SYMBOL_QUERY}') OR contains('{SYMBOL_QUERY}', symbol)) THEN 1.10
                    WHEN contains(symbol, '{SYMBOL_QUERY}') OR contains('{SYMBOL_QUERY}', symbol) THEN 1.08 ELSE 1.0 END AS s1 FROM res)"""


RERANK_FULL_SQL = f"""{_results_sql()},
    fin AS (SELECT *, s1 * CASE WHEN rank > 0 AND file = first_value(file) OVER (ORDER BY rank) THEN 1.05 ELSE 1.0 END AS s2, rank AS old FROM sym)
    SELECT CAST(row_number() OVER (ORDER BY s2 DESC, old) - 1 AS INTEGER) AS rank, file, symbol, chunk_id, round(s2, 6) AS score FROM fin"""


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of lines of the orders: a file per customer, in price order."""
    orders = C.table(spark, sf_dir, "orders").where("o_custkey is not null")
    start = (F.col("o_orderkey") % 40).cast("int") + 1
    return orders.select(
        F.col("o_orderkey").alias("rank"), (F.col("o_custkey") % 50).cast("string").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit("block").alias("kind"),
        start.alias("start"), (start + (F.col("o_custkey") % 23).cast("int") - 1).alias("end"), F.col("o_totalprice").alias("score"), F.lit("").alias("snippet"), F.col("o_orderkey").alias("chunk_id"),
    )


def dedupe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.drop_overlaps(_overlapping(spark, sf_dir)).select("rank", "file", "start", "end")


DEDUPE_SQL = """
    WITH RECURSIVE r AS (
        SELECT o_orderkey AS rank, CAST(o_custkey % 50 AS VARCHAR) AS file, CAST(o_orderkey % 40 + 1 AS INTEGER) AS s, CAST(o_orderkey % 40 + 1 + o_custkey % 23 - 1 AS INTEGER) AS e,
               row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders WHERE o_custkey IS NOT NULL
    ), k AS (
        SELECT file, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(rank BIGINT, s INTEGER, e INTEGER)[]) AS kept FROM (SELECT DISTINCT file FROM r)
        UNION ALL
        SELECT r.file, r.i, CASE WHEN len(list_filter(k.kept, lambda x: least(greatest(x.e - x.s + 1, 0), greatest(r.e - r.s + 1, 0)) > 0 AND
                   greatest(least(x.e, r.e) - greatest(x.s, r.s) + 1, 0) / CAST(least(greatest(x.e - x.s + 1, 0), greatest(r.e - r.s + 1, 0)) AS DOUBLE) > 0.5)) > 0
               THEN k.kept ELSE list_append(k.kept, {'rank': r.rank, 's': r.s, 'e': r.e}) END
        FROM k JOIN r ON r.file = k.file AND r.i = k.i + 1
    ), last AS (SELECT file, arg_max(kept, i) AS kept FROM k GROUP BY file)
    SELECT x.rank AS rank, file, x.s AS "start", x.e AS "end" FROM (SELECT file, unnest(kept) AS x FROM last)
"""


def hydrate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale hits, of ids without a chunk, are left out."""
    hits = lexical_index(spark, sf_dir, "content").search(WORDS, 20).unionByName(spark.createDataFrame([(-1, 99.0)], "id long, score double"))
    out = ranking.hydrate(ranking.with_rank(hits), C.documents(spark, sf_dir), C.files(spark, sf_dir))
    return out.select("rank", "file", "symbol", "start", F.col("end").cast("long").alias("end"), "chunk_id", F.md5("snippet").alias("snippet_md5"))


def _hydrate_sql() -> str:
    lex = bm25_sql(["content"], _should(WORDS, "content"), 20).strip()
    head = C.lines_sql("text")
    return f"""
        WITH hits AS ({lex}), {C.FILES_SQL}
        SELECT CAST(row_number() OVER (ORDER BY score DESC, h.file_id) AS INTEGER) AS rank, path AS file, symbol, 1 AS "start", len({head}) AS "end", h.file_id AS chunk_id,
               md5(array_to_string(({head})[1:12], chr(10)) || CASE WHEN len({head}) > 12 THEN chr(10) || '...' ELSE '' END) AS snippet_md5
        FROM hits h JOIN files f ON f.file_id = h.file_id
    """


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    def write(where: str) -> None:
        C.documents(spark, sf_dir).write.parquet(f"{where}/chunks")
        C.files(spark, sf_dir).drop("text").write.parquet(f"{where}/files")

    stored = C.built(spark, sf_dir, "stored", write)
    return SearchEngine(lexical_index(spark, sf_dir, "content", "symbol"), vector_index(spark, sf_dir), spark.read.parquet(f"{stored}/chunks"), spark.read.parquet(f"{stored}/files"))


def _shown(results: DataFrame) -> DataFrame:
    return _round(results.select("rank", "file", "symbol", "kind", "chunk_id", "score"), "score")


def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(engine(spark, sf_dir).search_lexical(WORDS, K))


def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(engine(spark, sf_dir).search_semantic(WORDS, _query_vector(spark, sf_dir), K))


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(engine(spark, sf_dir).search_hybrid(WORDS, _query_vector(spark, sf_dir), K))


def search_hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(engine(spark, sf_dir).search_hybrid(WORDS, _query_vector(spark, sf_dir), K, Fusion(lexical_share=0.6)))


def search_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(engine(spark, sf_dir).search(WORDS, "BM25", k=K, dedupe=True))


QUERIES = {f.__name__: f for f in (
    index_build, bm25_topk, bm25_rare, bm25_two_field, bm25_field_term, bm25_must_not, bm25_phrase, bm25_after_delete, bm25_doc_count, knn_topk, knn_tombstoned,
    knn_batch, cosine_pairs, l2_norm, vector_count, rrf_two, rrf_three, weighted_fusion, weighted_degenerate, rerank_symbol, rerank_full,
    dedupe_overlap, hydrate_hits, search_lexical, search_semantic, search_hybrid, search_hybrid_weighted, search_deduped,
)}
_LIVE = "file_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"


def _search_sql(hits: str) -> str:
    """Hydration and reranking of ``hits(id, score)`` for the query ``WORDS``; symbols are lower-case words."""
    plain = WORDS.replace(" ", "")
    return f"""{hits}, res AS (
            SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, f.path AS file, f.symbol, id AS chunk_id,
                   score * CASE WHEN symbol IS NULL THEN 1.0 WHEN symbol = '{plain}' THEN 1.25 WHEN symbol <> '' AND (contains(symbol, '{plain}') OR contains('{plain}', symbol)) THEN 1.10
                                WHEN contains(symbol, '{WORDS}') OR contains('{WORDS}', symbol) THEN 1.08 ELSE 1.0 END AS s
            FROM hits JOIN files f ON f.file_id = hits.id)
        SELECT CAST(row_number() OVER (ORDER BY s DESC, rank) - 1 AS INTEGER) AS rank, file, symbol, 'function' AS kind, chunk_id, round(s, 6) AS score FROM res"""


def _engine_lists(k: int) -> str:
    lex = bm25_sql(["content", "symbol"], _should(WORDS, "content", "symbol"), k).strip().removeprefix("WITH")
    cte, _, final = lex.rpartition("SELECT id AS file_id")
    final = final.replace("FILTER (occur <> 'not'), 6)", "FILTER (occur <> 'not'), 9)", 1)
    return f"""WITH {cte.strip()}, lex AS (SELECT id AS file_id{final}), {_V}, qv AS (SELECT e AS q FROM v WHERE id = 7),
        sem AS (SELECT id, {_cos('e', 'q')} AS score FROM v, qv ORDER BY score DESC, id LIMIT {k}),
        lists AS (SELECT 'lexical' AS list, file_id AS id, score FROM lex UNION ALL SELECT 'semantic', id, score FROM sem)"""


_FUSED = "SELECT id, sum(1.0 / (60 + rank + 1)) AS score FROM (SELECT id, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) - 1 AS rank FROM lists) GROUP BY id ORDER BY score DESC, id LIMIT 10"
_MIXED = f"SELECT id, sum(CASE list WHEN 'lexical' THEN 0.6 ELSE 0.4 END * {_SCALED}) AS score FROM {_MINMAX.format(lists='lists')} GROUP BY id ORDER BY score DESC, id LIMIT 10"
SQL = {
    "index_build": f"""WITH {C.FILES_SQL}, t AS (SELECT 'content' AS field, {C.tokens_sql("text")} AS tokens FROM files UNION ALL SELECT 'symbol', {C.tokens_sql("coalesce(symbol, '')")} FROM files)
        SELECT field, count(*) AS docs, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(tokens))) AS BIGINT) AS postings FROM t GROUP BY 1""",
    "bm25_topk": bm25_sql(["content"], _should(WORDS, "content")),
    "bm25_rare": bm25_sql(["content"], _should("idiot worthless", "content"), 100),
    "bm25_two_field": bm25_sql(["content", "symbol"], _should(WORDS, "content", "symbol")),
    "bm25_field_term": bm25_sql(["content", "symbol", "file", "kind"], [("the", ["symbol"], "should"), ("src3", ["file"], "should")]),
    "bm25_must_not": bm25_sql(["content"], [("with", ["content"], "must"), ("of", ["content"], "should"), ("was", ["content"], "not")]),
    "bm25_phrase": PHRASE_SQL,
    "bm25_after_delete": bm25_sql(["content"], _should(WORDS, "content"), where=_LIVE),
    "bm25_doc_count": f"WITH {C.FILES_SQL} SELECT count(*) AS docs FROM files WHERE {_LIVE}",
    "knn_topk": _knn_sql("true"),
    "knn_tombstoned": _knn_sql("label <> 3"),
    "knn_batch": f"WITH {_V}, s AS (SELECT a.id AS query_id, b.id, {_cos('a.e', 'b.e')} AS score FROM v a, v b WHERE a.id % 50 = 0), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM s) SELECT * FROM r WHERE rank <= 5",
    "cosine_pairs": f"WITH {_V} SELECT a.id, round({_cos('a.e', 'b.e')}, 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1",
    "l2_norm": f"WITH {_V} SELECT id, round(sqrt(list_dot_product(e, e)), 6) AS norm, 1.0 AS unit_norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v",
    "vector_count": "SELECT count(*) AS vectors FROM embeddings WHERE label <> 3",
    "rrf_two": f"{_ranked_sql()} {_RRF.format(k=60, lists='lists')}",
    "rrf_three": f"{_ranked_sql()}, three AS (FROM lists UNION ALL SELECT 'long', doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)) {_RRF.format(k=10, lists='three')}",
    "weighted_fusion": f"{_ranked_sql()} {_weighted_sql('lists', "WHEN 'lexical' THEN 0.3 WHEN 'semantic' THEN 0.7")}",
    "weighted_degenerate": f"{_ranked_sql()}, flat AS (SELECT list, id, CASE list WHEN 'semantic' THEN 0.5 ELSE score END AS score FROM lists), three AS (FROM flat UNION ALL SELECT 'other', id, score FROM flat WHERE list = 'semantic') {_weighted_sql('three', "WHEN 'lexical' THEN 1.0 WHEN 'semantic' THEN 0.0")}",
    "rerank_symbol": f"{_results_sql()} SELECT chunk_id, symbol, round(s1, 6) AS score FROM sym",
    "rerank_full": RERANK_FULL_SQL,
    "dedupe_overlap": DEDUPE_SQL,
    "hydrate_hits": _hydrate_sql(),
    "search_semantic": _search_sql(f"WITH {C.FILES_SQL}, {_V}, qv AS (SELECT e AS q FROM v WHERE id = 7), hits AS (SELECT id, {_cos('e', 'q')} AS score FROM v, qv ORDER BY score DESC, id LIMIT {K})"),
    "search_lexical": _search_sql(f"{_engine_lists(K)}, hits AS (SELECT id, score FROM lists WHERE list = 'lexical')"),
    "search_hybrid": _search_sql(f"{_engine_lists(K)}, hits AS ({_FUSED})"),
    "search_hybrid_weighted": _search_sql(f"{_engine_lists(K)}, hits AS ({_MIXED})"),
    "search_deduped": _search_sql(f"{_engine_lists(K)}, hits AS (SELECT id, score FROM lists WHERE list = 'lexical')"),
}
