"""BM25 over columnar postings.

The index is three tables: postings ``(id, field, term, tf, positions)``, lengths ``(id, field, n)`` and collection
statistics ``(field, docs, avg_n)``.  A query reads only the postings of its terms (the term filter reaches the
Parquet scan when the index is written clustered by term) and ends in ``TakeOrderedAndProject``.

Scores follow Okapi BM25 per field, summed over fields: ``k1`` 1.2, ``b`` 0.75,
``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

K1, B = 1.2, 0.75


class QueryError(ValueError):
    """A query string that cannot be read."""


@dataclass(frozen=True)
class Clause:
    """Terms of one clause (a phrase if several), the fields searched, and how it counts."""

    terms: tuple[str, ...]
    fields: tuple[str, ...]
    occur: str = "should"


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = field(default_factory=tuple)


_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


def parse_query(text: str, default_fields: tuple[str, ...] = ("content", "symbol"), known: tuple[str, ...] = ("content", "symbol", "kind", "file", "chunk_id")) -> Query:
    """Bare terms, ``"phrases"``, ``+must``, ``-not`` and ``field:term``; unknown fields and open quotes are errors."""
    if text.count('"') % 2:
        raise QueryError("unbalanced quote")
    out = []
    for sign, name, quoted, bare in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))', text):
        if name and name not in known:
            raise QueryError(f"unknown field: {name}")
        words = tuple(w.lower() for w in _TOKEN.findall(quoted or bare) if len(w) <= T.MAX_TOKEN)
        occur = {"+": "must", "-": "not"}.get(sign, "should")
        where = (name,) if name else default_fields
        if quoted:
            if words:
                out.append(Clause(words, where, occur))
        else:
            out += [Clause((w,), where, occur) for w in words]
    return Query(tuple(out))


def field_tokens(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``id, field, tokens`` of every document and field."""
    each = F.array(*(F.struct(F.lit(name).alias("field"), T.tokens(F.coalesce(c, F.lit(""))).alias("tokens")) for name, c in fields.items()))
    return docs.select(F.col(key).alias("id"), F.explode(each).alias("f")).select("id", "f.field", "f.tokens")


def postings(tokens: DataFrame) -> DataFrame:
    """``id, field, term, tf, positions`` (ascending)."""
    at = tokens.select("id", "field", F.posexplode("tokens").alias("pos", "term"))
    return at.groupBy("id", "field", "term").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", "field", F.size("tokens").alias("n"))


def statistics(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"))


def idf(docs: Column, df: Column) -> Column:
    return F.log1p((docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, n: Column, avg_n: Column, k1: float = K1, b: float = B) -> Column:
    scale = F.when(avg_n > 0, n / avg_n).otherwise(F.lit(0.0))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * scale))


@dataclass
class Index:
    """The tables of a lexical index; ``deleted`` holds ids that no longer count."""

    postings: DataFrame
    lengths: DataFrame
    deleted: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: dict[str, Column]) -> Index:
        tokens = field_tokens(docs, key, fields)
        return cls(postings(tokens), lengths(tokens))

    def write(self, where: str) -> None:
        """Postings sorted by term, so that a query's terms prune row groups."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{where}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{where}/lengths")

    @classmethod
    def read(cls, spark: SparkSession, where: str) -> Index:
        return cls(spark.read.parquet(f"{where}/postings"), spark.read.parquet(f"{where}/lengths"))

    def delete(self, ids: DataFrame) -> Index:
        """Without the documents of ``ids(id)``; statistics follow."""
        gone = ids.select("id").distinct()
        return Index(self.postings.join(gone, "id", "left_anti"), self.lengths.join(gone, "id", "left_anti"))

    def add(self, other: Index) -> Index:
        return Index(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths))

    def count(self) -> DataFrame:
        return self.lengths.agg(F.countDistinct("id").alias("docs"))

    def scores(self, query: Query) -> DataFrame:
        """``id, score`` of every match; to nine places, so that the order of adding up breaks no tie."""
        terms = sorted({t for c in query.clauses for t in c.terms})
        spark = self.postings.sparkSession
        if not terms:
            return spark.createDataFrame([], "id long, score double")
        hits = self.postings.where(F.col("term").isin(*terms))
        single = [(i, c.terms[0], f) for i, c in enumerate(query.clauses) if len(c.terms) == 1 for f in c.fields]
        frames = []
        if single:  # all single terms in one pass: each posting meets the clauses it counts for
            wanted = F.array(*(F.struct(F.lit(i).alias("clause"), F.lit(t).alias("term"), F.lit(f).alias("field")) for i, t, f in single))
            met = F.transform(F.filter(wanted, lambda w: (w["term"] == F.col("term")) & (w["field"] == F.col("field"))), lambda w: w["clause"])
            frames.append(hits.select("id", "field", "tf", F.explode(met).alias("clause")))
        for i, c in enumerate(query.clauses):
            if len(c.terms) > 1:
                mine = hits.where(F.col("term").isin(*set(c.terms)) & F.col("field").isin(*c.fields))
                frames.append(_phrase(mine, c.terms).withColumn("clause", F.lit(i)))
        found = frames[0]
        for f in frames[1:]:
            found = found.unionByName(f)
        df = found.groupBy("clause", "field").agg(F.count("*").alias("df"))  # at most clauses x fields rows
        every = found.join(F.broadcast(df), ["clause", "field"])
        stats = F.broadcast(statistics(self.lengths))
        weighed = every.join(self.lengths, ["id", "field"]).join(stats, "field")
        score = idf(F.col("docs"), F.col("df")) * term_weight(F.col("tf"), F.col("n"), F.col("avg_n"))
        must = [i for i, c in enumerate(query.clauses) if c.occur == "must"]
        never = [i for i, c in enumerate(query.clauses) if c.occur == "not"]
        has = lambda i: F.max((F.col("clause") == i).cast("int")) == 1
        out = weighed.groupBy("id").agg(F.round(F.sum(F.when(~F.col("clause").isin(*never) if never else F.lit(True), score)), 9).alias("score"), *(has(i).alias(f"c{i}") for i in must + never))
        for i in must:
            out = out.where(F.col(f"c{i}"))
        for i in never:
            out = out.where(~F.col(f"c{i}"))
        return out.where("score is not null").select("id", "score")

    def search(self, query: Query | str, k: int) -> DataFrame:
        """``id, score`` of the ``k`` best, ties to the smaller id."""
        parsed = parse_query(query) if isinstance(query, str) else query
        return self.scores(parsed).orderBy(F.desc("score"), "id").limit(k)


def _shift(by: int):
    return lambda p: p - by


def _phrase(hits: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """``id, field, tf``: how often the terms follow each other."""
    by_term = hits.groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    starts = F.try_element_at("at", F.lit(terms[0]))
    for i, t in enumerate(terms[1:], 1):
        there = F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>"))
        starts = F.array_intersect(starts, F.transform(there, _shift(i)))
    return by_term.select("id", "field", F.size(starts).alias("tf")).where("tf > 0")
