"""Retrieval pipelines: lexical, semantic and hybrid search over an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.operators import fusion, ranking
from quarry.operators.lexical import Index
from quarry.operators.vector import VectorIndex

TOP_K = 10
SEARCH_TYPES = {"lexical": "lexical", "bm25": "lexical", "semantic": "semantic", "vector": "semantic", "ann": "semantic", "hybrid": "hybrid"}


def search_type(name: str) -> str:
    try:
        return SEARCH_TYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown search type: {name}") from None


@dataclass(frozen=True)
class Fusion:
    """Reciprocal ranks, or weighted scores where ``lexical_share`` is given."""

    k: float = fusion.RRF_K
    lexical_share: float | None = None


@dataclass
class SearchEngine:
    lexical: Index
    vectors: VectorIndex
    chunks: DataFrame
    files: DataFrame

    def stats(self) -> DataFrame:
        return self.lexical.count().join(self.vectors.count())

    def _finish(self, hits: DataFrame, query: str) -> DataFrame:
        results = ranking.hydrate(ranking.with_rank(hits), self.chunks, self.files)
        return ranking.rerank(results, query)

    def search_lexical(self, query: str, k: int = TOP_K) -> DataFrame:
        return self._finish(self.lexical.search(query, k), query)

    def search_semantic(self, query: str, vector: list[float], k: int = TOP_K) -> DataFrame:
        return self._finish(self.vectors.search(vector, k), query)

    def search_hybrid(self, query: str, vector: list[float], k: int = TOP_K, how: Fusion = Fusion()) -> DataFrame:
        """Both lists' first k, fused and cut to k."""
        lists = fusion.as_list(self.lexical.search(query, k), "lexical").unionByName(fusion.as_list(self.vectors.search(vector, k), "semantic"))
        fused = fusion.reciprocal_rank(lists, how.k) if how.lexical_share is None else fusion.weighted(lists, fusion.two_weights(how.lexical_share))
        return self._finish(fusion.top(fused, k), query)

    def search(self, query: str, kind: str, vector: list[float] | None = None, k: int = TOP_K, how: Fusion = Fusion(), dedupe: bool = False, threshold: float = 0.5) -> DataFrame:
        """Overlap removal comes after the cut to k, so that fewer rows may be left."""
        kind = search_type(kind)
        if kind != "lexical" and vector is None:
            raise ValueError("semantic search needs a query vector")
        if kind == "lexical":
            out = self.search_lexical(query, k)
        elif kind == "semantic":
            out = self.search_semantic(query, vector, k)
        else:
            out = self.search_hybrid(query, vector, k, how)
        return ranking.drop_overlaps(out, threshold) if dedupe else out
