"""Retrievers over one store, and ensembles of them: each plans one DataFrame for a batch of queries.

queries: query_id, tokens, embedding; a retriever reads only what it needs. Hits: query_id, chunk_id, score or
distance, rank. A retriever that isn't ready is skipped by an ensemble.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import embed
from quernstone.functions import text as tx
from quernstone.operators import bm25, evaluate, fusion, rerank, vector_index
from quernstone.operators.filters import Allowed


class Retriever(Protocol):
    is_distance: bool

    def ready(self) -> bool: ...
    def needs(self) -> set[str]: ...
    def retrieve(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None) -> DataFrame: ...


def summary(spec) -> list[str]:
    """Parameters that differ from their defaults."""
    plain = (int, float, str, bool)
    return [f"{f.name}={getattr(spec, f.name)}" for f in fields(spec) if isinstance(f.default, plain) and getattr(spec, f.name) != f.default]


@dataclass
class Bm25:
    index: bm25.Index | None
    params: bm25.Params = bm25.Params()
    rm3: bm25.Rm3 | None = None
    prune: bool = False
    is_distance = False

    def ready(self) -> bool:
        return self.index is not None

    def needs(self) -> set[str]:
        return {"tokens"}

    def by_tokens(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None) -> DataFrame:
        """Given tokens are searched as they are: RM3 belongs to searches by text."""
        return replace(self, rm3=None).retrieve(queries, allowed, top_k)

    def retrieve(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None) -> DataFrame:
        p = self.params if top_k is None else replace(self.params, top_k=top_k)
        terms = bm25.query_terms(queries)
        if self.rm3:
            return bm25.rm3_search(self.index, terms, p, self.rm3, allowed, self.prune)
        return (bm25.pruned if self.prune else bm25.exact)(self.index, terms, p, allowed)


@dataclass
class Vector:
    """Exact without centroids; by clusters with them; filtered after the search if post_filter."""

    vectors: DataFrame | None
    centroids: DataFrame | None = None
    top_k: int = 11
    nprobe: int = 4
    post_filter: bool = False
    max_results: int = 100
    is_distance = True

    def ready(self) -> bool:
        return self.vectors is not None

    def needs(self) -> set[str]:
        return {"embedding"}

    def retrieve(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None) -> DataFrame:
        k = top_k or self.top_k
        if self.centroids is not None:
            return vector_index.search(queries, self.vectors, self.centroids, k, self.nprobe, allowed)
        if self.post_filter and allowed is not None:
            return vector_index.post_filtered(queries, self.vectors, allowed, k, self.max_results)
        return vector_index.brute_force(queries, self.vectors, k, allowed)


@dataclass
class Reranked:
    """The inner retriever's best pool * top_k, by subsequence of tokens, cut to top_k. chunks: chunk_id, tokens."""

    inner: Retriever
    chunks: DataFrame
    top_k: int = 11
    pool: int = 3
    is_distance = False

    def ready(self) -> bool:
        return self.inner.ready()

    def needs(self) -> set[str]:
        return self.inner.needs() | {"tokens"}

    def retrieve(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None) -> DataFrame:
        k = top_k or self.top_k
        found = self.inner.retrieve(queries, allowed, k * self.pool)
        return rerank.rerank(rerank.with_tokens(found, queries, self.chunks), k).select("query_id", "chunk_id", F.col("lcs").cast("double").alias("score"), "rank")


@dataclass(frozen=True)
class Weighted:
    retriever: Retriever
    weight: float = 1.0
    top_k: int | None = None


@dataclass
class Ensemble:
    """Members run with their own depth if given, else candidate_k, else the ensemble's."""

    members: Sequence[Weighted]
    method: str = "rrf"
    rrf_k: int = fusion.RRF_K
    top_k: int = fusion.TOP_K
    candidate_k: int | None = None
    is_distance = False

    def ready(self) -> bool:
        return any(m.retriever.ready() for m in self.members)

    def needs(self) -> set[str]:
        return set().union(*(m.retriever.needs() for m in self.members if m.retriever.ready()))

    def retrieve(self, queries: DataFrame, allowed: Allowed | None = None, top_k: int | None = None, depths: Sequence[int | None] | None = None) -> DataFrame:
        """depths: the members' own ones for this call, one each; None leaves a member's."""
        k = top_k or self.top_k
        if depths is not None and len(depths) != len(self.members):
            raise ValueError(f"{len(depths)} depths for {len(self.members)} members")
        own = depths or [None] * len(self.members)
        lists = [fusion.Ranked(m.retriever.retrieve(queries, allowed, d or m.top_k or self.candidate_k or k), m.weight, m.retriever.is_distance) if m.retriever.ready() else None for m, d in zip(self.members, own, strict=True)]
        return fusion.fuse(lists, self.method, self.rrf_k, k)


def features(texts: DataFrame, needs: set[str], embedder: embed.Embedder | None = None, tokenize: Callable[[Column], Column] = tx.tokens, compose: bool = True) -> DataFrame:
    """texts (query_id, text, and refined_text where a query has been reworded) with what retrievers need of them.

    The refined text, if it isn't empty, is embedded; tokens are always of the original.
    """
    refined = F.coalesce(F.when(F.col("refined_text") != "", F.col("refined_text")), F.col("text")) if "refined_text" in texts.columns else F.col("text")
    out = {}
    if "tokens" in needs:
        out["tokens"] = tokenize(tx.clean_query(F.col("text"), compose))
    if "embedding" in needs:
        if embedder is None:
            raise ValueError("these retrievers need an embedder")
        out["embedding"] = embedder.column(tx.clean_query(refined, compose))
    return texts.select("query_id", *[c.alias(name) for name, c in out.items()])


def retrieve_texts(retriever: Retriever, texts: DataFrame, embedder: embed.Embedder | None = None, allowed: Allowed | None = None, top_k: int | None = None, tokenize: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """Hits of texts: only the features that the ready retrievers need are computed."""
    return retriever.retrieve(features(texts, retriever.needs(), embedder, tokenize), allowed, top_k)


def retrieve_at_depth(retriever: Retriever, queries: DataFrame, depths: DataFrame, allowed: Allowed | None = None) -> DataFrame:
    """Queries with many targets (`evaluate.depths`) are searched deeper, the others at the retriever's own depth."""
    deep = depths.where(F.col("retrieval_k") == evaluate.LARGE_K).select("query_id")
    far = retriever.retrieve(queries.join(deep, "query_id", "left_semi"), allowed, evaluate.LARGE_K)
    return far.unionByName(retriever.retrieve(queries.join(deep, "query_id", "left_anti"), allowed))


def sweep(queries: DataFrame, retrievers: dict[str, Retriever], evaluate) -> DataFrame:
    """One row of metrics for each retriever. evaluate: (name, hits) to a DataFrame."""
    out = None
    for name, r in retrievers.items():
        one = evaluate(name, r.retrieve(queries))
        out = one if out is None else out.unionByName(one)
    return out
