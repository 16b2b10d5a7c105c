"""Fusion of ranked lists, deduplication by document and hydration.

hits: query_id, chunk_id, score or distance, rank. Lists carry a weight and say whether they hold distances.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.local import settled

RRF_K, TOP_K, FLAT = 60, 10, 1e-6


@dataclass(frozen=True)
class Ranked:
    hits: DataFrame
    weight: float = 1.0
    is_distance: bool = False

    def rows(self, source: int) -> DataFrame:
        value = "distance" if "distance" in self.hits.columns else "score"
        return self.hits.select("query_id", "chunk_id", F.col(value).cast("double").alias("value"), F.col("rank").cast("long").alias("rank"), F.lit(float(self.weight)).alias("weight"), F.lit(self.is_distance).alias("is_distance"), F.lit(source).alias("source"))


def union(lists: Sequence[Ranked]) -> DataFrame:
    out = lists[0].rows(0)
    for i, r in enumerate(lists[1:], 1):
        out = out.unionByName(r.rows(i))
    return out


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: Sequence[Ranked], k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """Reciprocal ranks: the sum of weight / (k + rank)."""
    k = k if k > 0 else RRF_K
    return top(union(lists).groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score")), top_k)


def rsf(lists: Sequence[Ranked], top_k: int = TOP_K) -> DataFrame:
    """Relative scores: each list scaled to 0..1, distances turned round; a flat list is 1 throughout."""
    own = Window.partitionBy("query_id", "source")
    low, high, x = F.min("value").over(own), F.max("value").over(own), F.col("value")
    span = high - low
    scaled = F.when(span <= FLAT, 1.0).when(F.col("is_distance"), (high - x) / span).otherwise((x - low) / span)
    rows = union(lists).withColumn("scaled", scaled)
    return top(rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("scaled")).alias("score")), top_k)


def fuse(lists: Sequence[Ranked | None], method: str = "rrf", k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """Lists that aren't ready are None and skipped; a single one is passed on as it is, cut to top_k."""
    ready = [x for x in lists if x is not None]
    if not ready:
        raise ValueError("no list is ready")
    if len(ready) == 1:
        value = "distance" if "distance" in ready[0].hits.columns else "score"
        return ready[0].hits.select("query_id", "chunk_id", F.col(value).alias("score"), "rank").where(F.col("rank") <= top_k)
    return rrf(ready, k, top_k) if method == "rrf" else rsf(ready, top_k)


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the chunks' columns; ids that aren't there drop out, ranks stay. Few hits go to the chunks, whose texts are then not shuffled."""
    return settled(hits).join(chunks, "chunk_id")


def dedup(hits: DataFrame, limit: int | None = None, document: str = "document_id") -> DataFrame:
    """The best-ranked hit of each document, ranked anew."""
    first = Window.partitionBy("query_id", document).orderBy("rank")
    out = hits.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return out if limit is None else out.where(F.col("rank") <= limit)
