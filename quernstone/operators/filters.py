"""Metadata filters: JSON to predicates, and filters of query sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import times

#: What may be found: chunk_id, or query_id and chunk_id, or a function that filters hits (query_id, chunk_id, ...).
Allowed = DataFrame | Callable[[DataFrame], DataFrame]
RANGES = {"gte": "__ge__", "lte": "__le__", "gt": "__gt__", "lt": "__lt__"}


def one_of(column: Column, value) -> Column:
    return column.isin(value["in"]) if isinstance(value, dict) else column == value


def predicate(text: str) -> Column:
    """{"source_type": n or {"in": [..]}, "sender": s, "document_id": ..., "created_at": n or ranges}; all must hold."""
    spec = json.loads(text) if text else {}
    out = F.lit(True)
    for key in ("source_type", "document_id"):
        if key in spec:
            out &= one_of(F.col(key), spec[key])
    if "sender" in spec:
        out &= F.col("sender") == spec["sender"]
    if "created_at" in spec:
        at = spec["created_at"]
        for name, value in (at.items() if isinstance(at, dict) else [("eq", at)]):
            out &= getattr(F.col("created_at"), RANGES[name])(value) if name in RANGES else F.col("created_at") == value
    return out


def allowed_ids(chunks: DataFrame, text: str) -> DataFrame:
    return chunks.where(predicate(text)).select("chunk_id")


@dataclass(frozen=True)
class Pairs:
    """The pairs of ids that fit, and of `chunks` (chunk_id) alone if given. fits takes columns as well as NumPy arrays, so that pairs needn't be written out."""

    fits: Callable
    chunks: DataFrame | None = None

    def __call__(self, hits: DataFrame) -> DataFrame:
        return restrict(hits.where(self.fits(F.col("query_id"), F.col("chunk_id"))), self.chunks)


@dataclass(frozen=True)
class Predicates:
    """`passing` of these filters and chunks; a search that reads chunks takes the filters along instead of joining its hits."""

    wanted: DataFrame
    chunks: DataFrame

    def __call__(self, hits: DataFrame) -> DataFrame:
        return passing(hits, self.wanted, self.chunks)


def by_chunk(allowed: Allowed | None) -> bool:
    """Whether it holds for all queries alike."""
    return isinstance(allowed, DataFrame) and "query_id" not in allowed.columns


def restrict(hits: DataFrame, allowed: Allowed | None) -> DataFrame:
    if allowed is None:
        return hits
    if callable(allowed):
        return allowed(hits)
    return hits.join(allowed, [c for c in ("query_id", "chunk_id") if c in allowed.columns], "left_semi")


def wanted(specs: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, types, low, high: the filter of each query's first target, as a predicate; a row a query.

    specs: target_id, start_date, end_date, domains. truth: query_id, position, target_id.
    """
    domain = F.create_map(*[x for name, n in times.ALIASES.items() for x in (F.lit(name), F.lit(n))])
    first = truth.groupBy("query_id").agg(F.min_by("target_id", "position").alias("target_id"))
    return first.join(specs, "target_id").select(
        "query_id", F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: domain[F.lower(d)]).alias("types"),
        times.day_start(F.col("start_date")).alias("low"), times.day_end(F.col("end_date")).alias("high"),
    )


def inside() -> Column:
    """Whether source_type and created_at fit types, low and high."""
    return (F.col("low").isNull() | F.col("high").isNull() | F.col("created_at").between(F.col("low"), F.col("high"))) & ((F.size("types") == 0) | F.array_contains("types", F.col("source_type")))


def matching(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id of the filters that some chunk fits. Chunks are counted by type and day first: windows are whole days."""
    day = F.floor((F.col("created_at") + times.OFFSET_MILLIS) / 86_400_000) * 86_400_000 - times.OFFSET_MILLIS
    days = chunks.select("source_type", day.alias("created_at")).distinct()
    return wanted.join(days, inside()).select("query_id").distinct()


def passing(hits: DataFrame, wanted: DataFrame, chunks: DataFrame, fallback: bool = False) -> DataFrame:
    """hits that fit their query's filter; queries without a filter keep all theirs.

    A filter that no chunk fits leaves nothing; with fallback its query goes unfiltered. Predicates stay one row a query,
    and only hits are joined to chunks (chunk_id, source_type, created_at).
    """
    if fallback:
        wanted = wanted.join(matching(wanted, chunks), "query_id", "left_semi")
    found = hits.join(chunks.select("chunk_id", "source_type", "created_at"), "chunk_id").join(wanted, "query_id", "left")
    return found.where(F.col("types").isNull() | inside()).select(hits.columns)


def query_filters(specs: DataFrame, truth: DataFrame, chunks: DataFrame, fallback: bool = False) -> DataFrame:
    """query_id, chunk_id: all pairs that `passing` would keep of filtered queries, written out; searches take `passing` itself."""
    filters = wanted(specs, truth)
    found = filters.join(chunks, inside()).select("query_id", "chunk_id")
    if fallback:
        free = filters.join(matching(filters, chunks), "query_id", "left_anti").select("query_id")
        found = found.unionByName(free.crossJoin(chunks.select("chunk_id")))
    return found
