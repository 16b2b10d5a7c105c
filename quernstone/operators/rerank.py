"""Reranking by longest common subsequence of query and chunk tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.local import settled


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Bit-parallel: a bit for each place of a, one addition for each token of b that a has."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = rest = (1 << len(a)) - 1
    for y in b:
        if at := places.get(y):
            found = rest & at
            rest = (rest + found | rest - found) & full
    return (full ^ rest).bit_count()


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; 0 if one is null.

    An Arrow UDF: a table of rows built by native lambdas copies a row for each cell, which is too slow for long chunks.
    """

    @F.pandas_udf("int")
    def lengths(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([0 if x is None or y is None else common_length(x, y) for x, y in zip(left, right, strict=True)], dtype="int32")

    return lengths(a, b)


def with_tokens(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with query_tokens and tokens; chunks: chunk_id, tokens."""
    return settled(hits).join(chunks.select("chunk_id", "tokens"), "chunk_id").join(queries.select("query_id", F.col("tokens").alias("query_tokens")), "query_id")


def rerank(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """hits: query_id, rank, query_tokens, tokens. By LCS, ties by the rank before; empty queries stay as they are."""
    scored = hits.withColumn("lcs", lcs(F.col("query_tokens"), F.col("tokens")))
    order = Window.partitionBy("query_id").orderBy(F.col("lcs").desc(), "rank")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)
