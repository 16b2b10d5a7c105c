"""Evaluation: Hit@K and adaptive Recall@K over a query set, and per-query details."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.fusion import dedup

LARGE_K, LARGE_EVAL_K = 100, 50


def resolve(truth: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, document_id: targets by external id; unknown ones drop out."""
    return truth.join(docs.select(F.col("external_id").alias("target_id"), "document_id"), "target_id").select("query_id", "document_id").distinct()


def depths(queries: DataFrame, truth: DataFrame, top_k: int) -> DataFrame:
    """query_id, n_targets, retrieval_k, eval_k: deeper for queries with more than top_k targets."""
    n = truth.groupBy("query_id").agg(F.count("*").alias("n_targets"))
    out = queries.select("query_id").join(n, "query_id", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    many = F.col("n_targets") > top_k
    return out.withColumn("retrieval_k", F.when(many, LARGE_K).otherwise(top_k)).withColumn("eval_k", F.when(many, LARGE_EVAL_K).otherwise(top_k))


def by_query(queries: DataFrame, hits: DataFrame, truth: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, n_targets, eval_k, hits, hit, recall. hits: query_id, document_id, rank; queries: those with a vector."""
    ranked = dedup(hits).join(depths(queries, truth, top_k), "query_id").where(F.col("rank") <= F.col("eval_k"))
    found = ranked.join(truth, ["query_id", "document_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    out = depths(queries, truth, top_k).join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    recall = F.when(F.col("n_targets") > 0, F.col("hits") / F.col("n_targets")).otherwise(0.0)
    return out.select("query_id", "n_targets", "eval_k", "hits", (F.col("hits") > 0).cast("int").alias("hit"), recall.alias("recall"))


def summary(rows: DataFrame, method: str, total_ms: float | None = None) -> DataFrame:
    """One row: method, queries, hit_rate, recall; with the time of a timed batch also total_ms and avg_ms a query."""
    out = rows.agg(F.count("*").alias("queries"), (100 * F.avg("hit")).alias("hit_rate"), (100 * F.avg("recall")).alias("recall")).select(F.lit(method).alias("method"), "queries", "hit_rate", "recall")
    return out if total_ms is None else out.withColumns({"total_ms": F.lit(float(total_ms)), "avg_ms": F.lit(float(total_ms)) / F.greatest("queries", F.lit(1))})


def timed(hits: DataFrame, path: str) -> tuple[DataFrame, float]:
    """(the hits as written to path, milliseconds that retrieving them took): evaluation reads them and isn't timed."""
    began = time.perf_counter()
    hits.write.mode("overwrite").parquet(path)
    return hits.sparkSession.read.parquet(path), 1000 * (time.perf_counter() - began)


def methods(rows: list[DataFrame]) -> DataFrame:
    """The summaries of several methods with `place`, from the best on."""
    from functools import reduce

    from pyspark.sql import Window

    table = reduce(DataFrame.unionByName, rows)
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.col("hit_rate").desc(), F.col("recall").desc(), "method")))  # a row for each method


def best(methods: DataFrame) -> DataFrame:
    return methods.orderBy(F.col("hit_rate").desc(), F.col("recall").desc(), "method").limit(1)


def details(parts: dict[str, DataFrame]) -> DataFrame:
    """query_id, results: for each method the JSON of its ranked documents."""
    rows = None
    for name, hits in parts.items():
        one = hits.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda h: h["document_id"])).alias("docs"))
        one = one.select("query_id", F.lit(name).alias("method"), "docs")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "docs")))).alias("results"))


def write_details(parts: dict[str, DataFrame], path: str) -> None:
    """A line of JSON for each query and method, as they come: query_id, method, documents in their order."""
    for name, hits in parts.items():
        docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda h: h["document_id"])
        hits.groupBy("query_id").agg(docs.alias("documents")).withColumn("method", F.lit(name)).write.mode("append").json(path)


def read_details(spark, path: str, document: str = "long") -> DataFrame:
    """query_id, results (method to documents) of written lines, merged by query."""
    rows = spark.read.schema(f"query_id long, method string, documents array<{document}>").json(path)
    return rows.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "documents")))).alias("results"))
