"""A training corpus from documents: five operators, one after the other.

Every stage takes any table with doc_id, text, source and n_chars. Further columns pass through whatever their names, also
those that an operator adds columns of (they are set aside under other names while it works). Null and empty texts are clean,
have no lines to remove, link with nothing and hit nothing, so they reach the mix, which takes no document without words. Null ids are
ids like others but for the mix's keys, which they share. Rows that repeat id and text share every decision; the Jaccard join leaves one of
them. Ties go to the least doc_id (null last), then to the least hash of the text. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontam, jaccard, linededup, mixing, toxicity
from quernstone.llm.base import small

OWN = ("doc_id", "text", "source", "n_chars")


def aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of docs, in docs' columns: those it doesn't need have other names meanwhile."""
    others = {c: f"aside_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    out = work(docs.withColumnsRenamed(others))
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the classifier learns from the labels of these documents."""
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.held_out()))
    return aside(docs, lambda d: toxicity.score(d, model, out="toxicity").where("toxicity < 0.5"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that occur before; n_chars follows the text."""
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return aside(docs, lambda d: linededup.dedup(d).withColumn("n_chars", n_chars))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), the row with the least doc_id; of rows that repeat it whole, one."""
    gone, repeated = jaccard.surplus(docs)
    named = docs.withColumn("nc_hash", jaccard.text_hash(F.col("text")))
    same = lambda other: (named["nc_hash"] == other["nc_hash"]) & named["doc_id"].eqNullSafe(other["doc_id"])
    kept = named.join(small(gone, gone.count()), same(gone), "left_anti")
    if n := repeated.count():
        once = small(repeated, n)
        several = kept.join(once, same(once), "left_semi").dropDuplicates(["doc_id", "nc_hash"])
        kept = kept.join(once, same(once), "left_anti").unionByName(several)
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return aside(docs, lambda d: decontam.find(d, items).where(decontam.hits() == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("mixing sources", mix_sources)]

#: A trained classifier isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
