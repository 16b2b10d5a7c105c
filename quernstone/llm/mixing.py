"""Mixing sources to target weights: each source is cut to its exact budget in a hash-random order, repeated if needed.

Sources by code point, null last, weigh 5, 2, 1, repeating, and share `share` of all sizes; a target stops at
`max_epochs` times its source's size, and what is over is shared again by weight among the others. A document's size
is its number of words; its key is a hash of seed and id. A source's budget is its target, rounded: as many whole
epochs as fit, then documents in the order of their keys until the rest is used up, the last one in part.

All in DataFrame functions. Keys are spread over RANGES ranges, whatever the source, so a source with a third of all
rows is sorted in RANGES parts; totals by (source, range) give each range what stands before it. Only numbers move:
texts are read once, for their sizes. Sources are ranked the same way, by ranges; the shares need a few sums each round.

Null and empty texts have size 0 and are never taken; null sources are one source. Null and repeated ids share a key:
`plan` has a row for each row, and `mix` gives rows that share an id the largest share that one of them has. Empty tables give empty results. Other columns stay, in `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.base import cut, small

WEIGHTS = (5, 2, 1)
RANGES_DIGITS = 3  # hexadecimal digits of the key: 4096 ranges


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place` from 0, by code point, null last: a distributed prefix sum over sorted ranges."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered)
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.join(F.broadcast(before), "part").withColumn("place", own + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """source, source_size, target of docs' sizes (source, size)."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("most")))
    whole, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = (whole or 0) * share
    level, stopped = wanted / (all_weights or 1), -1
    while True:  # ends: each round stops one more source at least
        n, used, left = sources.agg(F.count_if(F.col("weight") * level > F.col("most")), F.sum(F.when(F.col("weight") * level > F.col("most"), F.col("most")).otherwise(0.0)), F.sum(F.when(F.col("weight") * level > F.col("most"), 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not left:
            break
        level, stopped = (wanted - used) / left, n
    return sources.select("source", "source_size", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """key, size, source_size, target, taken for each document."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text).cast("string")).alias("size"), digest.alias("h")))
    rows = rows.withColumn("range", F.substring("h", 1, RANGES_DIGITS))
    goal = targets(rows.select("source", "size"), weights, share, max_epochs)
    # what stands before each range of keys, within its source
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("range_before"))
    sums = sums.join(goal.withColumnRenamed("source", "g"), F.col("s").eqNullSafe(F.col("g")))
    own = F.sum("size").over(Window.partitionBy("source", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.withColumn("own_before", own)
    placed = placed.join(small(sums, sums.count()), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("range_before") - F.col("own_before")
    taken = (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")
    return placed.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs that the mix takes, with size, source_size, target and taken: words taken, repeats counted."""
    key = options.get("key", "doc_id")
    added = ("size", "source_size", "target", "taken")
    chosen = plan(docs, **options).where("taken > 0").groupBy(F.col(key).alias("mix_key")).agg(*[F.max(c).alias(c) for c in added])
    words = docs.where(F.col(options.get("text", "text")).cast("string").rlike(r"[^\x20\x09-\x0D]"))
    return words.drop(*[c for c in docs.columns if c.lower() in added]).join(chosen, F.col(key).eqNullSafe(F.col("mix_key"))).drop("mix_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS most, CAST(CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM r),
c AS (SELECT source, source_size, most, weight, sum(most) OVER o - most AS used, sum(weight) OVER o - weight AS gone FROM w
  WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS whole, sum(weight) AS weights FROM w),
v AS (SELECT c.source, c.source_size, c.most, c.weight, (t.whole - c.used) / (t.weights - c.gone) AS lvl FROM c, t),
f AS (SELECT max(lvl) AS lvl FROM v),
g AS (SELECT v.source, v.source_size, least(v.weight * f.lvl, v.most) AS target FROM v, f),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
