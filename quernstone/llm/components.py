"""Connected components of a table of links, without collecting links or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.base import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: root is the least node of the component. Roots themselves have no row, nor have nodes without links.

    Alternating stars: each round ties every node to the least of its neighbours, first from the larger, then
    from the smaller neighbours. The minimum of a node is pre-aggregated, and it is joined back to the links, a
    join whose hot keys Spark can split; so a node with very many links stays spread. Null nodes are ignored.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    links, before = cut(links), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        links = cut(tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
