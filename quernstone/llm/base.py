"""What the operators share on the driver: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.paths import shared_folder

#: Rows up to which a narrow table (under 100 bytes a row) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the session names; a folder of our own only on a local master without one."""
    sc, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a counted narrow table, only while its count keeps it small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashed(df: DataFrame, n: int, by: list[str], key: str) -> DataFrame:
    """About the n rows of each group that have the least hash of key, n at most; the hash stays as column `h`.

    Only rows whose hash lies under twice the share that n rows have of their group are ranked, so that no task gets
    more rows than that, however many rows and tasks there are. Null keys are left out.
    """
    df = df.where(F.col(key).isNotNull()).withColumn("h", F.xxhash64(key))
    low, high = float(-(1 << 63)), float(1 << 64)
    if by:
        sizes = df.groupBy(*by).agg(F.count("*").alias("lh_size")).withColumnsRenamed({c: f"lh_{c}" for c in by})
        few = df.join(F.broadcast(sizes), [df[c] == F.col(f"lh_{c}") for c in by]).where(F.col("h") <= low + high * F.least(F.lit(1.0), (2 * n + 100) / F.col("lh_size")))
    else:
        few = df.where(F.col("h") <= low + high * min(1.0, (2 * n + 100) / max(1, df.count())))
    order = Window.partitionBy(*by).orderBy("h", key)
    return few.withColumn("lh_n", F.row_number().over(order)).where(F.col("lh_n") <= n).select(*df.columns, F.col("lh_n").alias("n"))


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows left-joined with their group; groups has a row for each key that isn't null, with `size`, the number of its rows.

    Groups that hold more rows than an average partition are at most as many as partitions: those are broadcast, so that
    their rows stay where they are; only rows of the others are dealt by key. Rows without a key aren't dealt either.
    """
    limit = max(1, (groups.agg(F.sum("size")).first()[0] or 0) // partitions(rows.sparkSession))
    heavy, light = groups.where(F.col("size") > limit), groups.where(F.col("size") <= limit)
    found = rows.join(F.broadcast(heavy), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    none = rows.where(F.col(key).isNull())
    return found.unionByName(rest).unionByName(none, allowMissingColumns=True).drop("size")
