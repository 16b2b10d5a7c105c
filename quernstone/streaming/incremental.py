"""Vectors that arrive as a stream, added to a stored cluster index without retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.vector_index import assign, load


def earlier(spark: SparkSession, path: str, number: int, key: str) -> DataFrame:
    """Keys that batches before this one added."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/added").where(F.col("batch") < number).select(key)
    except AnalysisException:  # nothing was added
        return spark.read.parquet(f"{path}/vectors").select(key).limit(0)


def add_vectors(stream: DataFrame, path: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Assigns each batch to the nearest centroids and appends it by cluster; starts the query.

    A batch that is repeated after a failure isn't added twice: its own part of the path is replaced. Keys that are in the
    index already, from its build or an earlier batch, aren't added again. `vector_index.load` gives both.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _, centroids = load(spark, path)
        before = spark.read.parquet(f"{path}/vectors").select(key).unionByName(earlier(spark, path, number, key))
        new = assign(batch.dropDuplicates([key]).join(before, key, "left_anti"), centroids)
        new.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/added/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
