"""Document and chunk tables: lookups, samples, writes as new snapshots, exchange of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import times
from quernstone.operators.paths import remove, shared_folder

DOCUMENTS = "document_id long, external_id string, content string, description string, created_at long, source_type short, sender string"
CHUNKS = "chunk_id long, document_id long, chunk_index int, content string, tokens array<string>, embedding array<float>"


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table under a fixed schema; an empty one where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def get(df: DataFrame, value, key: str = "document_id") -> DataFrame:
    """The row with this key, which is pushed to the scan; none if there is no such row."""
    return df.where(F.col(key) == F.lit(value))


def external_ids(docs: DataFrame) -> DataFrame:
    """A scan of the ids alone."""
    return docs.select("external_id")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def of_split(queries: DataFrame, split: str | None) -> DataFrame:
    """Queries of one split; all without one."""
    return queries.where(F.col("split") == split) if split else queries


def without(df: DataFrame, *names: str) -> DataFrame:
    """A scan that never reads these columns."""
    return df.drop(*names)


def each_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """f over Arrow batches, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, schema)


def missing_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNull() | (F.size("embedding") == 0))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key)


def first_chunks(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """The chunk of least chunk_index of each document, ties by chunk_id."""
    columns = F.struct(*chunks.columns)
    return chunks.groupBy(document).agg(F.min_by(columns, F.struct("chunk_index", "chunk_id")).alias("c")).select("c.*")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with `place`: the rank of key from 0. Keys are ranked by ranges, whose counts give each its start."""
    ranges = df.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id())
    shared_folder(df.sparkSession)
    ranges = ranges.checkpoint()  # a partition that ran anew could number its rows otherwise
    before = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    places = ranges.join(F.broadcast(before), "part").select(key, (own + F.col("before")).alias("place"))
    return df.join(places, key)


def stride_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows at floor(i * N / n) for i < n, by key (unique): the same rows each time."""
    total = df.count()
    if n >= total:
        return df
    # place p is picked if some i has floor(i * N / n) = p: i = ceil(p * n / N)
    i = F.floor((F.col("place") * n + total - 1) / F.lit(total))
    return numbered(df, key).where((i < n) & (F.floor(i * total / F.lit(n)) == F.col("place"))).drop("place")


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes that aren't null replace old ones by key; null and 0 keys change nothing."""
    named = [c for c in changes.columns if c != key]
    new = changes.where(F.col(key).isNotNull() & (F.col(key) != F.lit(0).cast(changes.schema[key].dataType))).select(key, *[F.col(c).alias(f"new_{c}") for c in named])
    joined = old.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in named else F.col(c) for c in old.columns])


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame, key: str = "document_id", cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    return delete(docs, ids, key), delete(chunks, ids, key) if cascade else chunks


def orphans(docs: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents without chunks."""
    return docs.join(chunks.select(key), key, "left_anti")


def set_created_at(docs: DataFrame, patch: DataFrame) -> DataFrame:
    """patch: external_id, ts; ts of 0 or less is ignored, of repeated ids the largest counts."""
    new = patch.where("ts > 0").groupBy("external_id").agg(F.max("ts").alias("ts"))
    return docs.join(new, "external_id", "left").withColumn("created_at", F.coalesce("ts", "created_at")).select(docs.columns)


def set_source_type(docs: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, one row with the number of changed ones). patch: external_id, new_type."""
    joined = docs.join(patch.groupBy("external_id").agg(F.max("new_type").alias("new_type")), "external_id", "left")
    changed = joined.agg(F.count_if(F.col("new_type").isNotNull() & ~F.col("new_type").eqNullSafe(F.col("source_type"))).alias("changed"))
    return joined.withColumn("source_type", F.coalesce("new_type", "source_type")).select(docs.columns), changed


def infer_source_type(docs: DataFrame) -> DataFrame:
    return docs.withColumn("source_type", F.coalesce(times.source_type(F.col("external_id")), F.col("source_type").cast("short")))


def is_patched(docs: DataFrame) -> bool:
    """Whether all ids with a known prefix have its type."""
    known = times.source_type(F.col("external_id"))
    return bool(docs.agg(F.coalesce(F.bool_and((known == F.col("source_type")) | known.isNull()), F.lit(True))).first()[0])


def skip_existing(new: DataFrame, old: DataFrame, key: str = "external_id") -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def import_embeddings(chunks: DataFrame, vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, one row: matched, bad_size, unmatched).

    vectors: doc_external_id, chunk_index, chunk_id, embedding. They match by the first two, else by chunk_id.
    """
    good = vectors.where(F.size("embedding") == size)
    keyed = good.groupBy("doc_external_id", "chunk_index").agg(F.min_by("embedding", "chunk_id").alias("by_key"))
    named = good.where("doc_external_id is null").groupBy("chunk_id").agg(F.first("embedding").alias("by_id"))
    out = chunks.join(keyed, ["doc_external_id", "chunk_index"], "left").join(named, "chunk_id", "left")
    out = out.withColumn("embedding", F.coalesce("by_key", "by_id", "embedding"))
    lost = good.where("doc_external_id is not null").join(chunks, ["doc_external_id", "chunk_index"], "left_anti").select("chunk_id")
    lost = lost.unionByName(good.where("doc_external_id is null").join(chunks, "chunk_id", "left_anti").select("chunk_id"))
    errors = vectors.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != size).alias("bad_size"))
    errors = errors.crossJoin(lost.agg(F.count("*").alias("unmatched")))
    return out.select(chunks.columns), errors.select((F.col("n") - F.col("bad_size") - F.col("unmatched")).alias("matched"), "bad_size", "unmatched")


def export_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "doc_external_id", "chunk_index", "content", F.lit(None).cast("array<float>").alias("embedding"))


def export_queries(queries: DataFrame) -> DataFrame:
    return queries.select("external_id", F.coalesce(F.when(F.col("refined_query") != "", F.col("refined_query")), F.col("content")).alias("content"))


def page(df: DataFrame, key: str, offset: int, limit: int, text: str = "content", size: int = 300) -> DataFrame:
    """JSON of a page of rows by key, texts cut to `size` bytes."""
    from quernstone.functions.text import truncate_utf8

    rows = df.orderBy(key).offset(offset).limit(limit)
    return rows.select(key, F.to_json(F.struct(*[truncate_utf8(F.col(c), size).alias(c) if c == text else F.col(c) for c in df.columns])).alias("json"))


def to_json(df: DataFrame, *columns: str) -> Column:
    return F.to_json(F.struct(*(columns or df.columns)))


def item_json(docs: DataFrame, value, chunks: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """json of the row with this key, with its chunks in their order if they are given."""
    row = get(docs, value, key)
    if chunks is not None:
        own = get(chunks, value, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", *[c for c in chunks.columns if c not in ("chunk_index", key)]))).alias("chunks"))
        row = row.join(own, key, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(own.schema["chunks"].dataType)))
    return row.select(key, to_json(row).alias("json"))


RESULT = "array<struct<chunk_id:long,document_id:long,content:string,score:double>>"


def results_to_json(hits: DataFrame) -> DataFrame:
    """query_id, json: the hits of each query in the order of their ranks."""
    one = F.struct("rank", F.struct("chunk_id", "document_id", "content", "score").alias("h"))
    return hits.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"])).alias("json"))


def results_from_json(rows: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, document_id, content, score; malformed JSON has no hits."""
    hits = rows.select("query_id", F.posexplode(F.from_json("json", RESULT)).alias("at", "h"))
    return hits.select("query_id", (F.col("at") + 1).alias("rank"), "h.*")


def import_query_embeddings(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with embeddings, one row: matched, bad_size, unmatched). vectors: external_id, embedding of any length but 0."""
    good = vectors.where(F.size("embedding") > 0).groupBy("external_id").agg(F.first("embedding").alias("new"))
    old = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<float>")
    out = queries.join(good, "external_id", "left").withColumn("embedding", F.coalesce("new", old)).drop("new")
    lost = vectors.where(F.size("embedding") > 0).join(queries, "external_id", "left_anti").agg(F.count("*").alias("unmatched"))
    errors = vectors.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) < 1).alias("bad_size")).crossJoin(lost)
    return out, errors.select((F.col("n") - F.col("bad_size") - F.col("unmatched")).alias("matched"), "bad_size", "unmatched")


def remove_all(docs: DataFrame, chunks: DataFrame, *indexes: str) -> tuple[DataFrame, DataFrame]:
    """Empty tables of the same columns; the folders of indexes are deleted."""
    for path in indexes:
        remove(docs.sparkSession, path)
    return docs.where(F.lit(False)), chunks.where(F.lit(False))


def remove_chunks(chunks: DataFrame, *indexes: str) -> DataFrame:
    return remove_all(chunks, chunks, *indexes)[1]
