"""Readers of message, call and query files, and of HTML pages; writers of results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.functions import times

SMS = "_id string, body string, datetime string, date long, address string"
MMS = "_id string, text_combined string, sub string, date long, address string"
CALL = "conversation array<string>, summary_1line string, call_start_datetime string"
QUERY = "query_id long, query string, original_query string, target_corpus_ids array<string>, domains array<string>, catogory string, top_k int"
FILTER = "target_corpus_ids array<string>, target_corpus_id string, filters struct<time_window:struct<start_date:string,end_date:string>>, domains array<string>"
PATCH = "id string, ts long"
DOCUMENT = ("external_id", "content", "description", "created_at", "source_type", "sender")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of lines that start with a brace; blank, other and malformed lines are skipped."""
    lines = spark.read.text(path).where(F.btrim("value").startswith("{"))
    rows = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad")


def document(prefix: str, id_: Column, content: Column, created_at: Column, sender: Column, description: Column | None = None) -> list[Column]:
    return [
        F.concat(F.lit(f"{prefix}_"), id_).alias("external_id"), content.alias("content"), F.coalesce(description if description is not None else F.lit(None), F.lit("")).alias("description"),
        F.coalesce(created_at, F.lit(0)).cast("long").alias("created_at"), F.lit(times.PREFIXES[f"{prefix}_"]).cast("short").alias("source_type"), F.coalesce(sender, F.lit("")).alias("sender"),
    ]


def sms_documents(rows: DataFrame) -> DataFrame:
    """The written time counts before the epoch; blank bodies are dropped."""
    at = F.when(F.coalesce(F.col("datetime"), F.lit("")) != "", times.to_millis(F.col("datetime"))).otherwise(F.col("date"))
    return rows.select(*document("sms", F.col("_id"), tx.clean_document(F.col("body")), at, F.col("address"))).where("content != ''")


def mms_documents(rows: DataFrame) -> DataFrame:
    """Times under 1e12 are seconds."""
    at = F.when(F.col("date") < 1_000_000_000_000, F.col("date") * 1000).otherwise(F.col("date"))
    return rows.select(*document("mms", F.col("_id"), tx.clean_document(F.col("text_combined")), at, F.col("address"), F.col("sub"))).where("content != ''")


def spoken(lines: Column) -> Column:
    """What stands after the first colon of each `speaker: text` line; lines without are dropped."""
    said = F.transform(F.filter(lines, lambda s: s.rlike("(?s)^[^:]*:.")), lambda s: F.regexp_replace(s, "^[^:]*:", ""))
    return F.array_join(said, "\n")


def call_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a call, named by its id."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("_id"))
    return files.select("_id", F.from_json("value", CALL).alias("r")).select("_id", "r.*").where("conversation is not null")


def call_documents(rows: DataFrame) -> DataFrame:
    at = times.to_millis(F.col("call_start_datetime"))
    return rows.select(*document("call", F.col("_id"), tx.clean_document(spoken(F.col("conversation"))), at, F.lit(""), F.col("summary_1line"))).where("content != ''")


def pdf_documents(spark: SparkSession, path: str, extract) -> DataFrame:
    """Pages' texts joined by newlines. extract: an Arrow UDF from bytes to array<string>; this library ships none."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.pdf$", 1).alias("_id"), F.array_join(extract("content"), "\n").alias("body"))
    return files.select(*document("document", F.col("_id"), tx.clean_document(F.col("body")), F.lit(0), F.lit(""))).where("content != ''")


def queries(rows: DataFrame, raw_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, truth): external_id, content, categories, eval_top_k, domains; query_id, position, target_id.

    raw_ids: raw_id, external_id; targets match it in any case. Queries on images alone are dropped, those without targets stay.
    """
    text = tx.clean_query(F.coalesce(F.when(F.col("original_query") != "", F.col("original_query")), F.col("query")))
    named = F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: F.when(F.lower(d) == "message", "sms").otherwise(F.lower(d)))
    kept = rows.withColumn("domains", named).where((F.size("domains") == 0) | F.exists("domains", lambda d: d != "image"))
    out = kept.select(F.concat(F.lit("q_"), F.col("query_id").cast("string")).alias("external_id"), text.alias("content"), F.col("catogory").alias("categories"), F.col("top_k").alias("eval_top_k"), "domains", "target_corpus_ids")
    targets = out.select(F.col("external_id").alias("query_id"), F.posexplode("target_corpus_ids").alias("position", "raw"))
    ids = raw_ids.select(F.lower("raw_id").alias("raw_key"), F.col("external_id").alias("target_id"))
    truth = targets.join(ids, F.lower("raw") == F.col("raw_key")).select("query_id", "position", "target_id")
    return out.drop("target_corpus_ids"), truth


def filter_specs(rows: DataFrame) -> DataFrame:
    """target_id, start_date, end_date, domains: one row for each target."""
    targets = F.coalesce("target_corpus_ids", F.when(F.col("target_corpus_id").isNotNull(), F.array("target_corpus_id")), F.array().cast("array<string>"))
    window = F.col("filters.time_window")
    return rows.select(F.explode(targets).alias("target_id"), window["start_date"].alias("start_date"), window["end_date"].alias("end_date"), "domains")


def date_patch(spark: SparkSession, path: str) -> DataFrame:
    """external_id, ts of a patch file; times of 0 or less are left out. `store.set_created_at` applies it."""
    return json_lines(spark, path, PATCH).where("id is not null and ts > 0").select(F.col("id").alias("external_id"), "ts")


@dataclass(frozen=True)
class DocumentSource:
    """Where documents come from: rows gives a table with external_id and body, which are cleaned to the store's shape."""

    rows: Callable[[SparkSession], DataFrame]
    prefix: str = "document"

    def documents(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).select(*document(self.prefix, F.col("external_id"), tx.clean_document(F.col("body")), F.lit(0), F.lit(""))).where("content != ''")


def text_source(path: str) -> DocumentSource:
    """A document for each text file, named by it."""
    return DocumentSource(lambda spark: spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("external_id"), F.col("value").alias("body")))


def html_source(path: str, id_: str = "page_id", html: str = "html") -> DocumentSource:
    """A document for each row of a table of pages; tags go in cleaning."""
    return DocumentSource(lambda spark: spark.read.parquet(path).select(F.col(id_).cast("string").alias("external_id"), F.col(html).alias("body")))


def append_history(run: DataFrame, path: str) -> None:
    run.write.mode("append").json(path)
