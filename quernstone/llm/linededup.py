"""Line dedup: windows of three consecutive lines that occur before, in this text or another, are removed.

Every run of three lines is hashed (128 bits); the first occurrence of each, by (doc_id, text hash, place), stays. Lines
in any later occurrence go; overlapping and adjacent occurrences are merged to ranges first. Windows of
blank lines alone don't count. All in DataFrame functions: windows are pre-aggregated by hash (the least place
and a count), and only repeated ones are joined back, a join whose hot keys Spark can split. Texts move once,
in the join with their ranges.

Texts of fewer than three lines and null or empty texts stay as they are. Rows that share doc_id and text are one
document and share its result; null ids are ids like others and stand first. Empty tables give empty results.
Other columns stay (columns named like added ones are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.base import cut

ADDED = ("n_lines", "n_removed")


def lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def window_rows(docs: DataFrame) -> DataFrame:
    """ld_id, ld_hash, pos, h1, h2 of each window of docs (ld_id, ld_hash, ld_text)."""

    def window(i: F.Column) -> F.Column:
        three = [F.col("l")[i + k] for k in range(3)]
        return F.struct(i.alias("pos"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(3), *three).alias("h2"), (F.btrim(F.concat(*three), F.lit(" \t\r\n")) == "").alias("blank"))

    split = docs.select("ld_id", "ld_hash", lines(F.col("ld_text")).alias("l")).where(F.size("l") >= 3)
    found = split.select("ld_id", "ld_hash", F.inline(F.transform(F.sequence(F.lit(0), F.size("l") - 3), window)))
    return found.where("not blank").drop("blank")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its text cut, n_lines before and n_removed."""
    df = df.drop(*[c for c in df.columns if c.lower() in ADDED])
    docs = df.withColumns({"ld_id": F.col(f"`{key}`"), "ld_text": F.col(f"`{text}`").cast("string")}).withColumn("ld_hash", F.xxhash64("ld_text"))
    found = cut(window_rows(docs))
    place = F.struct("ld_id", "ld_hash", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last or not (first <=> last)").drop("last")
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("ld_id", "ld_hash", "pos")
    by_doc = Window.partitionBy("ld_id", "ld_hash").orderBy("pos")
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(by_doc) > 3, F.lit(True))
    marked = later.withColumn("range", F.sum(gap.cast("int")).over(by_doc))
    ranges = marked.groupBy("ld_id", "ld_hash", "range").agg(F.min("pos").alias("low"), (F.max("pos") + 3).alias("high"))
    ranges = ranges.groupBy("ld_id", "ld_hash").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ld_ranges")).withColumnsRenamed({"ld_id": "r_id", "ld_hash": "r_hash"})
    # the first hash joins; the id is compared null-safely
    docs = docs.join(ranges, (F.col("ld_hash") == F.col("r_hash")) & F.col("ld_id").eqNullSafe(F.col("r_id")), "left")
    all_lines = lines(F.col("ld_text"))
    lows = F.concat(F.transform("ld_ranges", lambda r: r["low"]), F.array(F.size(all_lines)))
    highs = F.concat(F.array(F.lit(0)), F.transform("ld_ranges", lambda r: r["high"]))
    kept = F.flatten(F.zip_with(highs, lows, lambda a, b: F.slice(all_lines, a + 1, b - a)))
    removed = F.aggregate("ld_ranges", F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"])
    out = docs.withColumn(text, F.when(F.col("ld_ranges").isNull(), F.col("ld_text")).otherwise(F.array_join(kept, "\n")))
    out = out.withColumn("n_lines", F.size(all_lines).cast("long")).withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS occurrence FROM w
  WHERE c IS NOT NULL AND trim(replace(replace(a || b || c, chr(9), ' '), chr(13), ' ')) <> ''),
covered AS (SELECT doc_id, pos FROM n WHERE occurrence > 1 UNION SELECT doc_id, pos + 1 FROM n WHERE occurrence > 1 UNION SELECT doc_id, pos + 2 FROM n WHERE occurrence > 1)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN c.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS text_sha256
FROM l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
"""
