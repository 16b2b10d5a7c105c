"""URL filters: a trie of reversed host labels, each with its paths, broadcast; the longest match decides.

A rule is (verdict, "host/path"). It fits its host and all subdomains where the url's path starts with the
rule's. More host labels win over fewer, then the longer path; of equal rules, block wins.
The trie holds at most MAX_RULES rules; `judge_by_join` takes any number of rules, as a table.

Null urls and urls without "://" have an empty host and path; no rule fits an empty host. Ports and user names
stay part of the host. Empty tables give empty results; repeated rows each get their verdict; other columns stay
(columns named like the four added ones are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 2_000_000
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATHS = ""  # the key of a node's paths; labels between dots of a rule's host aren't empty


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.translate(LOWER), "/" + path


def build(rules: Iterable[tuple[str, str]]) -> dict:
    """Nodes by host label from the right; under PATHS a trie of path segments.

    A path's node holds, under "=", the rules that end inside the next segment: (rest, verdict, rule).
    """
    top: dict = {}
    for n, (verdict, rule) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"over {MAX_RULES} rules: use judge_by_join")
        host, path = split_rule(rule)
        node = top
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, rest = path[1:].split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault("=", []).append((rest, verdict, rule))
    return top


def parts(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the deepest host node that has a fitting path, there of the longest."""
    if not path:
        return None, None
    nodes, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(label) if label else None
        if node is None:
            break
        if PATHS in node:
            nodes.append(node[PATHS])
    segments = path[1:].split("/")
    for node in reversed(nodes):
        best = None
        for segment in segments:
            fits = [(len(rest), verdict, rule) for rest, verdict, rule in node.get("=", ()) if segment.startswith(rest)]
            best = max(fits, default=best)
            node = node.get(segment)
            if node is None:
                break
        if best:
            return best[2], best[1]
    return None, None


def judge(df: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict."""
    spark = df.sparkSession
    trie = spark.sparkContext.broadcast(build(rules))
    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").cast("string").alias("rule"))
    schema = T.StructType([*df.schema.fields[:-1], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for u in batch.column(batch.num_columns - 1).to_pylist():
                host, path = parts(u)
                rule, verdict = longest(trie.value, host, path)
                hosts.append(host), paths.append(path), found.append(rule), verdicts.append(verdict or default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], [*batch.schema.names[:-1], "host", "path", "rule", "verdict"])

    return df.mapInArrow(run, schema)


def judge_by_join(df: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for any number of rules (columns verdict, rule): a join on host suffixes.

    key names a unique column. A url has as many rows in the join as its host has labels.
    """
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.select(F.col(key).alias("id"), lower(F.substring_index(rest, "/", 1)).alias("host"), F.regexp_extract(rest, "(?s)^[^/]*(/.*)?$", 1).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = df.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    rules = rules.select("verdict", "rule", lower(F.substring_index("rule", "/", 1)).alias("suffix"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"))
    fits = suffixes.join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    order = F.struct(F.size(F.split("suffix", r"\.")), F.length("start"), F.col("verdict"))
    best = fits.groupBy("id").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    return df.join(best, "id", "left").select(F.col("id").alias(key), "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH rules(verdict, rule, h, p) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
split AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
fits AS (SELECT s.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id
      ORDER BY length(r.h) - length(replace(r.h, '.', '')) DESC, length(r.p) DESC) AS n
    FROM split s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.n = 1
"""
