"""Document fingerprints: SimHash of weighted term hashes, and permuted block tables to find near ones.

A term is a run of five consecutive words (lower-cased; a shorter text is one term), its weight 1 to 8 by length: runs of short,
frequent words tell less. Each of 128 bits is the sign of the weighted votes of all term hashes. Four votes of 16 bits share one
64-bit sum, over at most 4096 terms at a time, so that a term costs 32 additions in generated code; wider sums join the parts.
Likeness of fingerprints is the cosine that their Hamming distance estimates, 0 at least.

`edited` pairs each document with the next one by descending id. Ranges of ids (quantiles, a few for each partition)
are the only thing that texts are dealt by: pairing, votes and neighbours' fingerprints all reuse that one shuffle.
Each range's first document is copied into the range before it.

`near` finds all fingerprints within a Hamming radius r of a query set: with b blocks, two such agree in b - r blocks at least, so in one of
the tables, one for each choice of b - r blocks (here 28), they share a key. Keys are joined, a join whose hot keys Spark splits; equal fingerprints are
one class, so copies aren't expanded. A radius of 6 bits finds copies with slight edits; texts at a similarity of 0.8 differ in some 19 bits.

Null and empty texts have no terms and the fingerprint 0. Repeated ids are ordered by their texts' hashes; null ids stand last; a single
document is its own next. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.base import partitions

SHINGLE, PART, RADIUS = 5, 4096, 6
LANES = (1 << 48) | (1 << 32) | (1 << 16) | 1  # the lowest bit of each 16
WIDE = (0xFFFF << 32) | 0xFFFF


def signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def words_of(text: Column) -> Column:
    """The words that terms are runs of."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def votes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, f1, f2: the fingerprint of each row's text; keys name the rows and keep their partitioning."""
    df = df.withColumn("sh_words", words_of(F.col(text)))
    last = F.greatest(F.size("sh_words") - SHINGLE, F.lit(0))
    at = F.when(F.size("sh_words") > 0, F.sequence(F.lit(0), last))
    several = [F.get("sh_words", F.col("sh_at") + k) for k in range(SHINGLE)]
    length = sum((F.coalesce(F.length(w), F.lit(0)) for w in several[1:]), F.coalesce(F.length(several[0]), F.lit(0)))
    rows = df.select(*keys, "sh_words", F.explode_outer(at).alias("sh_at"))
    rows = rows.select(*keys, F.shiftright("sh_at", 12).alias("sh_part"), F.xxhash64(*several).alias("sh_a"), F.least(F.lit(8), F.greatest(F.lit(1), F.shiftright(length, 2) - 2)).cast("long").alias("sh_w"), "sh_at")
    rows = rows.withColumn("sh_w", F.when(F.col("sh_at").isNull(), F.lit(0)).otherwise(F.col("sh_w"))).withColumn("sh_b", F.xxhash64("sh_a"))
    lanes = [(name, j) for name in ("a", "b") for j in range(16)]
    narrow = rows.groupBy(*keys, "sh_part").agg(
        F.sum("sh_w").alias("sh_w"),
        *[F.sum(F.shiftrightunsigned(f"sh_{name}", j).bitwiseAND(signed(LANES)) * F.col("sh_w")).alias(f"{name}{j}") for name, j in lanes],
    )
    wide = narrow.groupBy(*keys).agg(
        F.sum("sh_w").alias("sh_w"),
        *[F.sum(F.shiftrightunsigned(f"{name}{j}", 16 * odd).bitwiseAND(signed(WIDE))).alias(f"{name}{j}_{odd}") for name, j in lanes for odd in (0, 1)],
    )

    def bits(name: str) -> Column:
        out = signed(0)
        for j in range(16):
            for odd in (0, 1):
                low = F.col(f"{name}{j}_{odd}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
                high = F.shiftrightunsigned(f"{name}{j}_{odd}", 32)
                for lane, x in ((odd, low), (odd + 2, high)):
                    out = out.bitwiseOR(F.when(2 * x > F.col("sh_w"), signed(1 << (16 * lane + j))).otherwise(signed(0)))
        return out

    return wide.select(*keys, bits("a").alias("f1"), bits("b").alias("f2"))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * distance(a1, a2, b1, b2) / 128))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def text_of(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, f1, f2 of a table whose key is unique; texts aren't shuffled."""
    return votes(df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("sh_text")), [key], "sh_text")


def by_range(docs: DataFrame, id_: str, n: int) -> Column:
    """The number of a row's range of ids; n ranges at most, found from approximate quantiles."""
    bounds = docs.agg(F.percentile_approx(id_, [i / n for i in range(1, n)] or [0.5], F.lit(max(10_000, 10 * n)))).first()[0]
    bounds = sorted(set(bounds or []))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    long_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    below = lambda xs: F.coalesce(F.size(F.filter(xs, lambda b: b < F.col(id_))), F.lit(0))
    group = F.coalesce(F.size(F.filter(long_array([g[0] for g in groups]), lambda b: b < F.col(id_))), F.lit(0))
    within = F.element_at(F.array(*[long_array(g) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group > 0, (group - 1) * step + below(within)).otherwise(0)


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, (f1, f2) of the text, (e1, e2) of the edited text, (x1, x2) of the next text."""
    docs = docs.select(F.col(key).alias("sh_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("sh_text"))
    docs = docs.withColumn("sh_range", by_range(docs, "sh_id", 8 * partitions(docs.sparkSession)).cast("int")).withColumn("sh_hash", F.xxhash64("sh_text"))
    # the first document of each range, and the range before it: a row for each range
    order = F.struct(F.col("sh_id").isNotNull().alias("k"), "sh_id", "sh_hash")
    firsts = docs.groupBy("sh_range").agg(F.max(order).alias("first"))
    ranges = Window.orderBy("sh_range")
    firsts = firsts.select("sh_range", "first", F.coalesce(F.lead("sh_range").over(ranges), F.min("sh_range").over(Window.partitionBy())).alias("to"))
    dealt = docs.join(F.broadcast(firsts), "sh_range")
    once = F.array(F.struct(F.col("sh_range").alias("r"), F.lit(False).alias("sh_copy")))
    twice = F.concat(once, F.array(F.struct(F.col("to").alias("r"), F.lit(True).alias("sh_copy"))))
    dealt = dealt.select("sh_id", "sh_text", "sh_hash", F.inline(F.when(order == F.col("first"), twice).when(order.eqNullSafe(F.col("first")), twice).otherwise(once)))
    seq = Window.partitionBy("r").orderBy("sh_copy", F.col("sh_id").desc_nulls_last(), F.col("sh_hash").desc())
    dealt = dealt.select("r", F.row_number().over(seq).alias("n"), "sh_id", "sh_copy", "sh_text", F.lead("sh_text").over(seq).alias("next"))
    size = F.length("sh_text")
    half = F.floor(size / 2).cast("int")
    changed = F.concat(F.expr("substring(sh_text, 1, length(sh_text) - cast(floor(length(sh_text) / 2) as int))"), F.expr("substring(coalesce(next, ''), 1, cast(floor(length(sh_text) / 2) as int))"))
    dealt = dealt.select("r", "n", "sh_id", "sh_copy", "sh_text", size.cast("long").alias("size"), F.when(~F.col("sh_copy"), F.when(half > 0, changed).otherwise(F.col("sh_text"))).alias("changed"))
    sha = F.sha2("changed", 256)
    dealt = dealt.withColumns({f"s{i}": F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)})
    texts = F.array(F.struct(F.lit(0).alias("v"), F.col("sh_text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("changed").alias("t")))
    both = dealt.select("r", "n", "sh_id", "sh_copy", "size", "s0", "s1", "s2", "s3", F.inline(texts)).where("t is not null")
    row = ["r", "n", "sh_id", "sh_copy", "size", "s0", "s1", "s2", "s3"]
    found = votes(both, [*row, "v"], "t")
    own = lambda v, f: F.max(F.when(F.col("v") == v, F.col(f)))
    found = found.groupBy(*row).agg(own(0, "f1").alias("f1"), own(0, "f2").alias("f2"), own(1, "f1").alias("e1"), own(1, "f2").alias("e2"))
    seq = Window.partitionBy("r").orderBy("n")
    found = found.withColumn("x1", F.lead("f1").over(seq)).withColumn("x2", F.lead("f2").over(seq)).where("not sh_copy")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4)]))
    return found.select(F.col("sh_id").alias(key), F.col("size").alias("n_chars"), sha.alias("edited_sha256"), "f1", "f2", "e1", "e2", "x1", "x2")


def block_keys(radius: int) -> list[tuple[int, ...]]:
    """The choices of blocks; a block has 128 / blocks bits."""
    blocks = radius + 2
    return list(combinations(range(blocks), blocks - radius))


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """q, i, d, n: fingerprints of the index within the radius of those of the queries (key, f1, f2 in both).

    Rows of equal fingerprints are one class: it is named by its least key, and n is the number of rows in the index's class;
    `members` tells the class of each row. A pair comes from the first table in which it meets, so none comes twice.
    """
    blocks = radius + 2
    masks = [sum(1 << bit for bit in range(128 * b // blocks, 128 * (b + 1) // blocks)) for b in range(blocks)]
    halves = [(signed(m & ((1 << 64) - 1)), signed(m >> 64)) for m in masks]
    tables = block_keys(radius)

    def rows(df: DataFrame, name: str) -> DataFrame:
        one = df.groupBy("f1", "f2").agg(F.min(key).alias(name), F.count("*").alias("n"))
        of = F.array(*[
            F.struct(F.lit(t).alias("t"), F.col("f1").bitwiseAND(signed(m & ((1 << 64) - 1))).alias("k1"), F.col("f2").bitwiseAND(signed(m >> 64)).alias("k2"))
            for t, m in enumerate(sum(masks[b] for b in chosen) for chosen in tables)
        ])
        return one.select(name, F.col("f1").alias(f"{name}1"), F.col("f2").alias(f"{name}2"), *(["n"] if name == "i" else []), F.inline(of))

    found = rows(queries, "q").join(rows(index, "i"), ["t", "k1", "k2"])
    d = distance(F.col("q1"), F.col("q2"), F.col("i1"), F.col("i2"))
    x1, x2 = F.col("q1").bitwiseXOR(F.col("i1")), F.col("q2").bitwiseXOR(F.col("i2"))
    agree = F.array(*[(x1.bitwiseAND(a) == 0) & (x2.bitwiseAND(b) == 0) for a, b in halves])
    first = F.slice(F.filter(F.transform(agree, lambda same, b: F.when(same, b)), lambda b: b.isNotNull()), 1, blocks - radius)
    chosen = F.element_at(F.array(*[F.array(*[F.lit(b) for b in c]) for c in tables]), F.col("t") + 1)
    return found.where((d <= radius) & (first == chosen)).select("q", "i", d.alias("d"), "n")


def members(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, class: the least key of the rows that have the row's fingerprint."""
    least = df.groupBy("f1", "f2").agg(F.min(key).alias("class"))
    return df.join(least, ["f1", "f2"]).select(key, "class")


def neighbours(queries: DataFrame, index: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """key, n_near of the queries: how many rows of the index, besides the query's own, lie within the radius (key, f1, f2 in both)."""
    counts = near(queries, index, radius, key).groupBy("q").agg(F.sum("n").alias("n"))
    return members(queries, key).join(counts, F.col("class") == F.col("q")).select(key, (F.col("n") - 1).alias("n_near"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    like = lambda p: likeness(F.col("f1"), F.col("f2"), F.col(f"{p}1"), F.col(f"{p}2"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("f1"), F.col("f2")).alias("fingerprint"), text_of(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        like("e").alias("near_edited"), like("x").alias("near_next"),
    )
