"""Benchmark decontamination: a prefix-filtered set join of item windows with texts.

An item's windows are its runs of `window` consecutive words; an item of fewer, but not none, is one window. A window
must occur whole, so all its shingles (three words, fewer in shorter windows) must; the rarest one is then a
sufficient prefix. Rarity is counted over all texts first. Each place of a prefix shingle in a text proposes the
windows that have it, which pass if they lie inside the text by position and length; then their words are compared
one by one (as 64-bit hashes) with the text's. Words inside any occurrence are hit.

A benchmark that has at most `part_words` words by its bytes is indexed on the driver and broadcast; texts aren't shuffled.
A larger one never reaches the driver: windows and places meet by their prefix shingle in a shuffle. A text sends only the
places whose shingle is in a bitmap of all prefixes (16 MB, whatever the benchmark), each with the words around it, so that what is joined can
be compared at once; hits come back to the texts by two hashes of the text. Texts are read as often as before: once for
rarity, once for places, once for the result.

Null texts have no words and null items no windows; items with a null id are left out; equal items each count. A text without
words isn't contaminated. Repeated rows get equal results, empty tables give empty results, and other columns stay
(columns named like added ones are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import wordhash as wh
from quernstone.llm.base import cut, small

WINDOW, PART_WORDS = 13, 1_000_000
BITMAP_BITS, SLICE_BITS = 1 << 27, 1 << 20
ADDED = ("n_words", "hit_spans", "hit_items")


def usable(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, body of items that have both."""
    return items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("body"))


def item_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes)."""
    for at, _, words in wh.pieces(column, wh.SYMBOLS):
        for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            yield at + d, words.hashes[a:b]


def windows(part: list[tuple[str, np.ndarray]], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (words of each distinct window and item, number of the item)."""
    found: dict[int, tuple[list, list]] = {}
    for i, (_, words) in enumerate(part):
        n = min(window, len(words))
        if n:
            rows, owners = found.setdefault(n, ([], []))
            rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(words, n), axis=0))
            owners.append(np.full(len(rows[-1]), i))
    return {n: (np.concatenate(rows), np.concatenate(owners)) for n, (rows, owners) in found.items()}


def row_grams(rows: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of each row of words."""
    return np.stack([wh.gram_hashes(row, k) for row in rows]) if len(rows) else np.zeros((0, 1), np.uint64)


def near_table(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return out


def lookup(keys: np.ndarray, near: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in hashes, places in the ascending keys) of equal ones."""
    maybe = np.flatnonzero(near[hashes & np.uint64(0xFFFFF)])
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), max(0, len(keys) - 1))
    same = keys[at] == hashes[maybe] if len(keys) else np.zeros(0, bool)
    return maybe[same], at[same]


def occurrences(docs: DataFrame, text: str, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle (by length) occurs over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast({k: (v, near_table(v)) for k, v in shingles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, (v, _) in shared.value.items()}
        for batch in batches:
            for _, _, words in wh.pieces(batch.column(0), wh.SYMBOLS):
                for k, (keys, near) in shared.value.items():
                    _, at = lookup(keys, near, wh.gram_hashes(words.hashes, k))
                    total[k] += np.bincount(at, minlength=len(keys))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    # a row for each shingle of the part: as bounded as the part
    got = docs.select(F.col(text).cast("string")).mapInArrow(wh.trimmed(run), "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
    ks, at, n = (got.column(c).to_numpy() for c in ("k", "at", "n"))
    for k, total in out.items():
        total[at[ks == k]] = n[ks == k]
    return out


def index(docs: DataFrame, text: str, part: list[tuple[str, np.ndarray]], window: int) -> dict:
    """By window length: (shingle length, prefix shingles, windows by prefix, place of the prefix in each, words, items)."""
    by_length = windows(part, window)
    grams = {n: row_grams(rows, min(3, n)) for n, (rows, _) in by_length.items()}
    shingles = {k: np.unique(np.concatenate([g.ravel() for n, g in grams.items() if min(3, n) == k])) for k in {min(3, n) for n in grams}}
    counted = occurrences(docs, text, shingles)
    out = {}
    for n, (rows, owners) in by_length.items():
        k = min(3, n)
        places = np.searchsorted(shingles[k], grams[n])
        off = np.argmin(counted[k][places], axis=1)
        prefix = grams[n][np.arange(len(rows)), off]
        order = np.argsort(prefix, kind="stable")
        keys, first = np.unique(prefix[order], return_index=True)
        out[n] = (k, keys, near_table(keys), np.append(first, len(rows)), off[order], rows[order], owners[order])
    return {"lengths": out, "names": [name for name, _ in part]}


def occurring(words: wh.Words, of: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, item) of each window's occurrences, by words of the piece."""
    starts, ends, items = [], [], []
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts)
    for n, (k, keys, near, first, off, rows, owners) in of["lengths"].items():
        place, key = lookup(keys, near, wh.gram_hashes(words.hashes, k))
        for low in range(0, len(place), 50_000):  # bounded, however common a prefix is
            p, q = place[low : low + 50_000], key[low : low + 50_000]
            many = first[q + 1] - first[q]
            window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[q], many)
            start = np.repeat(p, many) - off[window]
            inside = (start >= 0) & (start + n <= len(words.hashes))
            start, window = start[inside], window[inside]
            inside = doc[start] == doc[start + n - 1]
            start, window = start[inside], window[inside]
            for j in range(n):
                same = words.hashes[start + j] == rows[window, j]
                start, window = start[same], window[same]
            starts.append(start), ends.append(start + n), items.append(owners[window])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(starts), join(ends), join(items)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Disjoint spans, ascending."""
    out: list[dict] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW = {"n_words": pa.int64(), "hit_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "hit_items": pa.list_(pa.string())}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def find(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (disjoint ranges of word numbers) and hit_items (ids, ascending as strings)."""
    kept = [c for c in docs.columns if c.lower() not in (*ADDED, "hit_text")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("hit_text"))
    rows = usable(items, item, item_text)
    # a word takes two bytes at least, with what stands before the next
    if (rows.agg(F.sum(F.octet_length("body") + 1)).first()[0] or 0) // 2 > part_words:
        return dealt(source, rows, window).drop("hit_text")
    held = rows.toArrow()
    part = [(held.column(0)[r].as_py(), words) for r, words in item_words(held.column(1).combine_chunks())]
    shared = docs.sparkSession.sparkContext.broadcast(index(source, "hit_text", part, window))
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    return source.mapInArrow(wh.trimmed(step(shared, len(kept))), schema).drop("hit_text")


def step(shared, n_kept: int):
    """Adds what the benchmark's windows hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            names: list[list] = [[] for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, np.int64)
            for at, to, words in wh.pieces(batch.column(n_kept), wh.SYMBOLS):
                n_words[at:to] = words.counts
                starts, ends, items = occurring(words, shared.value)
                doc = np.searchsorted(words.first, starts, "right") - 1
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.diff(doc[order])) + 1
                for group in np.split(order, cuts) if len(order) else ():
                    d = doc[group[0]]
                    base = words.first[d]
                    spans[at + d] = merged(starts[group] - base, ends[group] - base)
                    names[at + d] = sorted({shared.value["names"][i] for i in np.unique(items[group])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(spans, ARROW["hit_spans"]), pa.array(names, ARROW["hit_items"])], [*batch.schema.names, *ADDED])

    return run


def window_table(items: DataFrame, window: int) -> DataFrame:
    """n, words (hashes as bytes), item: each window of each item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, words in item_words(batch.column(1)):
                n = min(window, len(words))
                for low in range(0, len(words) - n + 1 if n else 0, 20_000):
                    rows = np.lib.stride_tricks.sliding_window_view(words[low : low + 20_000 + n - 1], n)
                    found = [x.tobytes() for x in np.ascontiguousarray(rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), pa.array(found, pa.binary()), pa.array([batch.column(0)[r].as_py()] * len(found))], ["n", "words", "item"])

    return items.mapInArrow(run, "n int, words binary, item string").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """words, k, off, shingle: the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ks, offs, shingles = [], [], [], []
            for w in batch.column(0):
                hashes = np.frombuffer(w.as_buffer(), np.uint64)
                k = min(3, len(hashes))
                grams = wh.gram_hashes(hashes, k)
                words += [w.as_py()] * len(grams)
                ks.append(np.full(len(grams), k, np.int32)), offs.append(np.arange(len(grams), dtype=np.int32)), shingles.append(grams.view(np.int64))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), join(ks, np.int32), join(offs, np.int32), join(shingles, np.int64)], ["words", "k", "off", "shingle"])

    return windows.select("words").distinct().mapInArrow(run, "words binary, k int, off int, shingle long")


def bitmap(shingles: DataFrame):
    """A broadcast of BITMAP_BITS bits, packed, with those of the shingles set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITMAP_BITS)).astype(np.int64)
            for i in np.unique(at // SLICE_BITS).tolist():
                held.setdefault(i, np.zeros(SLICE_BITS, bool))[at[at // SLICE_BITS == i] % SLICE_BITS] = True
        for i, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    place = F.pmod(F.col("shingle"), F.lit(BITMAP_BITS))  # the same remainder, since the number of bits is a power of 2
    rows = shingles.select("shingle").repartition(F.floor(place / SLICE_BITS)).mapInArrow(run, "slice int, bits binary")
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.slice * SLICE_BITS // 8 : (r.slice + 1) * SLICE_BITS // 8] |= np.frombuffer(r.bits, np.uint8)
    return shingles.sparkSession.sparkContext.broadcast(out)


def marked(bits: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Places of shingles that have their bit set."""
    at = (shingles % np.uint64(BITMAP_BITS)).astype(np.int64)
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def dealt(source: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """source (its last column is hit_text) with ADDED, by shuffles alone."""
    windows = cut(window_table(items, window))
    grams = cut(window_shingles(windows))
    all_, ks = bitmap(grams), sorted(r.k for r in grams.select("k").distinct().collect())  # of 1, 2, 3

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in wh.pieces(batch.column(0), wh.SYMBOLS):
                for k in ks:
                    found = wh.gram_hashes(words.hashes, k)
                    names, n = np.unique(found[marked(all_.value, found)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k, np.int32)), pa.array(names.view(np.int64)), pa.array(n)], ["k", "shingle", "times"])

    counted = source.select("hit_text").mapInArrow(occurring, "k int, shingle long, times long").groupBy("k", "shingle").agg(F.sum("times").alias("times"))
    rarest = grams.join(counted, ["k", "shingle"], "left").groupBy("words").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "off", "k", "shingle")).alias("p"))
    prefixes = cut(windows.join(rarest.select("words", "p.off", "p.k", "p.shingle"), "words"))
    of_prefixes = bitmap(prefixes.select("shingle").distinct())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, words in wh.pieces(batch.column(2), wh.SYMBOLS):
                doc = np.repeat(np.arange(len(words.first) - 1), words.counts)
                raw = words.hashes.tobytes()
                for k in ks:
                    found = wh.gram_hashes(words.hashes, k)
                    where = marked(of_prefixes.value, found)
                    where = where[doc[where] == doc[where + k - 1]]
                    for low in range(0, len(where), 50_000):
                        w = where[low : low + 50_000]
                        first, last = words.first[doc[w]], words.first[doc[w] + 1]
                        a, b = np.maximum(first, w - window), np.minimum(last, w + window)
                        around = [raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                        rows = pa.array(at + doc[w])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(w), k, np.int32)), pa.array(found[w].view(np.int64)), pa.array(w - first), pa.array(w - a), pa.array(around, pa.binary())], ["hit_a", "hit_b", "k", "shingle", "place", "before", "around"])

    hashed = source.withColumn("hit_a", F.xxhash64("hit_text")).withColumn("hit_b", F.xxhash64(F.lit(1), "hit_text"))
    found = hashed.where("hit_text is not null").select("hit_a", "hit_b", "hit_text").mapInArrow(places, "hit_a long, hit_b long, k int, shingle long, place long, before long, around binary")
    start = F.col("before") - F.col("off")
    same = F.when(start >= 0, F.substring("around", (8 * start + 1).cast("int"), (8 * F.col("n")).cast("int")) == F.col("words"))
    met = found.join(prefixes, ["k", "shingle"]).where(same)
    low = F.col("place") - F.col("off")
    met = met.select("hit_a", "hit_b", low.alias("start"), (low + F.col("n")).alias("end"), "item").distinct()
    by_text = met.groupBy("hit_a", "hit_b").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item")).alias("hit_items"))

    @F.pandas_udf(SPANS)
    def disjoint(rows: pd.Series) -> pd.Series:
        return rows.map(lambda spans: merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans])))

    by_text = cut(by_text.select("hit_a", "hit_b", disjoint("spans").alias("hit_spans"), "hit_items"))
    out = hashed.join(small(by_text, by_text.count()), ["hit_a", "hit_b"], "left")
    n_words = F.coalesce(F.regexp_count("hit_text", F.lit(WORD)), F.lit(0)).cast("long")
    return out.select(*source.columns, n_words.alias("n_words"), F.coalesce("hit_spans", F.array().cast(SPANS)).alias("hit_spans"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def hits() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_hit", hits())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM sized, unnest(range(1, len(w) - n + 2)) t(i)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT r, n, i, item FROM dw JOIN bw USING (n, words)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
