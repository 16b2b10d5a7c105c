"""LM scoring: word counts and a log-frequency Bloom filter of quantised bigram counts, broadcast while small.

A text's tokens are its words (A-Z lower-cased, between white space), then one end. Training counts all words and
all bigrams (the first word's has a start before it), merged by hash range: each task sends one row for a range, with
its own sums, so that a frequent word is one number a task. A bigram seen c times enters its range's segment of
the filter at levels 1 to 1 + floor(log2 c). To score, levels are probed until one is absent, each by several bits; the
last present level gives the count 2^(level - 1), at most the true one but for the filter's false positives
(about one in forty per probe). The probability is
    mix * count(h w) / count(h) + (1 - mix) * (count(w) + 0.5) / (N + 0.5 * (V + 1))
with exact word counts; for one history these sum to at most 1 but for false positives.

The model grows with the corpus. Up to `part_bytes` it is broadcast. Beyond, probes are dealt by shuffle to the hash ranges:
texts go in pieces of four megabytes, each piece asks every range once for its distinct hashes, and a task answers from
one range at a time. There is a range for each `shard_bytes` of training text at least, so a range doesn't grow. Scores are the same; work, traffic and memory stay in proportion to the corpus, for any size of model.

Null and empty texts have one token, the end. Rows with a null id are learned from. Repeated rows count each time and
score alike; with nothing to learn from, all counts are 0 and scores follow the same formula. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import wordhash as wh
from quernstone.llm.base import cut, partitions

MIX, BITS, PROBES, PART_BYTES, SHARD_BYTES = 0.4, 8, 4, 256_000_000, 256_000_000
END, START = np.uint64(1), np.uint64(2)  # in place of hashes of words
FLUSH, ASKED, PIECE = 2_000_000, 1024, 1 << 22  # hashes a task holds before it merges them, hashes in a row that asks, bytes of texts that ask together
WORDS, PAIRS, TEXTS = 2, 3, 4  # kinds of dealt rows, after the model's 0 and 1
MERGED = "kind int, shard int, hashes binary, counts binary, total long, size long"


def tokens(words: wh.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end for each text, the token before each, first token of each text and the end of the last)."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    now = np.empty(first[-1], np.uint64)
    is_end = np.zeros(len(now), bool)
    is_end[first[1:] - 1] = True
    now[is_end], now[~is_end] = END, words.hashes
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[first[:-1]] = START
    return now, before, first


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """48 bits of hash, above 16 that are 0: bigrams that share one are far rarer than the filter's false positives."""
    return wh.mix(before * np.uint64(0x9FB21C651E98DF25) + wh.mix(now)) & np.uint64(wh.MASK ^ 0xFFFF)


def packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes, after their width: of 48 bits as the first and steps in 4 bytes, or in 6 bytes if a step is too wide; else in 8."""
    if not len(hashes) or np.bitwise_or.reduce(hashes) & np.uint64(0xFFFF):
        return b"8" + hashes.tobytes()
    steps = np.diff(hashes) >> np.uint64(16)
    if steps.max(initial=np.uint64(0)) < 1 << 32:
        return b"4" + hashes[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"6" + (hashes >> np.uint64(32)).astype(np.uint32).tobytes() + (hashes >> np.uint64(16)).astype(np.uint16).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    kind, data = data[:1], data[1:]
    if kind == b"8":
        return np.frombuffer(data, np.uint64)
    if kind == b"4":
        return np.cumsum(np.append(np.frombuffer(data[:8], np.uint64), np.frombuffer(data[8:], np.uint32).astype(np.uint64) << np.uint64(16)), dtype=np.uint64)
    n = len(data) // 6
    return (np.frombuffer(data[: 4 * n], np.uint32).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(data[4 * n :], np.uint16).astype(np.uint64) << np.uint64(16))


def added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with summed counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    if not len(h):
        return h, c
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(c, first)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]  # 1 + floor(log2)


def places(hashes: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of a level, in a segment of `size` bits."""
    a = wh.mix(hashes + np.uint64(level * 0xA24BAED4963EE407 & wh.MASK))
    step = (a >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (a % np.uint64(size) if np.isscalar(size) else a % size).astype(np.int64)
        a = a + step * np.uint64(0x9E3779B97F4A7C15)


def segment(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    levels = levels_of(counts)
    bits = np.zeros(max(64, -(-int(levels.sum()) * BITS // 64) * 64), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in places(hashes[levels >= level], level, len(bits)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def count(texts: DataFrame, shards: int) -> DataFrame:
    """Rows of MERGED: kind 0 has word hashes and counts, kind 1 has a segment of the filter; total sums counts."""
    width = (1 << 64) // shards + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: ([], []), 1: ([], [])}

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            for kind, (hashes, counts) in held.items():
                if sum(map(len, hashes)) <= least:
                    continue
                h, c = added(hashes, counts)
                cuts = np.searchsorted(h // np.uint64(width), np.arange(shards + 1, dtype=np.uint64))
                used = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), kind, np.int32)), pa.array(np.array(used, np.int32)),
                    pa.array([packed(h[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
                    pa.array([shrunk(c[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
                ], ["kind", "shard", "hashes", "counts"])
                hashes.clear(), counts.clear()

        for batch in batches:
            for _, _, words in wh.pieces(batch.column(0), wh.SPACES):
                now, before, first = tokens(words)
                for kind, found in ((0, now), (1, pair_hash(before, now))):
                    h, c = np.unique(found, return_counts=True)
                    held[kind][0].append(h), held[kind][1].append(c)
                held[0][0].append(np.array([START])), held[0][1].append(np.array([len(first) - 1]))
                yield from flush(FLUSH)
        yield from flush(0)

    def merged(kind: int, shard: int, hashes: list, counts: list) -> pa.RecordBatch:
        h, c = added(hashes, counts)
        real = h != START if kind == 0 else np.ones(len(h), bool)
        out = [kind, shard, h.tobytes() if kind == 0 else segment(h, c).tobytes(), shrunk(c) if kind == 0 else b"", int(c[real].sum()), int(real.sum())]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, kinds, strict=True)], ["kind", "shard", "hashes", "counts", "total", "size"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range at a time, whatever ranges a task has; what has come of it is added up when it has doubled."""
        key, hashes, counts, n, least = None, [], [], 0, 0
        for batch in batches:
            for kind, shard, h, c in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3), strict=True):
                if (kind, shard) != key:
                    if key is not None:
                        yield merged(*key, hashes, counts)
                    key, hashes, counts, n, least = (kind, shard), [], [], 0, 0
                hashes.append(unpacked(h.as_py())), counts.append(grown(c.as_py()))
                n += len(hashes[-1])
                if n > 2 * max(least, FLUSH):
                    h, c = added(hashes, counts)
                    hashes, counts, n, least = [h], [c], len(h), len(h)
        if key is not None:
            yield merged(*key, hashes, counts)

    parts = texts.mapInArrow(partial, "kind int, shard int, hashes binary, counts binary")
    return parts.repartition(shards, "shard").sortWithinPartitions("kind", "shard").mapInArrow(merge, MERGED)


def shrunk(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them, which stands before them."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(counts) or counts.max() < 1 << 8 * int(k[1]))
    return kind[1].encode() + counts.astype(kind).tobytes()


def grown(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], f"u{data[:1].decode()}").astype(np.int64)


@dataclass
class Model:
    rows: DataFrame
    shards: int
    total: int
    distinct: int
    small: bool
    kept: list = field(default_factory=list)

    @property
    def width(self) -> int:
        return (1 << 64) // self.shards + 1


def fit(texts: DataFrame, text: str = "text", part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES) -> Model:
    n_bytes = texts.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = max(partitions(texts.sparkSession), -(-n_bytes // shard_bytes))
    rows = cut(count(texts.select(F.col(text).cast("string")), shards))
    of_words = F.col("kind") == 0
    size = F.length("hashes") + F.length("counts")
    got = rows.agg(F.sum(F.when(of_words, 2 * size).otherwise(size)), F.sum(F.when(of_words, F.col("total"))), F.sum(F.when(of_words, F.col("size")))).first()
    return Model(rows, shards, got[1] or 0, got[2] or 0, (got[0] or 0) <= part_bytes)


def whole(model: Model) -> tuple:
    """What is broadcast of a small model: word hashes, their counts, the filter's bytes, each segment's start and bits."""
    hashes, counts, filters = [], [], []
    starts, bits, at = np.zeros(model.shards, np.int64), np.zeros(model.shards, np.uint64), 0
    for r in sorted(model.rows.select("kind", "shard", "hashes", "counts").toArrow().to_pylist(), key=lambda r: (r["shard"], r["kind"])):
        if r["kind"] == 0:
            hashes.append(np.frombuffer(r["hashes"], np.uint64)), counts.append(grown(r["counts"]))
        else:
            filters.append(np.frombuffer(r["hashes"], np.uint8))
            starts[r["shard"]], bits[r["shard"]] = at, 8 * len(filters[-1])
            at += len(filters[-1])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    counts = join(counts, np.int64)
    return join(hashes, np.uint64), counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64), join(filters, np.uint8), starts, bits


def word_counts(hashes: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(hashes, distinct), max(0, len(hashes) - 1))
    found = np.where(hashes[at] == distinct, counts[at], 0) if len(hashes) else np.zeros(len(distinct))
    return found.astype(np.int64)[back]


def probed(filters: np.ndarray, base: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The last present level of each hash, 0 if none; base and size: the first byte and the bits of its segment."""
    out = np.zeros(len(hashes), np.int8)
    alive = np.flatnonzero(size)
    level = 0
    while len(alive):
        level += 1
        for probe in range(PROBES):
            h = hashes[alive]
            a = wh.mix(h + np.uint64(level * 0xA24BAED4963EE407 & wh.MASK))
            a = a + ((a >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 * probe & wh.MASK)
            at = (a % size[alive]).astype(np.int64)
            alive = alive[(filters[base[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out[alive] = level
    return out


def sums(first: np.ndarray, own: np.ndarray, levels: np.ndarray, total: int, distinct: int, mix: float) -> np.ndarray:
    """Rows for a run of texts: tokens, base score, score, known tokens. own: each token's count, last of all the start's."""
    starts_seen, own = own[-1], own[:-1]
    prior = np.empty_like(own)
    prior[1:] = own[:-1]
    prior[first[:-1]] = starts_seen
    base = (own + 0.5) / (total + 0.5 * (distinct + 1))
    pairs = np.where((own > 0) & (prior > 0) & (levels > 0), np.exp2(levels - 1.0), 0.0) / np.maximum(prior, 1)
    logs = np.stack([np.log10(base), np.log10(mix * np.minimum(pairs, 1.0) + (1 - mix) * base), own > 0])
    return np.vstack([np.diff(first), np.add.reduceat(logs, first[:-1], axis=1)])


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one key, across batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        yield from (batch.slice(a, b - a) for a, b in pairwise(cuts))
        rest = batch.slice(cuts[-1])
    if rest is not None:
        yield rest


def dealt(texts: DataFrame, model: Model, answered: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType, mix: float) -> DataFrame:
    """Scores without a broadcast: pieces of texts ask the model's ranges, and the answers meet the pieces again.

    Where a piece begins depends on the order of rows, thus the pieces are cut first: a task that runs again finds them as they were.
    """
    n, shards, width, total, distinct = len(texts.columns) - 1, model.shards, model.width, model.total, model.distinct
    own = [T.StructField(f.name, f.dataType) for f in texts.schema.fields]
    row = "lm_piece long, lm_kind int, lm_shard int, lm_at int, lm_data binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = np.empty(batch.num_rows, np.int64)
            for at, to in wh.spans(wh.text_buffers(batch.column(n))[1], PIECE):
                ids[at:to] = piece = piece + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "lm_piece"])

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lm_piece", "lm_kind", "lm_shard", "lm_at", "lm_data"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 1):
            piece, rows = run.column(1)[0].as_py(), []
            ((_, _, words),) = wh.pieces(run.column(0), wh.SPACES, size=PIECE)
            now, before, _ = tokens(words)
            for kind, found in ((WORDS, np.append(now, START)), (PAIRS, pair_hash(before, now))):
                hashes = np.unique(found)
                cuts = np.searchsorted(hashes // np.uint64(width), np.arange(shards + 1, dtype=np.uint64))
                for shard in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    for at in range(int(cuts[shard]), int(cuts[shard + 1]), ASKED):
                        rows.append((piece, kind, shard, at, packed(hashes[at : min(at + ASKED, cuts[shard + 1])])))
            yield rows_out(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for piece, kind, shard, at, data, more in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), batch.column(5), strict=True):
                if shard != held:
                    held, hashes, counts, filters = shard, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
                if kind == 0:
                    hashes, counts = np.frombuffer(data.as_buffer(), np.uint64), grown(more.as_py())
                elif kind == 1:
                    filters = np.frombuffer(data.as_buffer(), np.uint8)
                else:
                    asked = unpacked(data.as_py())
                    size = np.full(len(asked), 8 * len(filters), np.uint64)
                    got = shrunk(word_counts(hashes, counts, asked)) if kind == WORDS else probed(filters, np.zeros(len(asked), np.int64), size, asked).tobytes()
                    rows.append((piece, kind, shard, at, got))
            yield rows_out(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, n + 1):
            kinds, data = run.column(n + 2).to_numpy(), run.column(n + 5)
            a, b = np.searchsorted(kinds, [PAIRS, TEXTS]).tolist()
            counts = np.concatenate([grown(data[i].as_py()) for i in range(a)])
            levels = np.concatenate([np.frombuffer(data[i].as_buffer(), np.int8) for i in range(a, b)])
            asked = run.slice(b)
            ((_, _, words),) = wh.pieces(asked.column(n), wh.SPACES, size=PIECE)
            now, before, first = tokens(words)
            back = np.unique(np.append(now, START), return_inverse=True)[1]
            paired = np.unique(pair_hash(before, now), return_inverse=True)[1]
            yield answered(asked, sums(first, counts[back], levels[paired], total, distinct, mix))

    placed = cut(texts.mapInArrow(place, T.StructType([*own, T.StructField("lm_piece", T.LongType())])))
    questions = placed.select("lm_text", "lm_piece").mapInArrow(ask, row).withColumn("lm_more", F.lit(None).cast("binary"))
    known = model.rows.select(F.lit(-1).cast("long").alias("lm_piece"), F.col("kind").alias("lm_kind"), F.col("shard").alias("lm_shard"), F.lit(0).alias("lm_at"), F.col("hashes").alias("lm_data"), F.col("counts").alias("lm_more"))
    answers = known.union(questions).repartition(shards, "lm_shard").sortWithinPartitions("lm_shard", "lm_kind").mapInArrow(answer, row)
    waiting = placed.select("*", F.lit(TEXTS).alias("lm_kind"), F.lit(0).alias("lm_shard"), F.lit(0).alias("lm_at"), F.lit(None).cast("binary").alias("lm_data"))
    met = waiting.unionByName(answers, allowMissingColumns=True).repartition("lm_piece").sortWithinPartitions("lm_piece", "lm_kind", "lm_shard", "lm_at")
    return met.mapInArrow(finish, schema)


def score(df: DataFrame, model: Model, text: str = "text", mix: float = MIX) -> DataFrame:
    """df with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in df.columns if c.lower() not in (*new, "lm_text", "lm_piece", "lm_kind", "lm_shard", "lm_at", "lm_data")]
    texts = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("lm_text"))
    n, width, total, distinct = len(keep), model.width, model.total, model.distinct
    fields = [T.StructField(c, T.LongType()) for c in new[:3]] + [T.StructField(c, T.DoubleType()) for c in new[3:]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in texts.schema.fields[:n]] + fields)

    def answered(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        long = lambda v: pa.array(v.astype(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:n], long(x[0]), long(x[3]), long(np.full(x.shape[1], total)), pa.array(x[1]), pa.array(x[2])], [*keep, *new])

    if not model.small:
        return dealt(texts, model, answered, schema, mix)
    shared = df.sparkSession.sparkContext.broadcast(whole(model))
    model.kept.append(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, filters, starts, bits = shared.value
        for batch in batches:
            found = [np.zeros((4, 0))]
            for _, _, words in wh.pieces(batch.column(n), wh.SPACES):
                now, before, first = tokens(words)
                asked = pair_hash(before, now)
                shard = (asked // np.uint64(width)).astype(np.int64)
                found.append(sums(first, word_counts(hashes, counts, np.append(now, START)), probed(filters, starts[shard], bits[shard], asked), total, distinct, mix))
            yield answered(batch, np.concatenate(found, axis=1))

    return texts.mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out().alias("held_out"), "text")
    return score(docs, fit(docs.where(~F.col("held_out"))))
