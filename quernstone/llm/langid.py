"""Language ID: prediction by partial matching over bytes, under frozen statistics.

For each language, a tree of byte contexts up to `order` bytes long is counted on labelled texts. The code
length of a byte is that of the longest context in the tree: a byte seen there costs its share of the counts,
with as many counts kept for an escape as the context has kinds of bytes (method C); any other byte costs the
escape and then its cost in the context that is one byte shorter, at last 1/256 for each byte. Statistics stay
frozen while texts are scored, so the cost of a byte depends on its last `order` bytes alone. Kept are the grams that
languages have seen, with their code lengths, and the escapes of the contexts; a gram that isn't found costs the escape and is
looked up one byte shorter: exact code lengths. Languages are kept by fours, so the tables grow with their number, not its square.
A byte that no language has seen costs the same wherever it stands but for the escapes.

The trees are fitted on at most `fit_docs` texts of each language, those with the least hash of doc_id, and of
those on the first `fit_bytes` bytes (whole texts, until they reach that size): documented bounds. The order is the same for
any number of languages. Texts are gathered by fours of languages, a task for each, and only tables reach the driver. What is broadcast at a time is bounded by `table_bytes` (or one four of languages): larger models score the
texts in passes, one after the other.

Texts that are null or have no letter get `und` and score 0. Ties go to the language first in code-point order.
With nothing to learn from, all is `und`. Empty tables, repeated rows and null ids need no care; other columns stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import wordhash as wh
from quernstone.llm.base import cut, least_hashed, small

FIT_DOCS, FIT_BYTES, TABLE_BYTES = 600, 3_000_000, 96_000_000
#: Bytes of evidence beyond which more text doesn't make the score surer. Languages whose grams are kept together.
EVIDENCE, TOGETHER = 64, 4
#: Each byte is its own symbol; one more stands for what precedes a text.
SYMBOLS = np.arange(256)


@dataclass
class Part:
    """Grams of a few languages. Lists are by context length, from 1; rows of costs are by language."""

    n: int  # languages
    grams: list[np.ndarray]  # sorted numbers of contexts with their next symbol
    costs: list[np.ndarray]  # (gram, language) -> bits
    contexts: list[np.ndarray]  # sorted numbers
    escapes: list[np.ndarray]  # (context, language) -> bits

    def bytes(self) -> int:
        return sum(x.nbytes for xs in (self.grams, self.costs, self.contexts, self.escapes) for x in xs)


@dataclass
class Model:
    langs: list[str]
    order: int
    symbols: np.ndarray  # byte -> symbol; the symbol after the last one precedes texts
    costs: np.ndarray  # (0, symbol, language) -> bits without a context
    parts: list[Part]  # of the languages in their order
    table_bytes: int = TABLE_BYTES

    def passes(self) -> list[Model]:
        """Models of some of the languages, of table_bytes or one part at most."""
        groups: list[list[Part]] = []
        for part in self.parts:
            if not groups or sum(x.bytes() for x in groups[-1]) + part.bytes() > self.table_bytes:
                groups.append([])
            groups[-1].append(part)
        out, at = [], 0
        for group in groups:
            to = at + sum(x.n for x in group)
            out.append(Model(self.langs[at:to], self.order, self.symbols, self.costs[:, :, at:to], group, self.table_bytes))
            at = to
        return out


def grams(texts: list[bytes], symbols: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the runs of k + 1 symbols, and their counts."""
    found = []
    for t in texts:
        s = symbols[np.frombuffer(t, np.uint8)].astype(np.int64)
        total = np.zeros(max(0, len(s) - k), np.int64)
        for j in range(k + 1):
            total = total * size + s[j : j + len(total)]
        found.append(total)
    return np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)


def counts(texts: list[bytes], symbols: np.ndarray, size: int, order: int) -> list[dict[tuple[int, ...], np.ndarray]]:
    """By context length: context -> counts of the next symbol."""
    trees: list[dict[tuple[int, ...], np.ndarray]] = []
    for k in range(order + 1):
        values, n = grams(texts, symbols, size, k)
        tree: dict[tuple[int, ...], np.ndarray] = {}
        for value, count in zip(values.tolist(), n.tolist(), strict=True):
            context, symbol = divmod(value, size)
            key = []
            for _ in range(k):
                context, digit = divmod(context, size)
                key.append(digit)
            tree.setdefault(tuple(key[::-1]), np.zeros(size))[symbol] = count
        trees.append(tree)
    return trees


def part(texts: list[list[bytes]], symbols: np.ndarray, size: int, order: int) -> tuple[np.ndarray, Part]:
    """(symbol, language) -> bits without a context, and the longer grams. texts: by language."""
    out, shorter = Part(len(texts), [], [], [], []), np.full((size, len(texts)), 8.0)
    known = np.arange(size)  # numbers of the rows of `shorter`
    for k in range(order + 1):
        own = [grams(t, symbols, size, k) for t in texts]
        all_ = np.unique(np.concatenate([g for g, _ in own])) if k else known
        contexts = np.unique(all_ // size)
        costs = shorter[np.searchsorted(known, all_ % size**k)] if k else shorter
        escapes = np.zeros((len(contexts), len(texts)))
        for j, (g, n) in enumerate(own):
            at, place = np.searchsorted(contexts, g // size), np.searchsorted(all_, g)
            total, kinds = (np.bincount(at, w, len(contexts)) for w in (n, None))
            has = kinds > 0
            escapes[has, j] = -np.log2(kinds[has] / (total + kinds)[has])
            costs[:, j] += escapes[np.searchsorted(contexts, all_ // size), j]
            costs[place, j] = -np.log2(n / (total + kinds)[at])
        if k:
            out.grams.append(all_)
            out.costs.append(costs.astype(np.float32))
            out.contexts.append(contexts)
            out.escapes.append(escapes.astype(np.float32))
        else:
            base = costs.copy()
        shorter, known = costs, all_
    return base, out


def table(langs: list[str], texts: dict[str, list[bytes]], order: int, table_bytes: int) -> Model:
    made = [part([texts[x] for x in langs[i : i + TOGETHER]], SYMBOLS, len(SYMBOLS) + 1, order) for i in range(0, len(langs), TOGETHER)]
    return assembled(langs, made, order, table_bytes)


def assembled(langs: list[str], made: list[tuple[np.ndarray, Part]], order: int, table_bytes: int) -> Model:
    costs = np.concatenate([np.zeros((len(SYMBOLS) + 1, 0)), *[base for base, _ in made]], axis=1)[None].astype(np.float32)
    return Model(langs, order, SYMBOLS, costs, [p for _, p in made], table_bytes)


def fit(rows: DataFrame, order: int = 3, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES, table_bytes: int = TABLE_BYTES) -> Model:
    """rows: doc_id, text, lang. Each four of languages is fitted in a task of its own; names and tables reach the driver, texts don't."""
    rows = rows.where("text is not null and lang is not null and doc_id is not null")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return assembled([], [], order, table_bytes)
    picked = least_hashed(rows.select("lang", "doc_id"), fit_docs, ["lang"], "doc_id").groupBy("lang", "doc_id").agg(F.min("n").alias("n"))
    # fit_docs rows for each language: small enough to broadcast up to some hundreds of them
    picked = small(picked, fit_docs * len(langs))
    order_of = Window.partitionBy("lang").orderBy("n", "text")
    sizes = rows.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])
    before = F.sum(F.octet_length("text")).over(order_of.rowsBetween(Window.unboundedPreceding, -1))
    used = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < fit_bytes).select("lang", "n", "text")
    numbers = rows.sparkSession.createDataFrame([(x, i // TOGETHER) for i, x in enumerate(langs)], "lang string, four int")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = langs[key[0] * TOGETHER : (key[0] + 1) * TOGETHER]
        frame = frame.sort_values(["lang", "n", "text"])
        texts = [[t.encode() for t in frame.text[frame.lang == x]] for x in own]
        base, p = part(texts, SYMBOLS, len(SYMBOLS) + 1, order)
        return pd.DataFrame({"four": [key[0]], "part": [pickle.dumps((base, p.n, p.grams, p.costs, p.contexts, p.escapes))]})

    fitted = used.join(small(numbers, len(langs)), "lang").groupBy("four").applyInPandas(run, "four int, part binary")
    made = [pickle.loads(r.part) for r in sorted(fitted.toLocalIterator(), key=lambda r: r.four)]
    return assembled(langs, [(base, Part(*rest)) for base, *rest in made], order, table_bytes)


def places(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers are known, and the places of those."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    found = known[at] == asked
    return found, at[found]


def part_costs(p: Part, base: np.ndarray, history: np.ndarray, coded: np.ndarray, order: int) -> np.ndarray:
    """Bits by byte and language. What isn't found after a context pays its escape and is looked up after a shorter one."""
    size, cost = len(base), np.zeros((len(coded), p.n), np.float32)
    left = np.arange(len(coded))
    for k in range(order, 0, -1):
        context = history[left] % size**k
        found, at = places(p.grams[k - 1], context * size + coded[left])
        cost[left[found]] += p.costs[k - 1][at]
        left, context = left[~found], context[~found]
        found, at = places(p.contexts[k - 1], context)
        cost[left[found]] += p.escapes[k - 1][at]
    cost[left] += base[coded[left]]
    return cost


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits by text and language. The first bytes of a text have what precedes as a history of its own symbol."""
    size, n = model.costs.shape[1], len(offsets) - 1
    out = np.zeros((n, len(model.langs)))
    coded = model.symbols[data]
    start = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(data)) - start
    history = np.zeros(len(data), np.int64)
    for k in range(model.order, 0, -1):
        before = np.full(len(data), size - 1, np.int64)
        before[k:] = coded[:-k] if k < len(data) else before[k:]
        before[at < k] = size - 1
        history = history * size + before
    full, first = np.flatnonzero(np.diff(offsets) > 0), 0
    for p in model.parts:
        if len(full):
            cost = part_costs(p, model.costs[0, :, first : first + p.n], history, coded, model.order)
            out[full, first : first + p.n] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        first += p.n
    return out


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score, the share of the language in the likelihood over EVIDENCE bytes."""
    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    source = F.when(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.col(f"`{text}`").cast("string"))
    df = df.select(*[F.col(f"`{c}`") for c in keep], source.alias("lang_pred"))
    through = df.schema.fields[:-1]
    state = T.StructType([T.StructField("text", T.StringType()), T.StructField("name", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("total", T.DoubleType())])
    schema = T.StructType([*through, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def lengths(model: Model, column: pa.Array) -> np.ndarray:
        data, offsets = wh.text_buffers(column)
        total = np.zeros((len(column), len(model.langs)))
        at, size = 0, wh.SEGMENT
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            if to == at + 1 and offsets[to] - offsets[at] > size:  # one long text: parts that see the bytes before them
                back = model.order
                for low in range(int(offsets[at]), int(offsets[to]), size):
                    first = max(int(offsets[at]), low - back)
                    ends = np.array([0, min(low + size, int(offsets[to])) - first])
                    total[at] += code_lengths(model, data[first : first + ends[1]], ends)[0]
                    if first < low:
                        total[at] -= code_lengths(model, data[first:low], np.array([0, low - first]))[0]
            else:
                total[at:to] = code_lengths(model, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        return total / np.maximum(1, np.diff(offsets) / EVIDENCE)[:, None]

    def least(names: list[str], bits: np.ndarray, before: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first name of least bits, its bits, and the sum of all likelihoods in parts of its own; with those of passes before."""
        name, low = np.array(names, object)[bits.argmin(axis=1)], bits.min(axis=1)
        total = np.exp2(low[:, None] - bits).sum(axis=1)
        if before is None:
            return name, low, total
        old, was, sum_ = (before.field(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        both = np.minimum(low, was)
        return np.where(low < was, name, old), both, sum_ * np.exp2(both - was) + total * np.exp2(both - low)

    models = model.passes()
    for i, one in enumerate(models or [model]):
        shared, last = df.sparkSession.sparkContext.broadcast(one), i + 1 >= len(models)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, i=i, last=last) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                before = batch.column(batch.num_columns - 1) if i else None
                column = before.field(0) if i else batch.column(batch.num_columns - 1)
                name, low, total = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                if model.langs:
                    name, low, total = least(model.langs, lengths(model, column), before)
                if last:
                    known = ~column.is_null().to_numpy(zero_copy_only=False) & (total > 0)
                    names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
                    names[known], scores[known] = name[known], 1 / total[known]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])
                else:
                    states = pa.StructArray.from_arrays([column, pa.array(name, pa.string()), pa.array(low), pa.array(total)], ["text", "name", "bits", "total"])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], states], [*keep, "lang_pred"])

        if last:
            return df.mapInArrow(run, schema)
        df = cut(df.mapInArrow(run, T.StructType([*through, T.StructField("lang_pred", state)])))
        shared.unpersist()


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
