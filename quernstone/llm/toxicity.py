"""Toxicity: a sparse logistic classifier, regularised by counterfactuals.

Training takes labelled texts. Where a text names an identity group, a copy is made in which each identity term
is swapped for another term of its kind; the squared change of the score between text and copy is added to the
loss, with weight `swap_penalty`. So weights of identity terms shrink towards each other, and a neutral mention of a group
scores like any other text. A term that no training text has weighs 0, as it does when texts are scored: swapping it in changes the score
by all that the other one weighs. `kinds` are the terms: by default some in English, German, French and Spanish, of four kinds of groups. A text is the set of its words (A-Z lower-cased; letters, digits and
all beyond ASCII make up words); words of fewer than `min_docs` training texts are left out, and an L1 penalty leaves few weights.

At most `max_fit_rows` labels are used, those with the least hash of doc_id: a documented bound, which also bounds
what is broadcast and what the one task that fits gets (the word hashes of those texts). The model, a few hundred
numbers, goes through the driver and is broadcast.

Null and empty texts get the score of the bias alone. Rows with a null label, a null doc_id or without text aren't
learned from. Repeated rows get equal scores; repeated labels of a doc_id count once, as the largest. Where all labels
agree or there is none, all scores are equal and under 0.5. Other columns stay (one named like the score is replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import wordhash as wh
from quernstone.llm.base import least_hashed

#: Kinds of identity terms, each swapped within its kind; by language English, German, French, Spanish.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["she", "he"],
    ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["transgender", "cisgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["deaf", "blind", "disabled"],
    ["old", "young", "elderly"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["frau", "mann"],
    ["sie", "er"],
    ["schwul", "lesbisch", "bisexuell", "queer", "hetero"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"],
    ["muslime", "christen", "juden", "hindus", "buddhisten"],
    ["schwarz", "weiß", "asiatisch"],
    ["taub", "blind", "behindert"],
    ["alt", "jung"],
    ["femmes", "hommes", "filles", "garçons"],
    ["femme", "homme", "fille", "garçon"],
    ["elle", "il"],
    ["gai", "lesbienne", "bisexuel", "hétéro"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"],
    ["noir", "blanc", "asiatique"],
    ["sourd", "aveugle", "handicapé"],
    ["vieux", "jeune"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["mujer", "hombre", "chica", "chico"],
    ["ella", "él"],
    ["homosexual", "lesbiana", "bisexual", "heterosexual"],
    ["musulmán", "cristiano", "judío", "hindú", "budista"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas"],
    ["negro", "blanco", "asiático"],
    ["sordo", "ciego", "discapacitado"],
    ["viejo", "joven"],
]
#: What stands between words: all of ASCII but letters and digits.
BETWEEN = wh.SYMBOLS
MAX_FIT_ROWS = 20_000


@dataclass
class Model:
    bias: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def word_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes, row of each, first row, row after the last): words between spaces or symbols."""
    for at, to, words in wh.pieces(column, BETWEEN):
        yield words.hashes, np.repeat(np.arange(at, to), words.counts), at, to


def features(rows: DataFrame) -> DataFrame:
    """toxic, words (distinct hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, row, at, to in word_sets(batch.column(1)):
                ends = np.searchsorted(row, np.arange(at, to + 1))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sets, pa.binary())], ["toxic", "words"])

    return rows.select(F.col("toxic").cast("int"), "text").mapInArrow(wh.trimmed(run), "toxic int, words binary")


class Problem:
    """Log loss of bags of words, with the squared score changes of swapped copies."""

    def __init__(self, first: np.ndarray, cols: np.ndarray, labels: np.ndarray, d: int, pairs: np.ndarray, penalty: float):
        """first, cols: as `packed` gives; pairs: (word that stands, word that replaces it), a row for each swap; word d is one that weighs 0."""
        self.first, self.cols, self.labels, self.n, self.d = first, cols, labels, len(labels), d
        self.pairs, self.penalty = pairs, penalty / len(labels)
        # a bound on how the slope of each weight turns: words of many texts and of many swaps take shorter steps
        self.often, swapped = np.zeros(d, int), np.bincount(pairs.ravel(), minlength=d + 1)[:d]
        for _, _, _, cols in self.parts():
            self.often += np.bincount(cols, minlength=d)
        self.turn_b = 0.25 * max(1.0, len(self.cols) / self.n)
        self.turn = self.turn_b * (self.often / self.n) + 4 * self.penalty * swapped + 1e-9

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, text of each word, words): what is worked on at once, so that no array has a number for all words."""
        for at, to in wh.spans(self.first, wh.SEGMENT):
            yield at, to, np.repeat(np.arange(to - at), np.diff(self.first[at : to + 1])), self.cols[self.first[at] : self.first[to]]

    def changes(self, w: np.ndarray) -> np.ndarray:
        w = np.append(w, 0.0)
        return w[self.pairs[:, 0]] - w[self.pairs[:, 1]]

    def sums(self, w: np.ndarray, b: float) -> np.ndarray:
        z = np.empty(self.n)
        for at, to, text, cols in self.parts():
            z[at:to] = np.bincount(text, w[cols], to - at)
        return z + b

    def loss(self, w: np.ndarray, b: float) -> float:
        z = self.sums(w, b)
        change = self.changes(w)
        return float(np.mean(np.logaddexp(0, z) - self.labels * z) + self.penalty * (change @ change))

    def slope(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        rest = (1 / (1 + np.exp(-self.sums(w, b))) - self.labels) / self.n
        change = 2 * self.penalty * self.changes(w)
        g = np.zeros(self.d)
        for at, to, text, cols in self.parts():
            np.add.at(g, cols, rest[at:to][text])
        swapped = np.bincount(self.pairs[:, 0], change, self.d + 1) - np.bincount(self.pairs[:, 1], change, self.d + 1)
        return g + swapped[: self.d], float(rest.sum())

    def solve(self, w: np.ndarray, b: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient with backtracking; each weight's steps are scaled by its bound."""
        v, vb, t, step = w, b, 1.0, 16.0
        for _ in range(steps):
            g, gb = self.slope(v, vb)
            f, g = self.loss(v, vb) + l2 / 2 * (v @ v), g + l2 * v
            while True:
                own, own_b = step / (self.turn + l2), step / self.turn_b
                new, new_b = v - own * g, vb - own_b * gb
                new = np.sign(new) * np.maximum(np.abs(new) - own * l1, 0)
                dw, db = new - v, new_b - vb
                if self.loss(new, new_b) + l2 / 2 * (new @ new) <= f + g @ dw + gb * db + (dw @ (dw / own) + db * db / own_b) / 2 + 1e-12:
                    break
                step *= 0.5
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            v, vb = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
            w, b = new, new_b
        return w, b


def swap_table(kinds: list[list[str]]) -> dict[int, list[int]]:
    """Term to the terms that may replace it, as hashes; a term of two kinds has both."""
    out: dict[int, list[int]] = {}
    for kind in kinds:
        hashed = [wh.hash_word(t.encode()) for t in kind]
        for a in hashed:
            out[a] = sorted({*out.get(a, []), *hashed} - {a})
    return out


def compare(a, b) -> int:
    return (a > b) - (a < b)


def frequent(sets: list[np.ndarray], min_docs: int, terms: np.ndarray) -> np.ndarray:
    """Words of min_docs sets at least, and those of terms that occur, ascending; each set ascends, so ranges of hashes are counted one at a time."""
    least, parts = max(1, min_docs), 1 + sum(map(len, sets)) // wh.SEGMENT
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    ends = np.array([np.searchsorted(s, cuts) for s in sets], int).reshape(len(sets), parts - 1)
    ends = np.column_stack([np.zeros(len(sets), int), ends, [len(s) for s in sets]])
    found = []
    for k in range(parts):
        words = np.concatenate([s[e[k] : e[k + 1]] for s, e in zip(sets, ends, strict=True)])
        words.sort()
        begins = np.append(True, words[1:] != words[:-1])[: len(words)]
        enough = np.zeros(len(words), bool)
        enough[: max(0, len(words) - least + 1)] = words[: max(0, len(words) - least + 1)] == words[least - 1 :]
        found.append(words[begins & (enough | np.isin(words, terms))])
    return np.concatenate(found)


def packed(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's words begin, places of the words that are known); parts: places, whether known, number in each text; size: of all places."""
    first, cols, at = [np.zeros(1, int)], np.empty(size, np.int32), 0
    for places, known, counts in parts:
        ends = at + np.append(0, np.cumsum(known))[np.cumsum(counts)]
        cols[at : ends[-1]] = places[known]
        first.append(ends)
        at = int(ends[-1])
    return np.concatenate(first), cols[:at]


def places(sets: list[np.ndarray], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    counts = np.array([len(s) for s in sets])
    for at, to in wh.spans(np.append(0, np.cumsum(counts)), wh.SEGMENT):
        joined = np.concatenate(sets[at:to])
        place = np.minimum(np.searchsorted(words, joined), max(0, len(words) - 1))
        yield place, words[place] == joined if len(words) else np.zeros(len(joined), bool), counts[at:to]


def swap_pairs(runs: Iterable[np.ndarray], used: np.ndarray, swaps: dict[int, list[int]]) -> np.ndarray:
    """(word that stands, word that replaces it) for each occurrence of a term and each of its swaps; a term that isn't in `used` is len(used)."""
    index = {int(used[c]): int(c) for c in np.flatnonzero(np.isin(used, np.array(sorted(swaps), np.uint64)))}
    others = {c: [index.get(o, len(used)) for o in swaps[word]] for word, c in index.items()}
    is_term = np.zeros(len(used), bool)
    is_term[list(others)] = True
    found = [np.array([(c, o) for c in cols[is_term[cols]].tolist() for o in others[c]], int).reshape(-1, 2) for cols in runs]
    return np.concatenate([np.zeros((0, 2), int), *found])


def solve(sets: list[np.ndarray], labels: np.ndarray, swaps: dict[int, list[int]], min_docs: int, l1: float, l2: float, swap_penalty: float, steps: int) -> Model:
    """An L1 fit picks the words; a second fit of those alone, with a slight L2, sets their weights unshrunk. sets: ascending hashes.

    Besides the sets, four bytes for each of their words are held on to; all else is made for a part of the texts at a time.
    """
    if len(sets) == 0 or labels.min() == labels.max():
        return Model(-2.0)
    words = frequent(sets, min_docs, np.array(sorted(swaps), np.uint64))
    first, cols = packed(places(sets, words), sum(map(len, sets)))
    kept = np.ones(len(words), bool)
    w, b = np.zeros(0), float(np.log(labels.mean() / (1 - labels.mean())))
    for fit in (0, 1):
        used = words[kept]
        if fit:
            number = np.cumsum(kept) - 1
            first, cols = packed(((number[c], kept[c], np.bincount(text, minlength=to - at)) for at, to, text, c in problem.parts()), int(problem.often[kept].sum()))
        # a swap for a term that has no weight changes the score by all that the old one weighs
        runs = (cols[first[at] : first[to]] for at, to in wh.spans(first, wh.SEGMENT))
        problem = Problem(first, cols, labels, len(used), swap_pairs(runs, used, swaps), swap_penalty)
        w, b = problem.solve(np.zeros(len(used)) if fit == 0 else w, b, 0.0 if fit else l1, l2 if fit else 0.0, steps)
        if fit == 0:
            # a swap counts in the second fit too if either of its terms was picked
            picked, kept = np.append(w != 0, False), np.append(w != 0, False)
            kept[problem.pairs[picked[problem.pairs].any(axis=1)]] = True
            kept = kept[:-1]
            w = w[kept]
    return Model(b, words[kept], w)


def fit(rows: DataFrame, min_docs: int = 5, l1: float = 1e-3, l2: float = 1e-5, swap_penalty: float = 1.0, steps: int = 60, kinds: list[list[str]] = IDENTITY_TERMS) -> Model:
    """rows: text, toxic; as many as `labelled` gives. One task solves them, so that no text's words reach the driver."""
    swaps = swap_table(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, toxic = [], []
        for batch in batches:
            sets += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            toxic += (batch.column(0).to_numpy(zero_copy_only=False) > 0).tolist()
        # the sums don't depend on the order of rows; bytes to compare are made for two sets at a time
        order = sorted(range(len(sets)), key=cmp_to_key(lambda i, j: compare(sets[i].tobytes(), sets[j].tobytes()) or compare(toxic[i], toxic[j])))
        labels = np.array(toxic, float)[order] if order else np.zeros(0)
        model = solve([sets[i] for i in order], labels, swaps, min_docs, l1, l2, swap_penalty, steps)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias], pa.float64()), pa.array([model.words.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "words", "weights"])

    used = features(rows.where("text is not null and toxic is not null"))
    got = used.repartition(1).mapInArrow(wh.trimmed(run), "bias double, words binary, weights binary").first()
    return Model(got.bias, np.frombuffer(got.words, np.uint64), np.frombuffer(got.weights, np.float64)) if got else Model(-2.0)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score, 0 to 1."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    columns = [F.col(f"`{c}`") for c in kept]
    fields = df.select(*columns).schema.fields
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    # a kept string column is read where it stands; else the text stands last, as a column of its own, so that no other column is touched
    at = kept.index(text) if text in kept and isinstance(fields[kept.index(text)].dataType, T.StringType) else len(kept)
    given = columns if at < len(kept) else [*columns, F.col(f"`{text}`").cast("string").alias(out)]
    near = np.zeros(1 << 16, bool)
    near[(model.words & np.uint64(0xFFFF)).astype(int)] = True
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.words, model.weights, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, words, weights, near = shared.value
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for hashes, row, _, _ in word_sets(batch.column(at)) if len(words) else ():
                maybe = np.flatnonzero(near[hashes & np.uint64(0xFFFF)])
                place = np.minimum(np.searchsorted(words, hashes[maybe]), len(words) - 1)
                hit = words[place] == hashes[maybe]
                once = np.unique(np.stack([row[maybe[hit]], place[hit]]), axis=1)
                total += np.bincount(once[0], weights[once[1]], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(1 / (1 + np.exp(-total)))], [*kept, out])

    return df.select(*given).mapInArrow(wh.trimmed(run), schema)


def labelled(docs: DataFrame, labels: DataFrame, held_out: F.Column, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """text, toxic of the labels to learn from: those with the least hash of doc_id, max_fit_rows at most."""
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out)
    labels = least_hashed(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), max_fit_rows, [], "doc_id").select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "toxic")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out()))
    docs = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
