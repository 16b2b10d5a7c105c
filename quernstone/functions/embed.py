"""Embedding texts: token ids, a pluggable model over padded batches, masked mean, unit length.

A model is given as a function that loads it, called once in each Python worker, so that nothing large is sent with the
plan. No weights are shipped: `buckets` is a model without any, for tests and as a baseline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import text as tx

#: Ids of the first and the last token, the longest sequence, and the least norm that is divided by.
FIRST, LAST, MOST, EPS = 2, 3, 512, 1e-10
#: (token ids, mask), both texts x places, to vectors, texts x places x dimensions.
Forward = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Embedder(Protocol):
    dim: int

    def column(self, text: Column) -> Column: ...


def with_ends(ids: Sequence[int], most: int = MOST) -> list[int]:
    """Ids cut to `most` with the first and last token."""
    return [FIRST, *ids[: most - 2], LAST]


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over unmasked places, in unit length; a vector of no length stays."""
    mean = (vectors * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(norm < EPS, mean, mean / np.maximum(norm, EPS))


def embedded(rows: list[list[int]], forward: Forward, dim: int, batch: int) -> np.ndarray:
    """Vectors of token id lists. Texts of like length share a batch, padded to its longest."""
    out = np.zeros((len(rows), dim))
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for at in range(0, len(rows), batch):
        some = order[at : at + batch]
        ids = np.zeros((len(some), max(len(rows[i]) for i in some)), np.int64)
        mask = np.zeros(ids.shape)
        for k, i in enumerate(some):
            ids[k, : len(rows[i])], mask[k, : len(rows[i])] = rows[i], 1
        out[some] = pooled(forward(ids, mask), mask)
    return out


@dataclass(frozen=True)
class TokenEmbedder:
    """load: gives the model. encode: gives (tokens of a text to ids), likewise loaded once in each worker."""

    load: Callable[[], Forward]
    encode: Callable[[], Callable[[list[str]], list[int]]]
    dim: int
    batch: int = 32
    most: int = MOST
    tokenize: Callable[[Column], Column] = field(default=tx.tokens)

    def ids(self, text: Column) -> Column:
        """array<int> of token ids with their ends; null stays null."""
        load, most = self.encode, self.most

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = load()
            for words in batches:
                yield words.map(lambda ws: None if ws is None else with_ends(one(list(ws)), most))

        return encode(self.tokenize(text))

    def column(self, text: Column) -> Column:
        """array<float>; a text that is null has none."""
        load, dim, batch = self.load, self.dim, self.batch

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            forward = load()
            for ids in batches:
                known = ids.notna()
                vectors = iter(embedded([list(x) for x in ids[known]], forward, dim, batch).astype(np.float32).tolist())
                yield pd.Series([next(vectors) if k else None for k in known], index=ids.index, dtype=object)

        return embed(self.ids(text))


def decoded(ids: Column, decode: Callable[[], Callable[[list[int]], str]]) -> Column:
    """Texts of token ids, without their ends. decode: gives the function, loaded once in each worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = decode()
        for rows in batches:
            yield rows.map(lambda r: None if r is None else one([int(x) for x in r if x not in (FIRST, LAST)]))

    return run(ids)


def file_tokenizer(path: str) -> tuple[Callable, Callable]:
    """(encode of token lists, decode) of a tokenizer file, which all workers must reach under this path."""

    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode() -> Callable[[list[str]], list[int]]:
        model = load()
        return lambda words: model.encode(" ".join(words), add_special_tokens=False).ids

    def decode() -> Callable[[list[int]], str]:
        return load().decode

    return encode, decode


def bucket_ids() -> Callable[[list[str]], list[int]]:
    """Ids from 4 on, by the first 16 bits of a token's MD5. Tokens beyond the longest sequence have none; those that were hashed last are remembered."""

    @lru_cache(1 << 18)
    def one(word: str) -> int:
        return 4 + int(hashlib.md5(word.encode()).hexdigest()[:4], 16)

    return lambda words: [one(w) for w in words[:MOST]]


def buckets(dim: int = 16) -> TokenEmbedder:
    """Each id is a unit vector in place id mod dim: texts are near that share tokens."""

    def load() -> Forward:
        eye = np.eye(dim)
        return lambda ids, mask: eye[ids % dim]

    return TokenEmbedder(load, bucket_ids, dim)
