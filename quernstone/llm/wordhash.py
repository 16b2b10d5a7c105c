"""Vectorised tokens of Arrow text batches: word spans, 64-bit word hashes and n-gram hashes.

A word's hash is a polynomial of its bytes modulo 2^64, finished with an invertible mixer; it depends on the
word alone. Arrays are built for about half a megabyte of text at a time, so that one very long text or one large
Arrow batch needs no more memory than its own bytes and eight bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

#: Which bytes stand between words: `[\x20\x09-\x0D]`.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Which bytes stand between words: all of ASCII but letters and digits.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(max(n, SEGMENT + 4096), base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], in ascending disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = power(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def hash_word(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(word)]))[0]) if word else 0


class Words:
    """The words of consecutive texts. first: word offsets by text, one more than texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray):
        inside = ~between[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after[-1:], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_spans(data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z alone in lower case."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def spans(offsets: np.ndarray, size: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) for runs of rows of about `size` bytes; a longer row is a run of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def pieces(column: pa.Array, between: np.ndarray, lower: bool = True, size: int = 2 * SEGMENT) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for the runs that `spans` gives."""
    data, offsets = text_buffers(column)
    for at, to in spans(offsets, size):
        part = data[offsets[at] : offsets[to]]
        yield at, to, Words(lowered(part) if lower else part, offsets[at : to + 1] - offsets[at], between)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by the place of the first; n - 1 fewer than words."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += words[k : k + size] * np.uint64((pow(BASE, k + 1, 1 << 64) ^ 0x5851F42D4C957F2D) | 1)
    return mix(total)


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for further tasks, doesn't hold on to what the arrays of this one took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole
