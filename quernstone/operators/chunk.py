"""Token-budgeted chunks of whole segments, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as tx

MAX_TOKENS, OVERLAP = 216, 128


def spans(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """[first, after last) of each chunk of segments of these sizes.

    A chunk always takes its first segment, then more while they fit. The next one starts at the last segment from
    which the chunk's rest has `overlap` tokens, but past this chunk's first segment.
    """
    if sum(sizes) <= most:
        return [(0, len(sizes))] if sizes else []
    out, at = [], 0
    while True:
        end, used = at + 1, sizes[at]
        while used < most and end < len(sizes) and used + sizes[end] <= most:
            used += sizes[end]
            end += 1
        out.append((at, end))
        if end >= len(sizes):
            return out
        back, shared = end, 0
        while back > at and shared < overlap:
            back -= 1
            shared += sizes[back]
        at = back if back > at else (at + 1 if end - at > 1 else end)


def chunks(text: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP, count=None) -> Column:
    """array<string> of a text's chunks. count: segment column to token number, by default its words between blanks.

    Segments and their sizes are native; the greedy walk, whose every step needs the one before, is an Arrow UDF, which also
    joins the chunks, so that a text is split once however many chunks it has.
    """
    count = count or (lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))

    @F.pandas_udf("array<string>")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts, sizes in batches:
            yield pd.Series([[] if s is None else [" ".join(p[a:b]) for a, b in spans([int(x) for x in s], most, overlap)] for p, s in zip(parts, sizes, strict=True)], dtype=object)

    parts = tx.segments(text)
    return walk(parts, F.transform(parts, count))


def chunk_documents(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, count=None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, chunk_index from 0, content."""
    return docs.select(*keep, F.posexplode(chunks(F.col(text), most, overlap, count)).alias("chunk_index", "content"))


def with_prefix(content: Column, source_type: Column, description: Column) -> Column:
    """Calls carry their summary before each chunk; the budget doesn't count it."""
    return F.when((source_type == 0) & (F.coalesce(description, F.lit("")) != ""), F.concat_ws("\n", description, content)).otherwise(content)
