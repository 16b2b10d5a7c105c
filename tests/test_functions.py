import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.functions import times, vector
from quernstone.operators import chunk


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else 'array<double>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_segments(spark):
    assert one(spark, tx.segments(F.col("t")), t="a b c. d e. f g h i. j.\nk l m n o p q r. s t") == ["a b c.", "d e.", "f g h i.", "j.", "k l m n o p q r.", "s t"]
    assert one(spark, tx.segments(F.col("t")), t="v1.2 ok... yes") == ["v1.2 ok...", "yes"]


@pytest.mark.parametrize(
    ("most", "overlap", "want"),
    [
        (6, 3, ["a b c. d e.", "d e. f g h i.", "f g h i. j.", "j.", "k l m n o p q r.", "s t"]),
        (100, 3, ["a b c. d e. f g h i. j. k l m n o p q r. s t"]),
        (6, 100, ["a b c. d e.", "d e. f g h i.", "f g h i. j.", "j.", "k l m n o p q r.", "s t"]),
    ],
)
def test_chunks(spark, most, overlap, want):
    assert one(spark, chunk.chunks(F.col("t"), most, overlap), t="a b c. d e. f g h i. j.\nk l m n o p q r. s t") == want


@given(st.lists(st.integers(0, 12), max_size=40), st.integers(1, 20), st.integers(0, 20))
@settings(max_examples=300)
def test_spans(sizes, most, overlap):
    spans = chunk.spans(sizes, most, overlap)
    assert {i for a, b in spans for i in range(a, b)} == set(range(len(sizes)))
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(b - a == 1 or sum(sizes[a:b]) <= most for a, b in spans)


def test_chunks_of_nothing(spark):
    assert one(spark, chunk.chunks(F.col("t")), t="") == []


def test_prefix(spark):
    df = spark.createDataFrame([("c", 0, "d"), ("c", 0, ""), ("c", 1, "d"), ("c", 0, None)], "c string, s int, d string")
    assert [r.x for r in df.select(chunk.with_prefix(F.col("c"), F.col("s"), F.col("d")).alias("x")).collect()] == ["d\nc", "c", "c", "c"]


def test_cleaning(spark):
    text = "\x00<b>Tïtle</b>&nbsp;&amp;x ● １２３！\n  - 12 -  \n[ 3 ]\nPage 4\nwait..... ---- ____ done   now\n\n\n\nend\r\n \n"
    assert one(spark, tx.clean_document(F.col("t")), t=text) == "Tïtle x 123!\n\nwait. - done now\n\nend"
    assert one(spark, tx.clean_query(F.col("t")), t="  a\x07  ★ｂ <i>&amp; ") == "a b <i>&amp;"
    assert one(spark, tx.clean_document(F.col("t"), compose=True), t=unicodedata.normalize("NFD", "é한")) == "é한"


def test_urls(spark):
    assert one(spark, tx.strip_urls(F.col("t")), t=" see https://a.b/c?d  or\n\nwww.x.y now ") == "see or now"
    assert one(spark, tx.contains_url(F.col("t")), t="at www.x") and not one(spark, tx.contains_url(F.col("t")), t="http:/x")


def test_synonyms(spark):
    table = tx.parse_synonyms(["# words", "the\tder", "the\tdie", "", "x", "and\tund"])
    assert table == {"the": ["der", "die"], "and": ["und"]}
    assert one(spark, tx.expand_synonyms(F.col("w"), table), w=["the", "cat", "and"]) == ["the", "der", "die", "cat", "and", "und"]


@pytest.mark.parametrize("size", range(12))
def test_truncate(spark, size):
    text = "aé한😀b"
    want = next(text[:k] for k in range(len(text), -1, -1) if len(text[:k].encode()) <= size)
    assert one(spark, tx.truncate_utf8(F.col("t"), size), t=text) == want


def test_token_hashes(spark):
    words = {"": -1832243442, "a": -1576044158, "ab": 63965626, "abc": 2016009243, "abcd": -1119261418, "abcde": 871543919, "spark": 667275550, "검색": 1155020457}
    assert one(spark, tx.token_hashes(F.col("w")), w=list(words)) == list(words.values())


def test_times(spark):
    assert one(spark, times.day_start(F.col("t")), t="2026-01-10") == 1767970800000
    assert one(spark, times.day_end(F.col("t")), t="2026-01-20") == 1768921199999
    assert one(spark, times.to_millis(F.col("t")), t="2026-01-10T00:00:00") == 1767970800000
    assert one(spark, times.to_millis(F.col("t")), t="soon") == 0
    assert one(spark, times.to_iso(F.col("t")), t=1767970800000) == "2026-01-10T00:00:00+09:00" and one(spark, times.to_iso(F.col("t")), t=0) == ""


def test_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [0.0, 4.0, 3.5]
    assert one(spark, vector.squared_l2(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(5.25)
    assert one(spark, vector.normalize(F.col("a")), a=a) == pytest.approx(list(np.array(a) / np.linalg.norm(a)))
    assert one(spark, vector.normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0])], "r array<array<double>>, m array<int>")
    assert rows.select(vector.mean_pool(F.col("r"), F.col("m")).alias("x")).first().x == [2.0, 4.0]
