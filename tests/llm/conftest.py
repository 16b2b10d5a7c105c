import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, host string, taken string, n_entities string, Component_ID string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like those that operators add."""
    long_text = " ".join(f"word{i % 997} line{i % 13}\n" for i in range(30_000))
    copy = "one two three four five six seven\nsecond line here\nthird line here\nfourth line here"
    rows = [(1, copy), (2, copy + " more"), (2, copy + " more"), (3, ""), (4, None), (None, copy), (None, None), (5, "   \n\t "), (6, "short"), (7, long_text), (8, "the idiot and the scum"), (9, "tëxt ünd süß\x00 \U0001f600 naïve"), (10, "x\n\n\n\n\ny"), (11, "mail a.b@c.example.com now")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "x", "y", "z", None, "q", "c") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
