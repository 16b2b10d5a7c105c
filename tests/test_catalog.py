import pytest

import __spark_entry__ as entry
from quernstone import catalog
from tests.conftest import SF


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "chunk_id", "score", "rank", "lang", "source"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(row[columns.index(c)]) for c in names) for row in found.fetchall())
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == want


def test_lcs_rerank(spark):
    from tests.test_operators import brute_lcs

    queries = {r.query_id: r.tokens for r in catalog.text_queries(spark, SF).collect()}
    chunks = {r.chunk_id: r.tokens for r in catalog.text_chunks(spark, SF).collect()}
    for r in catalog.lcs_rerank(spark, SF).collect():
        assert r.lcs == brute_lcs(queries[r.query_id], chunks[r.chunk_id])


def test_ivf_kmeans_recall(spark):
    exact = {(r.query_id, r.chunk_id) for r in catalog.knn_l2_topk(spark, SF).collect()}
    assert {(r.query_id, r.chunk_id) for r in catalog.ivf_kmeans(spark, SF).collect()} == exact
