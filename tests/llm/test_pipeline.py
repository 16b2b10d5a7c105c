import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import brute_classes, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == sorted(tuple(show(v) for v in row) for row in want)


def test_stages(spark, tmp_path):
    """Each stage against plain Python, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        ids = sorted(before)
        if name == "toxicity":
            assert 0.7 * len(before) < len(after) < len(before) and all(before[i] == t for i, t in after.items())
        elif name == "line dedup":
            assert after == {i: t for i, (t, _, _) in zip(ids, brute_lines([(i, before[i]) for i in ids]), strict=True)}
        elif name == "n-gram Jaccard join":
            want = brute_classes([before[i] for i in ids], 5, 80)
            assert set(after) == {ids[i] for i, (_, c) in want.items() if c == i}
        elif name == "benchmark decontamination":
            hits = {i: brute_hits(before[i], items)[:2] for i in ids}
            assert set(after) == {i for i, (_, h) in hits.items() if h == 0} and len(after) < len(before)
        else:
            assert set(after) <= set(before) and out.agg(F.sum("taken")).first()[0] == pytest.approx(out.select("source", "target").distinct().agg(F.sum("target")).first()[0], abs=40)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out


def test_stages_take_messy_and_empty_tables(spark, messy, empty):
    for docs in (messy, empty):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


CLASHING = ["toxicity", "n_lines", "n_removed", "n_words", "hit_spans", "hit_items", "hit_text", "component_id", "nc_hash2", "ld_text", "score"]


def test_stages_keep_clashing_columns(spark, messy):
    """Columns named like those that operators add come out as they went in, for each row that stays."""
    docs = messy.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING), name


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, ties and repeated rows have the results that the pipeline states."""
    t = "one two three four five six seven eight nine"
    rows = [(1, None), (2, ""), (2, ""), (None, t), (5, t), (5, t), (4, t), (4, "its own text under an id that a copy has"), (None, None)]
    docs = spark.createDataFrame([(i, x, None, None) for i, x in rows], "doc_id long, text string, source string, n_chars long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "line dedup", "benchmark decontamination"):
        assert sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, SF).collect()), key=key) == sorted(rows, key=key), name
    left = sorted(((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, docs, SF).collect()), key=key)
    assert left == sorted([(1, None), (2, ""), (2, ""), (4, t), (4, rows[7][1]), (None, None)], key=key)
    again = docs.where("doc_id = 5")
    assert stages["n-gram Jaccard join"](spark, again, SF).count() == 1
    taken = stages["mixing sources"](spark, docs, SF).collect()
    assert all(r.text and r.taken > 0 for r in taken)
