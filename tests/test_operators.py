import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import embed, text
from quernstone.operators import bm25, evaluate, filters, fusion, rerank, store, vector_index
from quernstone.plans import retrievers, stages
from quernstone.plans.retrievers import Bm25, Ensemble, Reranked, Vector, Weighted, features, retrieve_texts
from quernstone.sources import records
from quernstone.streaming import incremental


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["c", "c", "d", "a"]), (4, [])], "chunk_id long, tokens array<string>"))


def terms(spark, *words):
    return bm25.query_terms(spark.createDataFrame([(1, list(words))], "query_id long, tokens array<string>"))


def scores(hits):
    return {r.chunk_id: round(r.score, 6) for r in hits.collect()}


def test_bm25(spark, index):
    assert index.stats.first().avgdl == 2.25
    assert {r.term: round(r.idf, 6) for r in index.terms.collect()} == {"a": 0.693147, "b": 0.693147, "c": 0.693147, "d": 1.203973}
    assert scores(bm25.exact(index, terms(spark, "a", "d"))) == {3: 1.737122, 1: 0.885364}
    assert scores(bm25.exact(index, terms(spark, "a", "a"))) == {1: 1.770729, 3: 1.269378}
    assert scores(bm25.exact(index, terms(spark, "zz"))) == {}


def test_pruned(spark, index):
    q = terms(spark, "a", "d")
    assert scores(bm25.pruned(index, q)) == {3: 1.737122}
    assert scores(bm25.pruned(index, q, bm25.Params(idf_threshold=0.5))) == {3: 1.737122, 1: 0.885364}


@pytest.mark.parametrize(
    ("min_df", "weights", "found"),
    [
        (1, {"a": 0.456267, "c": 0.132479, "d": 0.366240}, {3: 0.806820, 1: 0.403963, 2: 0.093052}),
        (2, {"a": 0.487281, "b": 0.053948, "c": 0.158771, "d": 0.3}, {3: 0.776001, 1: 0.467395, 2: 0.149412}),
    ],
)
def test_rm3(spark, index, min_df, weights, found):
    rm3 = bm25.Rm3(fb_docs=2, fb_terms=3, orig_weight=0.6, min_df=min_df)
    q = terms(spark, "a", "d")
    assert {r.term: pytest.approx(r.weight, abs=1e-6) for r in bm25.rm3_terms(index, q, rm3=rm3).collect()} == weights
    assert scores(bm25.rm3_search(index, q, rm3=rm3)) == found
    none = terms(spark, "zz")
    assert scores(bm25.rm3_search(index, none, rm3=rm3)) == {}


def test_save_and_load(spark, index, tmp_path):
    assert bm25.load(spark, f"{tmp_path}/x") is None
    bm25.save(index, f"{tmp_path}/x")
    assert scores(bm25.exact(bm25.load(spark, f"{tmp_path}/x"), terms(spark, "a", "d"))) == {3: 1.737122, 1: 0.885364}
    assert bm25.load(spark, f"{tmp_path}/x", version=9) is None


@pytest.fixture(scope="module")
def lists(spark):
    schema = "query_id int, chunk_id long, {} double, rank int"
    a = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.5, 2), (1, 3, 0.9, 3)], schema.format("distance"))
    b = spark.createDataFrame([(1, 3, 8.0, 1), (1, 1, 2.0, 2), (1, 4, 1.0, 3)], schema.format("score"))
    return [fusion.Ranked(a, 0.7, True), fusion.Ranked(b, 0.3)]


def test_fusion(lists):
    assert {r.chunk_id: round(r.score, 9) for r in fusion.rrf(lists, 30).collect()} == {1: 0.031955645, 3: 0.030889541, 2: 0.021875, 4: 0.009090909}
    assert {r.chunk_id: round(r.score, 9) for r in fusion.rsf(lists).collect()} == {1: 0.742857143, 2: 0.4, 3: 0.3, 4: 0.0}
    single = fusion.fuse([None, lists[0]], top_k=2)
    assert [(r.chunk_id, r.score) for r in single.orderBy("rank").collect()] == [(1, 0.2), (2, 0.5)]
    flat = fusion.Ranked(lists[0].hits.withColumn("distance", F.lit(2.0)), 1.0, True)
    assert {r.score for r in fusion.rsf([flat]).collect()} == {1.0}
    with pytest.raises(ValueError):
        fusion.fuse([None])


def test_dedup(spark):
    hits = spark.createDataFrame([(1, i, d, i) for i, d in enumerate([5, 5, 7, 5, 9], 1)], "query_id int, chunk_id long, document_id long, rank int")
    assert [(r.document_id, r.chunk_id) for r in fusion.dedup(hits, 2).orderBy("rank").collect()] == [(5, 1), (7, 3)]
    once = fusion.dedup(hits)
    assert sorted(once.collect()) == sorted(fusion.dedup(once).collect())


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs(spark):
    rng = random.Random(1)
    rows = [(list("12345"), list("29451")), (["1", "2"], ["3"]), (["7"], ["7"]), ([], ["1"]), (["1"], [])] + [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(15))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = [r.x for r in df.orderBy("i").select(rerank.lcs(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [brute_lcs(a, b) for a, b in rows] and got[:5] == [3, 0, 1, 0, 0]
    hits = spark.createDataFrame([(1, 1, ["a", "b"], ["b"]), (1, 2, ["a", "b"], ["a", "b"]), (1, 3, ["a", "b"], ["a"]), (2, 1, [], ["a"]), (2, 2, [], ["b"])], "query_id int, rank int, query_tokens array<string>, tokens array<string>")
    assert [(r.query_id, r.tokens) for r in rerank.rerank(hits, 2).orderBy("query_id", "rank").collect()] == [(1, ["a", "b"]), (1, ["b"]), (2, ["a"]), (2, ["b"])]


def test_clusters(spark):
    assert [vector_index.auto_clusters(n) for n in (5, 270, 10_000, 213_000, 1_000_000)] == [5, 8, 100, 2130, 4096]
    assert [vector_index.auto_probes(c) for c in (8, 64, 2130, 2)] == [4, 8, 16, 2]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, [])], "chunk_id long, embedding array<float>")


def test_ivf(spark, vectors, tmp_path):
    queries = vectors.where("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    centroids = vector_index.train(vectors)
    index = vector_index.assign(vectors, centroids)
    all_ = sorted(vector_index.brute_force(queries, vectors, 7).collect())
    assert len(all_) == 70 and all(r.distance == 0 for r in all_ if r.rank == 1)
    assert sorted(vector_index.search(queries, index, centroids, 7, nprobe=99).collect()) == all_
    few = vector_index.search(queries, index, centroids, 250, nprobe=1)
    assert few.groupBy("query_id").count().where("count = 250").count() == 10
    allowed = queries.select("query_id").crossJoin(vectors.where("chunk_id % 50 = 3").select("chunk_id"))
    kept = vector_index.search(queries, index, centroids, 6, nprobe=1, allowed=allowed)
    assert kept.where("chunk_id % 50 != 3").count() == 0 and kept.count() == 60
    none = vector_index.search(queries, index, centroids, 6, allowed=allowed.limit(0))
    assert none.count() == 0
    vector_index.save(index, centroids, f"{tmp_path}/v")
    saved, c = vector_index.load(spark, f"{tmp_path}/v")
    assert saved.count() == 300 and c.count() == 8 and vector_index.load(spark, f"{tmp_path}/none") is None
    plan = saved.where("cluster_id = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan


def test_brute_force_in_blocks(spark, vectors, monkeypatch):
    queries = vectors.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    allowed = queries.select("query_id").join(vectors.select("chunk_id"), F.expr("(query_id + chunk_id) % 3 = 0"))
    whole = [sorted(vector_index.brute_force(queries, vectors, 7, a).collect()) for a in (None, allowed)]
    monkeypatch.setattr(vector_index, "QUERY_BATCH", 9)
    assert [sorted(vector_index.brute_force(queries, vectors, 7, a).collect()) for a in (None, allowed)] == whole
    assert len(whole[0]) == 280


def test_ensemble(spark, index):
    queries = spark.createDataFrame([(1, ["a", "d"], [0.0, 1.0])], "query_id long, tokens array<string>, embedding array<double>")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 5.0])], "chunk_id long, embedding array<double>")
    lexical, near = retrievers.Bm25(index), retrievers.Vector(vectors)
    both = retrievers.Ensemble([retrievers.Weighted(lexical, 0.3), retrievers.Weighted(near, 0.7), retrievers.Weighted(retrievers.Vector(None))])
    assert [r.chunk_id for r in both.retrieve(queries).orderBy("rank").collect()] == [1, 3, 2]
    nested = retrievers.Ensemble([retrievers.Weighted(both, 1.0), retrievers.Weighted(lexical, 1.0)])
    assert nested.retrieve(queries, top_k=2).count() == 2
    assert retrievers.summary(bm25.Params(k1=1.5)) == ["k1=1.5"] and not retrievers.Vector(None).ready()
    swept = retrievers.sweep(queries, {"a": lexical, "b": near}, lambda name, hits: hits.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)))
    assert {r.name: r.n for r in swept.collect()} == {"a": 2, "b": 3}


def test_filters(spark):
    rows = spark.createDataFrame([(1, 1, "x", 10, 100), (2, 3, "X", 11, 200), (3, 1, "x", 12, 300)], "chunk_id long, source_type int, sender string, document_id long, created_at long")
    found = lambda text: [r.chunk_id for r in filters.allowed_ids(rows, text).orderBy("chunk_id").collect()]
    assert found("") == found("{}") == [1, 2, 3]
    assert found('{"source_type": 1}') == [1, 3] and found('{"source_type": {"in": [3, 9]}}') == [2]
    assert found('{"sender": "x", "created_at": {"gt": 100}}') == [3] and found('{"created_at": {"gte": 100, "lte": 200}}') == [1, 2]
    assert found('{"document_id": {"in": [10, 12]}, "created_at": {"lt": 300}}') == [1] and found('{"created_at": 200}') == [2]


def test_query_filters(spark):
    specs = spark.createDataFrame([("t1", "2026-01-10", "2026-01-10", ["Message"]), ("t2", None, None, ["image"])], "target_id string, start_date string, end_date string, domains array<string>")
    truth = spark.createDataFrame([("q1", 1, "t2"), ("q1", 0, "t1"), ("q2", 0, "t2")], "query_id string, position int, target_id string")
    chunks = spark.createDataFrame([(1, 1, 1767970800000), (2, 1, 1767970799999), (3, 0, 1767970800000)], "chunk_id long, source_type int, created_at long")
    assert [(r.query_id, r.chunk_id) for r in filters.query_filters(specs, truth, chunks).collect()] == [("q1", 1)]
    assert filters.query_filters(specs, truth, chunks, fallback=True).where("query_id = 'q2'").count() == 3


def test_store(spark):
    docs = spark.createDataFrame([(1, "sms_1", 5, 0), (2, "call_2", 6, 0), (3, "img_3", 7, 3)], "document_id long, external_id string, created_at long, source_type int")
    chunks = spark.createDataFrame([(10, 1, 1, [1.0]), (11, 1, 0, None), (12, 2, 0, [])], "chunk_id long, document_id long, chunk_index int, embedding array<float>")
    assert [r.document_id for r in store.orphans(docs, chunks).collect()] == [3]
    assert sorted(r.chunk_id for r in store.first_chunks(chunks).collect()) == [11, 12]
    assert sorted(r.chunk_id for r in store.missing_vectors(chunks).collect()) == [11, 12]
    kept, left = store.delete_documents(docs, chunks, docs.where("document_id = 1"))
    assert kept.count() == 2 and left.count() == 1
    assert store.delete_documents(docs, chunks, docs.where("document_id = 1"), cascade=False)[1].count() == 3
    patch = spark.createDataFrame([("sms_1", 99), ("call_2", 0), ("zz", 4)], "external_id string, ts long")
    assert sorted(r.created_at for r in store.set_created_at(docs, patch).collect()) == [6, 7, 99]
    new, changed = store.set_source_type(docs, spark.createDataFrame([("sms_1", 1), ("img_3", 3)], "external_id string, new_type int"))
    assert changed.first().changed == 1 and not store.is_patched(docs) and store.is_patched(store.infer_source_type(docs))
    assert [r.source_type for r in store.infer_source_type(docs).orderBy("document_id").collect()] == [1, 0, 3]
    updated = store.update(docs, spark.createDataFrame([(1, "new"), (0, "no")], "document_id long, external_id string"), "document_id")
    assert sorted(r.external_id for r in updated.collect()) == ["call_2", "img_3", "new"]
    assert store.each_batch(docs.select("document_id"), lambda b: b.slice(0, 1), "document_id long").count() >= 1
    assert store.without(chunks, "embedding").columns == ["chunk_id", "document_id", "chunk_index"]
    pages = store.page(docs.withColumn("content", F.lit("é" * 200)), "document_id", 1, 5)
    assert pages.count() == 2 and "é" * 150 + '"' in pages.first().json and "é" * 151 not in pages.first().json


@pytest.mark.parametrize(("n", "total"), [(1, 10), (3, 10), (7, 10), (10, 10), (20, 10), (4, 9)])
def test_stride_sample(spark, n, total):
    df = spark.range(total).select((F.col("id") * 3).alias("k"))
    got = sorted(r.k // 3 for r in store.stride_sample(df, n, "k").collect())
    assert got == sorted({i * total // n for i in range(n)} if n < total else range(total))


def test_evaluation(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    hits = spark.createDataFrame([(q, d, d) for q in "abcd" for d in range(1, 61)], "query_id string, document_id long, rank int").withColumn("chunk_id", F.col("document_id"))
    truth = spark.createDataFrame([("a", 3), ("a", 99), ("b", 6)] + [("c", d) for d in (1, 2, 40, 50, 51, 99)], "query_id string, document_id long")
    rows = {r.query_id: (r.hit, r.recall, r.eval_k) for r in evaluate.by_query(queries, hits, truth).collect()}
    assert rows == {"a": (1, 0.5, 5), "b": (0, 0.0, 5), "c": (1, pytest.approx(4 / 6), 50), "d": (0, 0.0, 5)}
    total = evaluate.summary(evaluate.by_query(queries, hits, truth), "m")
    assert total.first().hit_rate == 50 and evaluate.best(total.union(total.withColumn("hit_rate", F.lit(60.0)))).first().hit_rate == 60
    assert evaluate.details({"m": hits.where("rank < 3")}).where("query_id = 'a'").first().results == {"m": "[1,2]"}


def test_stages():
    assert stages.resolve({"eco_load"}) == ["eco_load", "eco_chunk", "eco_embed", "eco_tokenize", "eco_vector_index", "eco_bm25_index"]
    assert stages.resolve({"eco_export_chunks"}) == ["eco_load", "eco_chunk", "eco_export_chunks"]
    assert stages.resolve({"eco_chunk", "eco_import_embed"}) == ["eco_chunk", "eco_import_embed", "eco_tokenize", "eco_vector_index", "eco_bm25_index"]
    assert stages.resolve({"bench_load"}) == ["bench_load", "bench_embed", "bench_tokenize"] and stages.resolve([]) == []
    assert stages.run(["eco_tokenize"], {"eco_tokenize": lambda: 1, "eco_bm25_index": lambda: 2}) == {"eco_tokenize": 1, "eco_bm25_index": 2}
    with pytest.raises(ValueError):
        stages.resolve(["none"])


def test_records(spark, tmp_path):
    (tmp_path / "sms.jsonl").write_text('{"_id":"1","body":" hi <b>you</b>","datetime":"2026-01-10 00:00:00","date":5,"address":"me"}\n\nnot json\n{"_id":"2","body":" ","date":7}\n{bad\n{"_id":"3","body":"x","date":7}\n')
    sms = {r.external_id: r for r in records.sms_documents(records.json_lines(spark, str(tmp_path / "sms.jsonl"), records.SMS)).collect()}
    assert set(sms) == {"sms_1", "sms_3"} and sms["sms_1"].created_at == 1767970800000 and sms["sms_1"].content == "hi you" and sms["sms_3"].created_at == 7
    (tmp_path / "mms.jsonl").write_text('{"_id":"1","text_combined":"a","date":1700000000,"sub":"s"}\n{"_id":"2","text_combined":"b","date":1700000000000}\n')
    assert {r.created_at for r in records.mms_documents(records.json_lines(spark, str(tmp_path / "mms.jsonl"), records.MMS)).collect()} == {1700000000000}
    (tmp_path / "call").mkdir()
    (tmp_path / "call/c9.json").write_text('{"conversation": ["A: hello", "no colon", "B:", "B: b: c"], "summary_1line": "sum",\n "call_start_datetime": "2026-01-10T00:00:00"}')
    call = records.call_documents(records.call_files(spark, str(tmp_path / "call"))).first()
    assert (call.external_id, call.content, call.description, call.created_at, call.source_type) == ("call_c9", "hello\nb: c", "sum", 1767970800000, 0)
    (tmp_path / "q.jsonl").write_text('{"query_id":1,"query":"q","original_query":"o  o","target_corpus_ids":["S1","zz"],"domains":["message"],"top_k":5}\n{"query_id":2,"query":"only image","domains":["image"]}\n{"query_id":3,"query":"plain"}\n')
    ids = spark.createDataFrame([("s1", "sms_S1")], "raw_id string, external_id string")
    queries, truth = records.queries(records.json_lines(spark, str(tmp_path / "q.jsonl"), records.QUERY), ids)
    assert {r.external_id: r.content for r in queries.collect()} == {"q_1": "o o", "q_3": "plain"} and [tuple(r) for r in truth.collect()] == [("q_1", 0, "sms_S1")]
    (tmp_path / "f.jsonl").write_text('{"target_corpus_ids":["a","b"],"filters":{"time_window":{"start_date":"2026-01-10","end_date":"2026-01-11"}},"domains":["sms"]}\n{"target_corpus_id":"c"}\n')
    specs = records.filter_specs(records.json_lines(spark, str(tmp_path / "f.jsonl"), records.FILTER)).collect()
    assert [(r.target_id, r.start_date) for r in specs] == [("a", "2026-01-10"), ("b", "2026-01-10"), ("c", None)]


def test_incremental(spark, vectors, tmp_path):
    centroids = vector_index.train(vectors)
    vector_index.save(vector_index.assign(vectors, centroids), centroids, f"{tmp_path}/v")
    vectors.withColumn("chunk_id", F.col("chunk_id") + 1000).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/in")
    incremental.add_vectors(stream, f"{tmp_path}/v", f"{tmp_path}/ckpt").awaitTermination(120)
    added = spark.read.parquet(f"{tmp_path}/v/added")
    assert added.count() == 300 and {(r.chunk_id - 1000, r.cluster_id) for r in added.collect()} == {(r.chunk_id, r.cluster_id) for r in spark.read.parquet(f"{tmp_path}/v/vectors").collect()}


def test_added_vectors_are_found(spark, vectors, tmp_path):
    """Keys of the build or of earlier batches aren't added again; searches of the loaded index see the others."""
    path, source = str(tmp_path / "index"), str(tmp_path / "new")
    vectors = vectors.where("size(embedding) > 0")
    first = vectors.where("chunk_id < 60")
    centroids = vector_index.train(first, 4)
    vector_index.save(vector_index.assign(first, centroids), centroids, path)
    for _ in range(2):
        vectors.where("chunk_id >= 50").write.mode("append").parquet(source)
        stream = spark.readStream.schema(vectors.schema).parquet(source)
        incremental.add_vectors(stream, path, str(tmp_path / "log")).awaitTermination()
    index, found = vector_index.load(spark, path)
    assert index.count() == vectors.count() == index.select("chunk_id").distinct().count()
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    want = vector_index.brute_force(queries, vectors, 5).select("query_id", "chunk_id").collect()
    assert set(vector_index.search(queries, index, found, 5, nprobe=4).select("query_id", "chunk_id").collect()) == set(want)
    assert vector_index.ready(spark, path) and vector_index.info(index, found).first().clusters == 4
    vector_index.remove(spark, path)
    assert not vector_index.ready(spark, path)


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "bm25")
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c C d a"), (4, None)], "chunk_id long, content string")
    index = bm25.rebuild(chunks, path, text.tokens)
    terms = bm25.query_terms(spark.createDataFrame([(1, ["a", "c", "none"])], "query_id long, tokens array<string>"))
    fresh = bm25.build(chunks.select("chunk_id", F.coalesce(text.tokens(F.col("content")), F.array().cast("array<string>")).alias("tokens")))
    for search in (bm25.exact, bm25.pruned, bm25.rm3_search):
        one, two = ([(r.chunk_id, round(r.score, 9)) for r in search(i, terms).orderBy("rank").collect()] for i in (index, fresh))
        assert one == two, search.__name__
    assert bm25.ready(spark, path)
    docs, gone = store.remove_all(chunks, chunks, path)
    assert not bm25.ready(spark, path) and docs.count() == gone.count() == 0 and docs.columns == chunks.columns


def test_stored_index_is_pruned_by_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "PART_TOKENS", 10)
    chunks = spark.createDataFrame([(i, [f"t{i % 7}", f"t{i % 5}", "t"]) for i in range(60)], "chunk_id long, tokens array<string>")
    bm25.save(bm25.build(chunks), str(tmp_path / "i"))
    index = bm25.load(spark, str(tmp_path / "i"))
    assert index.parts == 19
    terms = bm25.query_terms(spark.createDataFrame([(1, ["t3", "t6"])], "query_id long, tokens array<string>"))
    want = [(r.chunk_id, round(r.score, 9)) for r in bm25.exact(bm25.build(chunks), terms).orderBy("rank").collect()]
    assert [(r.chunk_id, round(r.score, 9)) for r in bm25.exact(index, terms).orderBy("rank").collect()] == want


def test_exchange_files(spark, tmp_path):
    patch = tmp_path / "patch.jsonl"
    patch.write_text('{"id": "sms_1", "ts": 5}\n{"id": "sms_2", "ts": 0}\nno json\n{"id": null, "ts": 7}\n')
    assert [tuple(r) for r in records.date_patch(spark, str(patch)).collect()] == [("sms_1", 5)]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("  x  y \n\n\n\nz")
    docs = records.text_source(str(tmp_path / "texts")).documents(spark).collect()
    assert [(r.external_id, r.content) for r in docs] == [("document_a", "x y\n\nz")]
    hits = spark.createDataFrame([(1, 9, 2), (1, 8, 1), (2, 7, 1)], "query_id long, document_id long, rank int")
    evaluate.write_details({"m": hits, "n": hits.where("query_id = 1")}, str(tmp_path / "d"))
    got = {r.query_id: dict(r.results) for r in evaluate.read_details(spark, str(tmp_path / "d")).collect()}
    assert got == {1: {"m": [8, 9], "n": [8, 9]}, 2: {"m": [7]}}
    rows = spark.createDataFrame([(1, "no json"), (2, '[{"chunk_id":3,"document_id":4,"content":"c","score":0.5}]')], "query_id long, json string")
    assert [(r.query_id, r["rank"], r.chunk_id, r.score) for r in store.results_from_json(rows).collect()] == [(2, 1, 3, 0.5)]
    assert store.open_table(spark, str(tmp_path / "none"), store.CHUNKS).columns[0] == "chunk_id"
    with_time, ms = evaluate.timed(hits, str(tmp_path / "hits"))
    assert with_time.count() == 3 and ms > 0
    queries = spark.createDataFrame([("q1", None), ("q2", None)], "external_id string, embedding array<float>")
    new = spark.createDataFrame([("q1", [1.0]), ("q2", []), ("q3", [2.0])], "external_id string, embedding array<float>")
    out, errors = store.import_query_embeddings(queries, new)
    assert {r.external_id: r.embedding for r in out.collect()} == {"q1": [1.0], "q2": None} and tuple(errors.first()) == (1, 1, 1)


def test_embedder(spark):
    model = embed.buckets(4)
    long_text = " ".join(f"w{i}" for i in range(600))
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, long_text)], "id long, t string")
    ids = {r.id: r.x for r in df.select("id", model.ids(F.col("t")).alias("x")).collect()}
    assert ids[2] == [2, 3] and ids[3] is None and len(ids[4]) == 512 and ids[1][0] == 2 and ids[1][-1] == 3
    for r in df.select("id", model.column(F.col("t")).alias("v")).collect():
        if r.id == 3:
            assert r.v is None
        else:
            counts = [sum(x % 4 == k for x in ids[r.id]) for k in range(4)]
            size = sum(c * c for c in counts) ** 0.5
            assert r.v == pytest.approx([c / size for c in counts], abs=1e-6)
    pad = embed.embedded([[2, 3], [2, 5, 9, 3]], lambda i, m: np.ones((*i.shape, 3)) * i[:, :, None], 3, 2)
    assert pad == pytest.approx(np.full((2, 3), 3**-0.5))
    back = spark.createDataFrame([([2, 7, 8, 3],), (None,)], "x array<int>").select(embed.decoded(F.col("x"), lambda: lambda ids: "-".join(map(str, ids))).alias("t")).collect()
    assert [r.t for r in back] == ["7-8", None]


def test_text_entry(spark, index):
    texts = spark.createDataFrame([(1, "A d", "")], "query_id long, text string, refined_text string")
    lexical = Bm25(index)
    hits = retrieve_texts(lexical, texts).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in hits] == [(3, 1.737122), (1, 0.885364)]
    assert features(texts, lexical.needs()).columns == ["query_id", "tokens"]
    vectors = Vector(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>"))
    both = Ensemble([Weighted(lexical), Weighted(vectors), Weighted(Vector(None))])
    assert both.needs() == {"tokens", "embedding"} and Reranked(vectors, None).needs() == {"tokens", "embedding"}
    with pytest.raises(ValueError):
        features(texts, {"embedding"})
    with pytest.raises(ValueError):
        both.retrieve(texts, depths=[1])
    with_rm3 = Bm25(index, rm3=bm25.Rm3())
    queries = features(texts, {"tokens"})
    assert [r.chunk_id for r in with_rm3.by_tokens(queries).orderBy("rank").collect()] == [3, 1]
    assert with_rm3.retrieve(queries).count() == 3


def test_reranked_pool(spark):
    """The pool is three times the depth; a chunk that only the pool has can win."""
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(1, 9)], "chunk_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, ["x", "y"] if i in (6, 7) else ["z"]) for i in range(1, 9)], "chunk_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, [0.0], ["x", "y"])], "query_id long, embedding array<double>, tokens array<string>")
    got = Reranked(Vector(vectors), chunks, 2).retrieve(queries).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(6, 2.0), (1, 0.0)]
    centroids = spark.createDataFrame([(0, [4.0])], "cluster_id int, centroid array<double>")
    stored = vector_index.reranked(queries, vector_index.assign(vectors, centroids), centroids, chunks, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.lcs) for r in stored] == [(6, 2), (1, 0)]


def test_filters_of_hits(spark):
    hits = spark.createDataFrame([(q, c) for q in ("q1", "q2", "q3") for c in (1, 2)], "query_id string, chunk_id long")
    chunks = spark.createDataFrame([(1, 0, 1767970800000), (2, 1, 0)], "chunk_id long, source_type int, created_at long")
    wanted = spark.createDataFrame([("q1", [0], None, None), ("q2", [4], None, None)], "query_id string, types array<int>, low long, high long")
    keep = lambda fallback: {(r.query_id, r.chunk_id) for r in filters.passing(hits, wanted, chunks, fallback).collect()}
    assert keep(False) == {("q1", 1), ("q3", 1), ("q3", 2)}
    assert keep(True) == keep(False) | {("q2", 1), ("q2", 2)}
    day = spark.createDataFrame([("q1", [], 1767970800000, 1767970800000 + 86_399_999), ("q2", [], 1, 86_399_999)], "query_id string, types array<int>, low long, high long")
    assert [r.query_id for r in filters.matching(day, chunks).collect()] == ["q1"]
