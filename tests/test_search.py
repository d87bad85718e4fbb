import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import metrics
from gridloom.operators import bm25, evaluation, fusion
from gridloom.plans import pipeline
from gridloom.sources import tables

PAGES = "page_id bigint, title string, content string"


def test_bm25(spark):
    pages = spark.createDataFrame([(1, "", "red fox"), (2, None, "red dog dog"), (3, "blue", "cat")], PAGES)
    index = bm25.build(pages)
    assert [(r["term"], round(r["idf"], 6)) for r in index["vocab"].collect()] == [("red", 0.470004)]
    queries = spark.createDataFrame([("q", "red red fox"), ("e", ""), ("n", None)], "query_id string, query string")
    got = {r["page_id"]: round(r["score"], 6) for r in bm25.scores(index, queries).collect()}
    assert got == {1: 0.519478, 2: 0.394803}
    empty = bm25.build(spark.createDataFrame([], PAGES))
    assert bm25.scores(empty, queries).count() == 0


def test_rerank(spark):
    scores = spark.createDataFrame([("q", 0, 5.0), ("q", 1, 4.0), ("q", 2, 3.5), ("q", 3, 0.5)], "query_id string, page_id bigint, score double")
    groups = spark.createDataFrame([(0, 10), (1, 11), (2, 11), (3, 10)], "page_id bigint, cluster_id bigint")
    rows = fusion.rerank(scores, groups, 4).orderBy("rank").collect()
    assert [r["page_id"] for r in rows] == [1, 2, 0, 3]


def test_z_scores_agree(spark):
    n = 50
    hits = [("q", p, float(p % 7 + 1)) for p in range(0, n, 3)]
    z, rest = fusion.z_sparse(spark.createDataFrame(hits, "query_id string, page_id bigint, score double"), n)
    values = [dict((p, s) for _, p, s in hits).get(p, 0.0) for p in range(n)]
    mean = sum(values) / n
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    for r in z.collect():
        assert r["z"] == pytest.approx((values[r["page_id"]] - mean) / spread)
    assert rest.first()["z0"] == pytest.approx(-mean / spread)
    flat = spark.createDataFrame([("q", 1, 1, 2.0), ("q", 1, 2, 2.0)], "query_id string, granularity int, page_id bigint, best double")
    assert [r["z_best"] for r in fusion.z_dense(flat, "best").collect()] == [0.0, 0.0]


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([1], [], 0.0), ([1, 2], [2, 3], 1 / 3), (None, None, 1.0)])
def test_jaccard(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(metrics.jaccard(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] == pytest.approx(want)


def test_recall_and_multiplier(spark):
    row = spark.createDataFrame([([1, 2, 3], [3, 9], [])], "r array<bigint>, t array<bigint>, e array<bigint>")
    got = row.select(metrics.recall_at_k(F.col("r"), F.col("t")).alias("x"), metrics.recall_at_k(F.col("r"), F.col("e")).alias("y")).first()
    assert (got["x"], got["y"]) == (0.0, 1.0)
    ratios = spark.createDataFrame([(x,) for x in (0.5, 0.51, 1.0, 2.0, 2.01)], "x double").select(metrics.runtime_multiplier(F.col("x")).alias("m"))
    assert [r["m"] for r in ratios.collect()] == [1.0, 0.9, 0.9, 0.75, 0.5]


def test_ndcg(spark):
    run = spark.createDataFrame([("q", 1, 5), ("q", 2, 5), ("q", 3, 7)], "query_id string, rank bigint, page_id bigint")
    truth = spark.createDataFrame([("q", "a", [7]), ("none", "b", []), ("missed", "c", [1])], "query_id string, query string, relevant array<bigint>")
    assert {r["query_id"]: r["ndcg"] for r in evaluation.ndcg(run, truth).collect()} == {"q": 1.0, "none": 0.0, "missed": 0.0}
    ideals = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 10)], "n int").select(F.round(metrics.ideal(F.col("n")), 6).alias("x"))
    assert [r["x"] for r in ideals.collect()] == [0.0, 1.0, 2.0, 2.63093, 3.13093, 3.561606, 5.254495]
    assert evaluation.evaluate(["a"], [[5, 5, 7]], [[7]], spark) == {"num_queries": 1.0, "mean_ndcg": 1.0}
    with pytest.raises(ValueError):
        evaluation.evaluate(["a"], [], [[7]], spark)
    with pytest.raises(TypeError):
        evaluation.evaluate(["a"], [(5,)], [[7]], spark)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_best_pages_are_those_of_all_scores(spark, monkeypatch, sent):
    import numpy as np

    monkeypatch.setattr(fusion, "SENT", sent)
    monkeypatch.setattr(fusion, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(g, p, c, rng.normal(size=4).round(2).tolist()) for p in range(80) for g in (100, 150) for c in range(rng.integers(0, 4)) if (p + g) % 7]
    passages = spark.createDataFrame([*rows, (100, 900, 1, [1.0] * 4), (100, 901, 0, None), (None, 902, 0, [1.0] * 4)], "granularity int, page_id bigint, chunk_id int, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", rng.normal(size=4).tolist()) for i in range(3)] + [("none", None)], "query_id string, embedding array<double>")
    hit = lambda m: spark.createDataFrame([(f"q{i}", int(p), float(s)) for i in range(2) for p, s in zip(rng.permutation(95)[:m], rng.random(m) * 9, strict=True)], "query_id string, page_id bigint, score double")
    bm25_, numbers = hit(40), hit(3)
    for weights in ((1.0, 0.8, 1.0, 2.5), (1.0, 0.8, 0.1, 0.0)):
        whole = fusion.fuse(fusion.z_dense(fusion.dense(queries, passages), "best", "lead"), bm25_, numbers, 100, weights)
        want = {(r["query_id"], r["rank"], r["page_id"], round(r["score"], 6)) for r in fusion.ranked(whole, 6).collect()}
        got = fusion.best_pages(queries, fusion.nest(passages).repartition(5), bm25_, numbers, 100, weights, 6)
        assert {(r["query_id"], r["rank"], r["page_id"], round(r["score"], 6)) for r in fusion.ranked(got, 6).collect()} == want and len(want) == 18
    assert fusion.unnest(fusion.nest(passages)).count() == len(rows) + 1
    assert fusion.best_pages(queries, fusion.nest(passages.where("false")), bm25_, numbers, 100).count() == 0


def test_index_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"Page {i}", f"Page {i} links town{i} and town{i + 1} in 18{i}0. It was built by guild{i % 3}.") for i in range(12)], PAGES)
    pipeline.build_index(pages, str(tmp_path / "index"))
    found = pipeline.Retriever(spark, str(tmp_path / "index"))
    assert found.run([]) == []
    lists = found.run(["page 4 town4 town5", "What links town7 and town8?"], 5)
    assert len(lists) == 2 and lists[0][0] == 4 and all(len(set(x)) == 5 for x in lists)


def test_corpus_search_writes_no_file_a_page(spark, tmp_path, monkeypatch):
    from gridloom.plans import catalog

    monkeypatch.setattr(catalog, "_fresh", lambda spark: str(tmp_path / "trip"))
    data = "/root/testdata/sf0.001"
    assert catalog.corpus_search(spark, data).count() == 400
    files = list((tmp_path / "trip" / "pages").rglob("*.json"))
    n = tables.latest_pages(tables.table(spark, data, "page")).count()
    assert sum(len(f.read_text().splitlines()) for f in files) >= n > 2 * len(files) > 0
