import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridloom.operators import replay, vector_index
from gridloom.operators.components import connected_components
from gridloom.operators.entity_clusters import similar_links, similar_pairs
from gridloom.operators.vector_index import VectorIndex

VEC = "vec_id bigint, embedding array<float>"


def ids(df):
    return [r["vec_id"] for r in df.orderBy("pos").collect()]


def test_index_contract(spark):
    index = VectorIndex(spark, 2)
    batch = "pos int, vec_id bigint, embedding array<float>"
    assert ids(index.insert(spark.createDataFrame([(0, 1, [1.0, 0.0])], batch))["succeeded"]) == [1]
    out = index.insert(spark.createDataFrame([(0, 2, [0.0, 1.0]), (1, 1, [9.0, 9.0]), (2, 3, [0.5, 0.5])], batch))
    assert (ids(out["succeeded"]), ids(out["failed"])) == ([2, 3], [1])
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "q bigint, embedding array<float>")
    rows = index.search(queries, 2).orderBy("q", "rank").collect()
    assert [(r["q"], r["vec_id"]) for r in rows] == [(0, 1), (0, 3), (1, 1), (1, 3)]
    out = index.delete(spark.createDataFrame([(0, 1), (1, 1), (2, 9)], "pos int, vec_id bigint"))
    assert (ids(out["succeeded"]), ids(out["failed"])) == ([1], [1, 9])
    version = index.version
    index.delete(spark.createDataFrame([(0, 77)], "pos int, vec_id bigint"))
    assert index.version == version
    assert ids(index.insert(spark.createDataFrame([(0, 1, [7.0, 0.0])], batch))["succeeded"]) == [1]
    assert index.search(queries, 1).first()["score"] == 7.0
    assert index.search(queries, 0).count() == 0
    assert index.search(queries, 50).count() == 6
    with pytest.raises(ValueError):
        index.insert(spark.createDataFrame([(0, 5, [1.0])], batch))


def test_empty_and_unusable(spark):
    none = spark.createDataFrame([], VEC)
    q = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "q bigint, embedding array<float>")
    assert vector_index.top_k(q, none, 3).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0])], VEC)
    assert [(r["vec_id"], r["rank"]) for r in vector_index.top_k(q, rows, 3).orderBy("rank").collect()] == [(4, 1), (5, 2)]


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)).round(1)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(500)], VEC).repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 500, 50)], "q bigint, embedding array<float>")
    fast = {(r["q"], r["rank"]): r["vec_id"] for r in vector_index.top_k(q, rows, 7).collect()}
    plain = {(r["q"], r["rank"]): r["vec_id"] for r in vector_index.top_k_sql(q, rows, 7).collect()}
    assert fast == plain and len(fast) == 70


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_replay_against_dict(spark, seed):
    rng = random.Random(seed)
    log, ops, want = [], [], {}
    live: dict[int, int] = {}
    for seq in range(8):
        op, batch = rng.choice(["insert", "delete"]), f"b{seq}"
        ops.append((0, seq, op, batch))
        some = [rng.randrange(12) for _ in range(6)]
        log += [(batch, op, pos, i, [float(seq), 1.0] if op == "insert" else None) for pos, i in enumerate(some)]
        for pos, i in enumerate(dict.fromkeys(some) if op == "insert" else some):
            place = some.index(i) if op == "insert" else pos
            if op == "insert":
                want[seq, place, i] = i not in live
                live.setdefault(i, seq)
            else:
                want[seq, place, i] = live.pop(i, None) is not None
    changelog = spark.createDataFrame(log + log[:3], "batch string, op string, pos int, vec_id bigint, embedding array<float>")
    manifest = spark.createDataFrame(ops + ops[:2], "scenario int, seq int, op string, batch string")
    status = replay.statuses(replay.log(changelog, manifest))
    assert {(r["seq"], r["pos"], r["vec_id"]): r["succeeded"] for r in status.collect()} == want
    assert {r["vec_id"]: r["born"] for r in replay.lives(status).where("died is null").collect()} == live


@pytest.mark.parametrize("local", [1 << 17, 0])
def test_components(spark, monkeypatch, local):
    from gridloom.operators import components

    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(1, 1), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_pairs(spark, monkeypatch):
    from gridloom.operators import entity_clusters

    monkeypatch.setattr(entity_clusters, "BLOCK", 40)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64))
    x = np.concatenate([base, base + 0.3 * rng.normal(size=base.shape), base + rng.normal(size=base.shape)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64)], "page_id bigint, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] > 0.6}
    got = [(r["a"], r["b"]) for r in similar_pairs(rows, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_pairs_of_any_dimension(spark):
    rows = [(i, v) for i, v in enumerate([[1.0] * 384, [1.0] * 384, [2.0] * 383 + [1.9], [-1.0] * 384])] + [(9, [1.0] * 64)]
    got = {(r["a"], r["b"]) for r in similar_pairs(spark.createDataFrame(rows, "page_id bigint, embedding array<float>")).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}
    assert similar_pairs(spark.createDataFrame([], "page_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 20])
def test_similar_links_join_what_pairs_join(spark, monkeypatch, held):
    from gridloom.operators import entity_clusters

    for name, value in (("BLOCK", 40), ("SLICE", 7), ("HELD", held)):
        monkeypatch.setattr(entity_clusters, name, value)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base, base + 0.5 * rng.normal(size=base.shape), base[:20], base[0] + 0.1 * rng.normal(size=(80, 64))])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)] + [(900, None), (901, [0.0] * 64)], "page_id bigint, embedding array<float>")
    for threshold in (0.25, 0.9, 1.0):
        pairs, links = similar_pairs(rows, threshold).select("a", "b"), similar_links(rows, threshold)
        want = {(r["node"], r["component"]) for r in connected_components(pairs).collect()}
        assert {(r["node"], r["component"]) for r in connected_components(links).collect()} == want and bool(want) == (threshold < 1)
    assert similar_links(spark.createDataFrame([], "page_id bigint, embedding array<float>")).count() == 0


def test_similar_links_are_fewer_than_pairs(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(1 + 0.1 * rng.normal(size=(300, 64)))] + [(300 + i, [1.0] * 64) for i in range(100)], "page_id bigint, embedding array<float>")
    assert similar_pairs(rows).count() == 400 * 399 // 2 and similar_links(rows).count() == 399


def test_similar_links_at_the_threshold(spark):
    """Cosines that single precision takes for others: 0.75 alike to 9 decimals isn't over it, a millionth more is."""
    rows = [(k, [0.0] * (2 * k) + [1.0, 0.0] + [0.0] * (10 - 2 * k)) for k in range(3)]
    rows += [(10 + k, [0.0] * (2 * k) + [c, (1 - c * c) ** 0.5] + [0.0] * (10 - 2 * k)) for k, c in enumerate([0.75, 0.750001, 0.749999])]
    got = similar_links(spark.createDataFrame(rows, "page_id bigint, embedding array<double>"), 0.75).collect()
    assert [sorted((r["a"], r["b"])) for r in got] == [[1, 11]]


def scenario_rows():
    rng = np.random.default_rng(3)
    vector = lambda: rng.normal(size=8).astype(np.float32).tolist()
    log = [("a", "insert", i, i, vector()) for i in range(40)] + [("d", "delete", p, i, None) for p, i in enumerate([3, 3, 7, 99])]
    log += [("b", "insert", p, i, vector()) for p, i in enumerate([3, 5, 50])] + [("b", "insert", 9, 60, [1.0])]
    ops = [(0, 0, "insert", "a", 8), (0, 1, "search", None, 8), (0, 2, "delete", "d", 8), (0, 3, "search", None, 8), (0, 4, "insert", "b", 8), (0, 5, "other", None, 8)]
    queries = [(q, vector()) for q in range(4)] + [(9, log[7][4])]
    return log, ops, queries


def test_scores_of_what_was_played(spark):
    from gridloom.operators.vector_index import NaiveIndex, VectorIndex
    from gridloom.plans import scenario

    class Stale(VectorIndex):
        def delete(self, batch):
            before = self.live
            got = super().delete(batch)
            self.live = before
            return got

    log, ops, queries = scenario_rows()
    log = spark.createDataFrame(log, "batch string, op string, pos int, vec_id bigint, embedding array<float>")
    ops = spark.createDataFrame(ops, "scenario int, seq int, op string, batch string, dim int")
    queries = spark.createDataFrame(queries, "q bigint, embedding array<float>")
    for kind, right in ((VectorIndex, True), (NaiveIndex, True), (Stale, False)):
        said, answers, times = scenario.play(log, ops, 0, queries, kind(spark, 8), 10)
        got = scenario.score(log, ops, 0, queries, said, answers, 8)
        assert times["timed_out"] == 0 and times["dynamic"] > 0
        if right:
            assert got == pytest.approx({"insert_score": 1, "delete_score": 1, "search_score": 1, "functional": 1})
        else:
            assert got["insert_score"] < 1 and 0.5 < got["search_score"] < 1 and got["functional"] < 1
    said, answers, times = scenario.play(log, ops, 0, queries, VectorIndex(spark, 8), 10, wall=0.0)
    assert times["timed_out"] == 1 and answers.count() == 0
    assert scenario.score(log, ops, 0, queries, said, answers, 8)["search_score"] == 0
    assert scenario.score(log, ops, 0, queries, said, answers, 8, totals={"insert": 400, "delete": 1, "search": 1})["insert_score"] < 0.2


@pytest.mark.parametrize("sent", [100_000, 1])
def test_search_of_lives(spark, monkeypatch, sent):
    monkeypatch.setattr(replay, "SENT", sent)
    monkeypatch.setattr(replay, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4)).round(3)
    lives = [(i % 2, i, x[i].tolist(), int(i % 5), None if i % 3 else 6) for i in range(60)] + [(0, 100, None, 0, None), (0, 101, [0.0] * 4, 0, None)]
    at = [(s, t) for s in (0, 1, 2) for t in (1, 3, 8)]
    q = rng.normal(size=(5, 4)).round(3)
    got = replay.search_lives(spark.createDataFrame(lives, "scenario int, vec_id bigint, embedding array<double>, born int, died int").repartition(5), spark.createDataFrame(at, "scenario int, seq int"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q bigint, embedding array<double>"), 3).collect()
    want = set()
    for s, t in at:
        for i, v in enumerate(q):
            live = sorted((-round(float(v @ x[j]), 9), j) for j in range(60) if j % 2 == s and j % 5 < t and (j % 3 or t < 6))
            want |= {(s, t, i, r + 1, j) for r, (_, j) in enumerate(live[:3])}
    assert {(r["scenario"], r["seq"], r["q"], r["rank"], r["vec_id"]) for r in got} == want


def test_half(spark):
    from pyspark.sql import functions as F

    from gridloom.functions.vectors import half

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=200), rng.normal(size=50) * 1e-6, [0.0, 1.0, -2.0, 65504.0, 70000.0, 2.0**-24, 0.1]]).astype(np.float32)
    got = spark.createDataFrame([(x.tolist(),)], "x array<float>").select(half(F.col("x")).alias("y")).first()["y"]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float16).astype(float).tolist()
