import json

import pytest

from gridloom.sources import tables
from gridloom.streaming import changelog


def test_pages_json(spark, tmp_path):
    (tmp_path / "10.json").write_text(json.dumps({"page_id": 10, "title": "Ten", "content": "x\ny"}))
    (tmp_path / "9.json").write_text(json.dumps({"title": None}, indent=1))
    rows = tables.pages_json(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["page_id"], r["title"], r["content"]) for r in rows] == [(10, "Ten", "x\ny"), (9, "", "")]
    with pytest.raises(Exception):
        tables.pages_json(spark, str(tmp_path / "missing")).count()


def test_pages_json_lines(spark, tmp_path):
    pages = [{"page_id": " 10", "title": "Ten", "content": "x\ny\r\u2028z"}, {"page_id": 9, "title": None}]
    (tmp_path / "a.json").write_text("".join(json.dumps(p) + "\n" for p in pages))
    rows = tables.pages_json(spark, str(tmp_path), lines=True).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["content"]) for r in rows] == [(9, "", ""), (10, "Ten", "x\ny\r\u2028z")]
    (tmp_path / "11.json").write_text('{"title": "no id"}\n')
    with pytest.raises(Exception, match="not a page id"):
        tables.pages_json(spark, str(tmp_path), lines=True).collect()


def test_queries_and_manifest_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "a", "query": "x", "relevant_page_ids": ["3", "3", " 4"]}]))
    assert tables.queries_json(spark, str(tmp_path / "q.json")).first()["relevant"] == [3, 3, 4]
    assert tables.queries_json(spark, str(tmp_path / "q.json"), as_set=True).first()["relevant"] == [3, 4]
    (tmp_path / "m.json").write_text(json.dumps({"dim": 2, "operations": [{"type": "insert", "batch": "b"}, {"type": "delete", "ids": "d"}, {"type": "search", "queries": "q"}]}))
    rows = tables.manifest_json(spark, str(tmp_path / "m.json")).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["batch"]) for r in rows] == [(0, "insert", "b"), (1, "delete", "d"), (2, "search", None)]


def test_totals_and_truths(spark, tmp_path):
    import numpy as np

    (tmp_path / "m.json").write_text(json.dumps({"dim": 2, "config": {"total_insert": 7, "total_delete": 0}, "operations": []}))
    assert tables.manifest_totals(spark, str(tmp_path / "m.json")) == {"insert": 7, "delete": 1, "search": 1}
    (tmp_path / "gt.json").write_text(json.dumps({"succeeded": [3, 1]}))
    assert [(r["succeeded"], r["failed"]) for r in tables.truth_json(spark, str(tmp_path / "gt.json")).collect()] == [([3, 1], [])]
    np.save(tmp_path / "ids.npy", np.array([5, 6], np.int64))
    np.save(tmp_path / "gt.npy", np.array([[1, 2], [3, 4]], np.int64))
    assert [r["values"] for r in tables.arrays_npy(spark, str(tmp_path / "ids.npy")).orderBy("row").collect()] == [[5.0], [6.0]]
    assert [r["values"] for r in tables.arrays_npy(spark, str(tmp_path / "gt.npy")).orderBy("row").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        tables.arrays_npy(spark, str(tmp_path / "objects.npy")).count()


def test_matrix_and_timings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SHARD_BYTES", 80)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "vec_id bigint, embedding array<float>").coalesce(1)
    tables.write_matrix(rows, str(tmp_path / "m"), 2)
    assert len(list((tmp_path / "m").glob("*.parquet"))) == 5
    assert tables.read_matrix(spark, str(tmp_path / "m")).count() == 50
    path = str(tmp_path / "t" / "x.json")
    assert tables.read_timings(path, 3) is None
    tables.write_timings(path, {"baseline_dynamic": 1.5}, 3)
    assert tables.read_timings(path, 3)["baseline_dynamic"] == 1.5
    assert tables.read_timings(path, 2) is None


def test_stream_of_changes(spark, tmp_path):
    import datetime as dt

    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    schema = "batch string, pos int, op string, vec_id bigint, embedding array<float>, logged_at timestamp"
    first = [("a", 0, "insert", 1, [1.0], t(0)), ("a", 1, "insert", 2, [2.0], t(1)), ("a", 2, "insert", 1, [9.0], t(2)), ("a", 3, "delete", 2, None, t(3))]
    second = [("b", 0, "insert", 1, [5.0], t(10)), ("b", 1, "insert", 2, [6.0], t(11)), ("b", 2, "delete", 1, None, t(12)), ("b", 3, "insert", 1, [7.0], t(13)), ("b", 4, "delete", 8, None, t(14))]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        # a new object each time, as after a restart
        changelog.follow(stream, changelog.LiveTable(spark, str(tmp_path / "live")), str(tmp_path / "check")).awaitTermination()
        got = {r["vec_id"]: r["embedding"] for r in changelog.LiveTable(spark, str(tmp_path / "live")).read().collect()}
        assert got == ({1: [1.0]} if i == 0 else {1: [7.0], 2: [6.0]})


def test_live_table_over_many_batches(spark, tmp_path):
    import datetime as dt
    import random

    rng, live, want = random.Random(3), changelog.LiveTable(spark, str(tmp_path / "live")), {}
    schema = "op string, vec_id bigint, embedding array<float>, logged_at timestamp, pos int"
    for number in range(12):
        rows = []
        for pos in range(6):
            i, op = rng.randrange(6), rng.choice(["insert", "insert", "delete"])
            rows.append((op, i, [float(number * 10 + pos)] if op == "insert" else None, dt.datetime(2024, 1, 1, number), pos))
            if op == "delete":
                want.pop(i, None)
            else:
                want.setdefault(i, rows[-1][2])
        changelog.LiveTable(spark, live.path).apply(spark.createDataFrame(rows, schema), number)
        live.apply(spark.createDataFrame([("insert", 99, [1.0], dt.datetime(2025, 1, 1), 0)], schema), number)  # the batch again
    live.apply(spark.createDataFrame([("insert", 99, [1.0], dt.datetime(2025, 1, 1), 0)], schema), 0, "other")
    assert {r["vec_id"]: r["embedding"] for r in live.read().collect()} == want | {99: [1.0]}
    assert len(list((tmp_path / "live").iterdir())) <= 2 * live.COMPACT + 3
