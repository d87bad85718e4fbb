"""Playing a scenario on an index, operation by operation, and scoring what the index gave back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from gridloom.operators import replay
from gridloom.operators.vector_index import VectorIndex
from gridloom.session import cut
from gridloom.sources import tables

STATUS = "scenario int, seq int, op string, vec_id bigint, succeeded boolean"
ANSWERS = "scenario int, seq int, q bigint, rank bigint, vec_id bigint"


def play(changelog: DataFrame, manifest: DataFrame, scenario: int, queries: DataFrame, index: VectorIndex, k: int = 10, wall: float | None = None) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """What the index says of every mutation (STATUS) and search (ANSWERS), and the times.

    The first insert is the initial build; all else is dynamic time. Operations that aren't inserts or deletes are
    searches by all `queries`. Past `wall` seconds the rest isn't played.
    """
    spark = index.spark
    rows = cut(tables.batch_rows(changelog))
    # the operations of one scenario: their number is that of calls, each a job of its own
    ops = tables.operations(manifest).where(F.col("scenario") == scenario).orderBy("seq").collect()
    said, answers = spark.createDataFrame([], STATUS), spark.createDataFrame([], ANSWERS)
    initial, dynamic, late, began = None, 0.0, False, time.perf_counter()
    for op in ops:
        batch = rows.where((F.col("batch") == op["batch"]) & (F.col("op") == op["op"]))
        start = time.perf_counter()
        if op["op"] == "insert":
            got = index.insert(batch.where(F.size("embedding") == index.dim).select("pos", "vec_id", "embedding"))
        elif op["op"] == "delete":
            got = index.delete(batch.select("pos", "vec_id"))
        else:
            got = index.search(queries, k)
        took = time.perf_counter() - start
        head = (F.lit(scenario).alias("scenario"), F.lit(op["seq"]).alias("seq"))
        if op["op"] in ("insert", "delete"):
            for name, good in (("succeeded", True), ("failed", False)):
                said = said.union(got[name].select(*head, F.lit(op["op"]).alias("op"), "vec_id", F.lit(good).alias("succeeded")))
        else:
            answers = answers.union(got.select(*head, "q", "rank", "vec_id"))
        if initial is None and op["op"] == "insert":
            initial = took
        else:
            dynamic += took
        late = wall is not None and time.perf_counter() - began > wall
        if late:
            break
    whole = time.perf_counter() - began
    return cut(said), cut(answers), {"initial": initial or 0.0, "dynamic": dynamic, "wall": whole, "timed_out": float(late)}


def truth(changelog: DataFrame, manifest: DataFrame, scenario: int, queries: DataFrame, dim: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The same from the declarative replay. Insert rows whose vector has another length aren't played, so they don't count here."""
    rows = replay.log(changelog, manifest).where(F.col("scenario") == scenario)
    status = cut(replay.statuses(rows.where((F.col("op") == "delete") | (F.size("embedding") == dim))))
    at = replay.searches(manifest).where(F.col("scenario") == scenario)
    return status, replay.search(status, at, queries, k, dim)


def score(changelog: DataFrame, manifest: DataFrame, scenario: int, queries: DataFrame, said: DataFrame, answers: DataFrame, dim: int, k: int = 10, totals: dict[str, int] | None = None) -> dict[str, float]:
    """Insert, delete, search and functional score of what an index said, against the replay."""
    status, found = truth(changelog, manifest, scenario, queries, dim, k)
    at = replay.searches(manifest).where(F.col("scenario") == scenario)
    mutations = replay.mutation_scores(said, status)
    row = replay.scenario_scores(mutations, replay.recalls(answers, cut(found), at, queries, k), totals).first()
    return {c: float(row[c]) for c in ("insert_score", "delete_score", "search_score", "functional")} if row else {"insert_score": 0.0, "delete_score": 0.0, "search_score": 0.0, "functional": 0.0}
