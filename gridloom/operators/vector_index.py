"""A mutable set of vectors: insert, delete, exact search by greatest inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions.vectors import dot, usable
from gridloom.session import cut, prepare

#: Queries that meet all rows at once: one block of them is sent to every task, at most 4096 x dim x 4 bytes.
QUERY_BLOCK = 4096


def top_k_sql(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The plain form of `top_k`: stated queries meet all rows in blocks of about QUERY_BLOCK; a cross-check in built-in expressions."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    own = F.pmod(F.xxhash64("q"), F.lit(blocks))
    out = None
    for b in range(blocks):
        some = queries.where(own == b).select("q", F.col("embedding").alias("_e"))
        pairs = F.broadcast(some).join(vectors.select("vec_id", "embedding"))
        best = _best(pairs.select("q", "vec_id", dot(F.col("_e"), F.col("embedding")).alias("score")), k)
        out = best if out is None else out.union(best)
    return out


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(q, vec_id, score, rank): for each query (q, embedding) the k rows (vec_id, embedding) of greatest inner product.

    Queries come in blocks; each task multiplies a block with its rows, keeps its own best k, and a window over the
    tasks' best gives the result: a row among the best of all is among the best of its task. No
    normalisation. Ties to 9 decimals go to the smaller vec_id; k <= 0, no queries or no rows give no rows.
    Rows and queries with null, unequal or non-finite vectors are left out.
    """
    spark = prepare(vectors.sparkSession)
    if k <= 0:
        return spark.createDataFrame([], "q bigint, vec_id bigint, score double, rank bigint")
    out = None
    held: list[tuple] = []
    for row in queries.select(F.col("q").cast("bigint"), "embedding").where("embedding is not null").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            part = _block(spark, held, vectors, k)
            out, held = part if out is None else out.union(part), []
    if held or out is None:
        part = _block(spark, held, vectors, k)
        out = part if out is None else out.union(part)
    return _best(out, k)


def _block(spark: SparkSession, rows: list[tuple], vectors: DataFrame, k: int) -> DataFrame:
    ids = np.array([r[0] for r in rows], np.int64)
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_dim.setdefault(len(r[1]), []).append(i)
    dim = max(by_dim, key=lambda d: len(by_dim[d])) if by_dim else 0
    pick = by_dim.get(dim, [])
    q = np.array([rows[i][1] for i in pick], np.float64).reshape(len(pick), dim)
    fine = np.isfinite(q).all(axis=1)
    shared = spark.sparkContext.broadcast((ids[pick][fine] if len(pick) else ids[:0], q[fine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best_s = np.empty((len(names), 0))
        best_i = np.empty((len(names), 0), np.int64)
        for batch in batches:
            n = len(batch)
            if not n or not len(names):
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(n, dim)
            s = np.concatenate([best_s, np.round(q @ x.T, 9)], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(batch.column(0).to_numpy(), (len(names), n))], axis=1)
            if s.shape[1] > k:
                # beyond the k-th best score there may be ties, of which the smallest ids count
                order = np.lexsort((i, -s), axis=1)[:, :k]
                s, i = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
            best_s, best_i = s, i
        if best_s.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["q", "vec_id", "score"])

    fit = usable(F.col("embedding"), dim) | (F.size("embedding") == dim) & F.forall("embedding", lambda v: v == 0)
    return vectors.where(F.col("vec_id").isNotNull() & fit).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "q bigint, vec_id bigint, score double")


def distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct query vectors under the smallest q of each, and (q, rep): repeated queries of a batch are answered once."""
    reps = queries.groupBy("embedding").agg(F.min("q").alias("rep"))
    return reps.select(F.col("rep").alias("q"), "embedding"), queries.join(reps, "embedding").select("q", "rep")


def insert_status(live: DataFrame, batch: DataFrame, *by: str) -> DataFrame:
    """(by.., pos, vec_id, embedding, succeeded): an id succeeds if it isn't live; nothing is overwritten.

    A batch is a map of ids: of an id's rows the last vector counts, at the first position. Null ids are dropped. Rows
    of several batches are told apart by the columns `by`; each batch meets the same live set.
    """
    one = batch.where("vec_id is not null").groupBy(*by, "vec_id").agg(F.min("pos").alias("pos"), F.max_by("embedding", "pos").alias("embedding"))
    known = live.select("vec_id").distinct().withColumn("_live", F.lit(True))
    return one.join(known, "vec_id", "left").select(*by, "pos", "vec_id", "embedding", F.col("_live").isNull().alias("succeeded"))


def delete_status(live: DataFrame, batch: DataFrame) -> DataFrame:
    """(pos, vec_id, succeeded): the first row of a live id succeeds; repeats and unknown ids fail."""
    known = live.select("vec_id").distinct().withColumn("_live", F.lit(True))
    w = Window.partitionBy("vec_id").orderBy("pos")
    rows = batch.where("vec_id is not null").withColumn("_rn", F.row_number().over(w)).join(known, "vec_id", "left")
    return rows.select("pos", "vec_id", (F.col("_live").isNotNull() & (F.col("_rn") == 1)).alias("succeeded"))


class VectorIndex:
    """The same as an object: each call makes a new version of the set and leaves its status rows."""

    #: Versions after which the set is written out, so that plans don't grow without end.
    WRITE_EVERY = 4

    def __init__(self, spark: SparkSession, dim: int) -> None:
        self.spark, self.dim, self.version = prepare(spark), dim, 0
        self.live = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
        self._answers: list[tuple[DataFrame, int, DataFrame]] = []

    def _next(self, live: DataFrame, status: DataFrame) -> dict[str, DataFrame]:
        good, bad = status.where("succeeded"), status.where("not succeeded")
        if not good.isEmpty():
            self.version += 1
            self.live = cut(live) if self.version % self.WRITE_EVERY == 0 else live
            self._answers.clear()
        return {"succeeded": good.select("pos", "vec_id"), "failed": bad.select("pos", "vec_id")}

    def insert(self, batch: DataFrame) -> dict[str, DataFrame]:
        """Rows (pos, vec_id, embedding); vectors of another dimension are refused before anything changes."""
        wrong = batch.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim)
        if not wrong.isEmpty():
            raise ValueError(f"vectors of {self.dim} numbers are needed")
        status = cut(insert_status(self.live, batch))
        return self._next(self.live.unionByName(status.where("succeeded").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))), status)

    def delete(self, batch: DataFrame) -> dict[str, DataFrame]:
        """Rows (pos, vec_id)."""
        status = cut(delete_status(self.live, batch))
        return self._next(self.live.join(status.where("succeeded").select("vec_id"), "vec_id", "left_anti"), status)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(q, vec_id, score, rank). The answer to the same plan is kept until the set changes; plans are compared whole, not by a hash.

        A plan over files names the files, so the files of a kept query must not be rewritten in place.
        """
        for known, size, answer in self._answers:
            if size == k and known.sameSemantics(queries):
                return answer
        distinct, same = distinct_queries(queries)
        found = top_k(distinct, self.live, k)
        self._answers.append((queries, k, cut(same.join(found.withColumnRenamed("q", "rep"), "rep").select("q", "vec_id", "score", "rank"))))
        return self._answers[-1][2]


class NaiveIndex(VectorIndex):
    """The plain form that run times are measured against: every query of every search meets every row in built-in expressions."""

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if k <= 0:
            return self.spark.createDataFrame([], "q bigint, vec_id bigint, score double, rank bigint")
        return cut(top_k_sql(queries, self.live.where(usable(F.col("embedding"), self.dim)), k).select("q", "vec_id", "score", "rank"))
