"""Replay of an ordered log of inserts, deletes and searches as one declarative query.

After an insert of an id it is there, after a delete it isn't, whether the operation succeeded or not. So the operation
before it on the same id says whether one succeeds, and the times at which a vector is live follow from the next
successful delete. No state is carried from row to row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.metrics import functional_score
from gridloom.functions.vectors import usable
from gridloom.operators.entity_clusters import dimension
from gridloom.session import prepare
from gridloom.sources.tables import batch_rows, operations

#: Queries of a block, and searches that are sent to every task at most (12 bytes each).
QUERY_BLOCK, SENT = 4096, 100_000


def log(changelog: DataFrame, manifest: DataFrame) -> DataFrame:
    """(scenario, seq, pos, op, batch, vec_id, embedding) of all mutations, each batch at its place in its scenario."""
    ops = operations(manifest).where("op in ('insert', 'delete') and batch is not null")
    return batch_rows(changelog).join(ops, ["batch", "op"]).select("scenario", "seq", "pos", "op", "batch", "vec_id", "embedding")


def statuses(rows: DataFrame) -> DataFrame:
    """Adds `succeeded` to the log: an insert succeeds where the id wasn't there, a delete where it was."""
    w = Window.partitionBy("scenario", "vec_id").orderBy("seq", "pos")
    before = F.lag("op").over(w)
    good = F.when(F.col("op") == "insert", before.isNull() | (before == "delete")).otherwise(F.coalesce(before == "insert", F.lit(False)))
    return rows.withColumn("succeeded", good)


def lives(status: DataFrame) -> DataFrame:
    """(scenario, vec_id, embedding, born, died): from each successful insert to the next successful delete, or null."""
    w = Window.partitionBy("scenario", "vec_id").orderBy("seq", "pos")
    good = status.where("succeeded").withColumn("died", F.lead("seq").over(w))
    return good.where("op = 'insert'").select("scenario", "vec_id", "embedding", F.col("seq").alias("born"), "died")


def results(status: DataFrame) -> DataFrame:
    """(scenario, seq, op, succeeded, failed): the ordered id lists of every mutation, as a caller of an index gets them.

    A batch is one row; scores are taken from the rows of `statuses` instead (`mutation_scores`).
    """
    def ids(flag):
        held = F.array_sort(F.collect_list(F.when(flag, F.struct("pos", "vec_id"))))
        return F.transform(held, lambda x: x["vec_id"])

    return status.groupBy("scenario", "seq", "op").agg(ids(F.col("succeeded")).alias("succeeded"), ids(~F.col("succeeded")).alias("failed"))


def searches(manifest: DataFrame) -> DataFrame:
    return operations(manifest).where("op not in ('insert', 'delete')").select("scenario", "seq").distinct()


def search(status: DataFrame, at: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None) -> DataFrame:
    """(scenario, seq, q, vec_id, score, rank): the k best of the rows that are live at each search, for each query."""
    return search_lives(lives(status), at, queries, k, dim)


def search_lives(live: DataFrame, at: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None) -> DataFrame:
    """The same over rows (scenario, vec_id, embedding, born, died).

    Queries (q, embedding) come in blocks of QUERY_BLOCK. A vector isn't copied for the searches of its life: the
    searches `at` (scenario, seq), up to SENT, are sent to every task, which scores a vector once a block and keeps its own
    k best for each search and query. More searches are joined and shuffled with the vectors. Queries and
    vectors of another length than `dim` (by default that of most queries) or that aren't usable are left out.
    """
    spark = prepare(live.sparkSession)
    dim = dimension(queries) if dim is None else dim
    found = live.where(usable(F.col("embedding"), dim))
    times = at.select("scenario", "seq").distinct()
    held = times.limit(SENT + 1).collect()
    if len(held) > SENT:
        held = None
        joined = found.join(times, "scenario").where((F.col("born") < F.col("seq")) & (F.col("died").isNull() | (F.col("died") > F.col("seq"))))
        found = joined.select("scenario", "vec_id", "embedding", (F.col("seq") - 1).alias("born"), (F.col("seq") + 1).alias("died"), "seq").repartition("scenario", "seq", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    else:
        found = found.withColumn("seq", F.lit(None).cast("int"))
    placed = found.select("scenario", F.col("vec_id").cast("bigint").alias("vec_id"), F.col("born").cast("bigint").alias("born"), F.coalesce("died", F.lit(2**62)).cast("bigint").alias("died"), F.col("seq").cast("bigint").alias("seq"), "embedding").sortWithinPartitions("scenario", "seq")
    whens: dict[int, list[int]] = {}
    for r in held or []:
        whens.setdefault(r[0], []).append(r[1])
    sent = spark.sparkContext.broadcast({s: np.sort(np.array(v, np.int64)) for s, v in whens.items()} if held is not None else None)  # at most SENT pairs of numbers
    out = None
    for names, q in _query_blocks(queries, dim):
        part = _search_block(placed, spark.sparkContext.broadcast((names, q)), sent, k, dim)
        out = part if out is None else out.union(part)
    if out is None or k <= 0:
        return spark.createDataFrame([], "scenario int, seq int, q bigint, vec_id bigint, score double, rank bigint")
    w = Window.partitionBy("scenario", "seq", "q").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """At most QUERY_BLOCK usable queries at a time, as ids and vectors."""
    held: list = []
    for row in queries.where(usable(F.col("embedding"), dim)).select(F.col("q").cast("bigint"), "embedding").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)
            held = []
    if held:
        yield np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)


def _search_block(placed: DataFrame, block, sent, k: int, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, q), times = block.value, sent.value
        at, best = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (scenario, seq), (s, i) in best.items():
                rows, cols = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), scenario, np.int32)), pa.array(np.full(len(rows), seq, np.int32)), pa.array(names[rows]), pa.array(i[rows, cols]), pa.array(s[rows, cols])],
                    names=["scenario", "seq", "q", "vec_id", "score"],
                )

        for batch in batches:
            if not len(batch):
                continue
            scenario, ids, born, died = (batch.column(c).to_numpy() for c in range(4))
            seqs = batch.column(4).to_numpy(zero_copy_only=False)
            x = batch.column(5).flatten().to_numpy().astype(np.float64).reshape(len(batch), dim)
            fresh = scenario[1:] != scenario[:-1]
            if times is None:
                fresh = fresh | (seqs[1:] != seqs[:-1])
            edges = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(batch)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                key = (int(scenario[s]), None if times is not None else int(seqs[s]))
                if key != at:
                    yield from flush()
                    at, best = key, {}
                score = np.round(q @ x[s:e].T, 9)
                for seq in times.get(key[0], ()) if times is not None else (key[1],):
                    own = np.flatnonzero((born[s:e] < seq) & (died[s:e] > seq))
                    if not len(own):
                        continue
                    some, who = score[:, own], np.broadcast_to(ids[s:e][own], (len(names), len(own)))
                    if (key[0], seq) in best:
                        some, who = np.concatenate([best[key[0], seq][0], some], axis=1), np.concatenate([best[key[0], seq][1], who], axis=1)
                    if some.shape[1] > k:
                        order = np.lexsort((who, -some), axis=1)[:, :k]
                        some, who = np.take_along_axis(some, order, axis=1), np.take_along_axis(who, order, axis=1)
                    best[key[0], seq] = some, who
        yield from flush()

    return placed.mapInArrow(run, "scenario int, seq int, q bigint, vec_id bigint, score double")


def recalls(got: DataFrame, truth: DataFrame, at: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(scenario, seq, recall, n_queries) of every search: the mean over its queries of the share of the truth's k best that came back.

    `got` and `truth` are (scenario, seq, q, vec_id, rank). A query whose truth is empty has a recall of 1.
    """
    keys = ["scenario", "seq", "q"]
    real = truth.where(F.col("rank") <= k)
    size = real.groupBy(*keys).agg(F.count("*").alias("_n"))
    hits = real.select(*keys, "vec_id").join(got.join(size, keys).where(F.col("rank") <= F.col("_n")).select(*keys, "vec_id").distinct(), [*keys, "vec_id"]).groupBy(*keys).agg(F.count("*").alias("_h"))
    per = size.join(hits, keys, "left").select(*keys, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("_r"))
    sums = per.groupBy("scenario", "seq").agg(F.sum("_r").alias("_s"), F.count("*").alias("_m"))
    n = queries.count()
    mean = (F.coalesce("_s", F.lit(0.0)) + F.lit(n) - F.coalesce("_m", F.lit(0))) / F.lit(max(n, 1))
    return at.select("scenario", "seq").distinct().join(sums, ["scenario", "seq"], "left").select("scenario", "seq", (F.when(F.lit(n) > 0, mean).otherwise(1.0)).alias("recall"), F.lit(n).cast("bigint").alias("n_queries"))


def mutation_scores(got: DataFrame, truth: DataFrame) -> DataFrame:
    """(scenario, seq, op, score, items): half the Jaccard of the succeeded ids and half that of the failed ones.

    Both are rows (scenario, seq, op, vec_id, succeeded), as `statuses` gives them; a batch is never gathered in one row.
    A mutation of the truth that has no rows in `got` scores 0, unless it is empty itself.
    """
    keys = ["scenario", "seq", "op"]
    rows = truth.select(*keys, "vec_id", F.col("succeeded").alias("t"), F.lit(None).cast("boolean").alias("g")).union(got.select(*keys, "vec_id", F.lit(None).cast("boolean"), "succeeded"))
    has = lambda c, v: F.coalesce(F.max(F.when(F.col(c) == v, 1)), F.lit(0))
    ids = rows.groupBy(*keys, "vec_id").agg(has("t", True).alias("ts"), has("t", False).alias("tf"), has("g", True).alias("gs"), has("g", False).alias("gf"), F.count("t").alias("items"))

    def alike(a: str, b: str):
        whole = F.sum(F.greatest(a, b))
        return F.when(whole == 0, F.lit(1.0)).otherwise(F.sum(F.least(a, b)) / whole)

    out = ids.groupBy(*keys).agg((0.5 * (alike("ts", "gs") + alike("tf", "gf"))).alias("score"), F.sum("items").alias("items"))
    return out.where("items > 0")


def scenario_scores(mutations: DataFrame, recalls: DataFrame, totals: dict[str, int] | None = None) -> DataFrame:
    """(scenario, insert_score, delete_score, search_score, functional): sums weighted by items; totals are 1 at least.

    `recalls` is (scenario, seq, recall, n_queries). `totals` are those that a manifest states (insert, delete, search);
    without them, what the rows add up to.
    """
    totals = totals or {}

    def part(op: str):
        own = F.col("op") == op
        whole = F.lit(totals[op]) if op in totals else F.coalesce(F.sum(F.when(own, F.col("items"))), F.lit(0))
        return F.coalesce(F.sum(F.when(own, F.col("score") * F.col("items"))), F.lit(0.0)) / F.greatest(whole, F.lit(1))

    made = mutations.groupBy("scenario").agg(part("insert").alias("insert_score"), part("delete").alias("delete_score"))
    found = recalls.groupBy("scenario").agg((F.sum(F.col("recall") * F.col("n_queries")) / F.greatest(F.lit(totals["search"]) if "search" in totals else F.sum("n_queries"), F.lit(1))).alias("search_score"))
    out = made.join(found, "scenario", "left").withColumn("search_score", F.coalesce("search_score", F.lit(0.0)))
    return out.withColumn("functional", functional_score(F.col("search_score"), F.col("insert_score"), F.col("delete_score")))
