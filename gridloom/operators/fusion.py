"""Dense scores per page, z-scores, weighted fusion, top-k and re-ranking by cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators.entity_clusters import dimension
from gridloom.session import cut, prepare

DENSE, LEAD, LEXICAL, NUMBER = 1.0, 0.8, 1.0, 2.5
CANDIDATES, TOP = 200, 10
#: Queries that are sent to every task at once.
QUERY_BLOCK = 4096
#: Pairs of a query and a page that are sent to every task at most (12 bytes each); beyond, pages are joined by shuffle.
SENT = 500_000
#: Least deviation that a z-score is divided by.
LEAST_SPREAD = 1e-9


def dense(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, granularity, page_id, best, lead): greatest product over a page's passages, and that of its first one.

    Stated queries (query_id, embedding) come in blocks that are sent to all tasks; a task multiplies a block with a
    batch of passages and reduces each page's run of rows, so partial maxima are what is shuffled, not products.
    Passages and queries without a vector are left out.
    """
    prepare(passages.sparkSession)
    out, held = None, []
    for row in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            part = _partial(held, passages)
            out, held = part if out is None else out.union(part), []
    if held or out is None:
        part = _partial(held, passages)
        out = part if out is None else out.union(part)
    return out.groupBy("query_id", "granularity", "page_id").agg(F.max("best").alias("best"), F.max("lead").alias("lead"))


def _partial(rows: list, passages: DataFrame) -> DataFrame:
    names = [r[0] for r in rows]
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    shared = passages.sparkSession.sparkContext.broadcast((names, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches:
            n = len(batch)
            if not n or not names:
                continue
            g, page, chunk = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = batch.column(3).flatten().to_numpy().astype(np.float64).reshape(n, -1)
            order = np.lexsort((chunk, page, g))
            g, page, chunk = g[order], page[order], chunk[order]
            scores = q @ x[order].T
            starts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (page[1:] != page[:-1])) + 1])
            best = np.maximum.reduceat(scores, starts, axis=1)
            lead = np.where(chunk[starts] == 0, scores[:, starts], np.nan)
            m = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), m))), pa.array(np.tile(g[starts], len(names)), pa.int32()), pa.array(np.tile(page[starts], len(names)), pa.int64()), pa.array(best.ravel()), pa.array(lead.ravel(), from_pandas=True)],
                names=["query_id", "granularity", "page_id", "best", "lead"],
            )

    fit = F.col("granularity").isNotNull() & F.col("page_id").isNotNull() & F.col("embedding").isNotNull()
    some = passages.where(fit).select("granularity", "page_id", F.coalesce("chunk_id", F.lit(-1)).cast("int").alias("chunk_id"), "embedding")
    return some.mapInArrow(run, "query_id string, granularity int, page_id bigint, best double, lead double")


def z_dense(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds z_<column> over all pages of a query and granularity: population deviation, with a floor.

    Moments are aggregated and joined back: two shuffles of partial sums, where a window would sort every page of a query in one task.
    """
    keys = ["query_id", "granularity"]
    moments = rows.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(moments, keys)
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(LEAST_SPREAD)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def z_sparse(scores: DataFrame, n_pages: int) -> tuple[DataFrame, DataFrame]:
    """z-scores over all pages from the rows of matching pages alone: (query_id, page_id, z), and (query_id, z0) for all other pages."""
    sums = scores.groupBy("query_id").agg(F.sum("score").alias("_s"), F.sum(F.col("score") * F.col("score")).alias("_ss"))
    mean = F.col("_s") / n_pages
    spread = F.greatest(F.sqrt(F.greatest(F.col("_ss") / n_pages - mean * mean, F.lit(0.0))), F.lit(LEAST_SPREAD))
    moments = sums.select("query_id", mean.alias("_mean"), spread.alias("_spread"))
    z = scores.join(moments, "query_id").select("query_id", "page_id", ((F.col("score") - F.col("_mean")) / F.col("_spread")).alias("z"))
    return z, moments.select("query_id", (-F.col("_mean") / F.col("_spread")).alias("z0"))


def fuse(z: DataFrame, bm25: DataFrame, numbers: DataFrame, n_pages: int, weights: tuple[float, float, float, float] = (DENSE, LEAD, LEXICAL, NUMBER)) -> DataFrame:
    """(query_id, page_id, score): weighted sum over granularities and signals.

    A query without lexical or number matches gets 0 for that signal; a weight of 0 or less turns the two off.
    """
    w_dense, w_lead, w_bm25, w_number = weights
    part = w_dense * F.col("z_best") + w_lead * F.coalesce("z_lead", F.lit(0.0))
    out = z.groupBy("query_id", "page_id").agg(F.sum(part).alias("score"))
    for rows, weight in ((bm25, w_bm25), (numbers, w_number)):
        if weight <= 0:
            continue
        own, rest = z_sparse(rows, n_pages)
        out = out.join(own, ["query_id", "page_id"], "left").join(rest, "query_id", "left")
        out = out.select("query_id", "page_id", (F.col("score") + weight * F.coalesce("z", "z0", F.lit(0.0))).alias("score"))
    return out


def nest(passages: DataFrame) -> DataFrame:
    """(page_id, g, c, x): a row a page with its passages' granularities, places and vectors, one after another.

    So a page is never in two tasks, and searches scan pages without a shuffle. Vectors of another length than most are left out.
    """
    dim = dimension(passages)
    fit = F.col("granularity").isNotNull() & F.col("page_id").isNotNull() & (F.size("embedding") == dim)
    one = F.struct("granularity", F.coalesce("chunk_id", F.lit(-1)).cast("int").alias("chunk_id"), "embedding")
    rows = passages.where(fit).groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("_p"))
    return rows.select("page_id", F.transform("_p", lambda p: p["granularity"]).alias("g"), F.transform("_p", lambda p: p["chunk_id"]).alias("c"), F.flatten(F.transform("_p", lambda p: p["embedding"])).alias("x"))


def unnest(pages: DataFrame) -> DataFrame:
    """(granularity, page_id, chunk_id, embedding) of nested pages."""
    dim = (F.size("x") / F.size("g")).cast("int")
    rows = pages.select("page_id", "c", "x", dim.alias("_d"), F.posexplode("g").alias("_i", "granularity"))
    return rows.select("granularity", "page_id", F.element_at("c", F.col("_i") + 1).alias("chunk_id"), F.slice("x", F.col("_i") * F.col("_d") + 1, F.col("_d")).alias("embedding"))


def _scored(batch: pa.RecordBatch, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of passages of one page and granularity: the page's row, the granularity, and for each query the best and the lead product."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    g, c = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    row = np.repeat(np.arange(len(batch)), sizes)
    starts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (row[1:] != row[:-1])) + 1])
    products = q @ batch.column(3).flatten().to_numpy().astype(np.float64).reshape(len(g), -1).T
    # passages are in order of their places, so a lead is the first of its run
    return row[starts], g[starts], np.maximum.reduceat(products, starts, axis=1), np.where(c[starts] == 0, products[:, starts], np.nan)


_MOMENTS = "q int, granularity int, " + ", ".join(f"{n}_{c} double" for c in ("best", "lead") for n in ("n", "s", "ss", "lo", "hi"))


def moments(pages: DataFrame, shared) -> DataFrame:
    """(q, granularity, number, sum, sum of squares, least and greatest of best and lead): a row a task, query and granularity, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not sum(batch.column(1).flatten().to_numpy().shape) or not len(q):
                continue
            _, g, best, lead = _scored(batch, q)
            for one in np.unique(g).tolist():
                at = g == one
                parts = []
                for x in (best[:, at], lead[:, at]):
                    there = ~np.isnan(x)
                    zero = np.where(there, x, 0.0)
                    parts += [there.sum(axis=1).astype(float), zero.sum(axis=1), (zero * zero).sum(axis=1), np.where(there, x, np.inf).min(axis=1), np.where(there, x, -np.inf).max(axis=1)]
                new = np.stack(parts)
                if one in held:
                    old = held[one]
                    new = np.concatenate([*(f(old[5 * k + i : 5 * k + i + 1], new[5 * k + i : 5 * k + i + 1]) for k in range(2) for i, f in enumerate((np.add, np.add, np.add, np.minimum, np.maximum)))])
                held[one] = new
        for one, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(np.full(x.shape[1], one, np.int32)), *(pa.array(v) for v in x)], names=[c.split()[0] for c in _MOMENTS.split(", ")])

    rows = pages.select("page_id", "g", "c", "x").mapInArrow(run, _MOMENTS)
    folds = {"n": F.sum, "s": F.sum, "ss": F.sum, "lo": F.min, "hi": F.max}
    return rows.groupBy("q", "granularity").agg(*(f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("best", "lead") for n, f in folds.items()))


def best_pages(queries: DataFrame, pages: DataFrame, bm25: DataFrame, numbers: DataFrame, n_pages: int, weights: tuple[float, float, float, float] = (DENSE, LEAD, LEXICAL, NUMBER), k: int = CANDIDATES) -> DataFrame:
    """(query_id, page_id, score): for each query (query_id, embedding) at least its k best of the nested pages, with the scores of `fuse`.

    Two passes over the pages, neither of which leaves a row for every query and page. The first sums moments. Between the two, the
    pages with lexical or number matches are reduced to those that can be among the k best, given the range of the dense part. In the
    second, a task keeps its k best pages by the dense part, for a page without a match is no better than that, and the pages
    reduced to; their scores are completed by joins of what is left.
    """
    spark = prepare(pages.sparkSession)
    w_dense, w_lead, w_bm25, w_number = weights
    parts = [(rows, w) for rows, w in ((bm25, w_bm25), (numbers, w_number)) if w > 0]
    # what a match adds to the score of a page without any, and that page's score
    added, base = None, None
    for rows, weight in parts:
        z, rest = z_sparse(rows, n_pages)
        own = z.join(rest, "query_id").select("query_id", "page_id", (weight * (F.col("z") - F.col("z0"))).alias("_a"))
        added = own if added is None else added.union(own)
        some = rest.select("query_id", (weight * F.col("z0")).alias("_b"))
        base = some if base is None else base.union(some)
    none = spark.createDataFrame([], "query_id string, page_id bigint, _a double")
    added = cut((none if added is None else added).groupBy("query_id", "page_id").agg(F.sum("_a").alias("_a")))
    base = cut((none.select("query_id", F.col("_a").alias("_b")) if base is None else base).groupBy("query_id").agg(F.sum("_b").alias("_b")))
    out = None
    for names, q in _query_blocks(queries):
        shared = spark.sparkContext.broadcast(q)
        found = moments(pages, shared).collect()  # a row a query of the block and granularity
        known = sorted({r["granularity"] for r in found})
        table = np.zeros((len(known), 4, len(names)))  # mean and deviation of best and lead
        table[:, 1::2] = 1.0
        low, high = np.zeros(len(names)), np.zeros(len(names))
        for r in found:
            lows, highs = 0.0, 0.0
            for i, (c, w) in enumerate((("best", w_dense), ("lead", w_lead))):
                n = r[f"n_{c}"]
                if n:
                    mean = r[f"s_{c}"] / n
                    spread = max(np.sqrt(max(r[f"ss_{c}"] / n - mean * mean, 0.0)), LEAST_SPREAD)
                    table[known.index(r["granularity"]), 2 * i : 2 * i + 2, r["q"]] = mean, spread
                    ends = sorted(w * (r[f"{e}_{c}"] - mean) / spread for e in ("lo", "hi"))
                    lows, highs = lows + min(0.0, ends[0]), highs + max(0.0, ends[1])
            low[r["q"]] += lows
            high[r["q"]] += highs
        ranges = spark.createDataFrame([(n, i, float(h - l) + 1e-6) for i, (n, l, h) in enumerate(zip(names, low, high, strict=True))], "query_id string, q int, _r double")
        w = Window.partitionBy("query_id").orderBy(F.col("_a").desc())
        kth = added.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == k).select("query_id", F.col("_a").alias("_k"))
        may = added.join(F.broadcast(ranges), "query_id").join(F.broadcast(kth), "query_id", "left").where(F.col("_k").isNull() | (F.col("_a") >= F.col("_k") - F.col("_r")))
        wanted = cut(may.groupBy("page_id").agg(F.sort_array(F.collect_list("q")).alias("wanted")))  # at most a block of queries a page
        few = F.broadcast(wanted) if wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= SENT else wanted
        rows = pages.select("page_id", "g", "c", "x").join(few, "page_id", "left")
        part = _kept(rows, shared, spark.sparkContext.broadcast((known, table)), (w_dense, w_lead), k)
        part = part.join(F.broadcast(ranges.select("q", "query_id")), "q").select("query_id", "page_id", "dense")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id string, page_id bigint, score double")
    out = out.join(added, ["query_id", "page_id"], "left").join(base, "query_id", "left")
    return out.select("query_id", "page_id", (F.col("dense") + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score"))


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """At most QUERY_BLOCK stated queries at a time."""
    held: list = []
    for row in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield [r[0] for r in held], np.array([r[1] for r in held], np.float64)
            held = []
    if held:
        yield [r[0] for r in held], np.array([r[1] for r in held], np.float64)


def _kept(rows: DataFrame, shared, moments_, weights: tuple[float, float], k: int) -> DataFrame:
    """(q, page_id, dense): a task's k best pages by the dense part for each query, and all that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (known, table) = shared.value, moments_.value
        best = np.empty((len(q), 0))
        who = np.empty((len(q), 0), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not sum(batch.column(1).flatten().to_numpy().shape) or not len(q):
                continue
            row, g, top, lead = _scored(batch, q)
            ids, scores = batch.column(0).to_numpy(), np.zeros((len(q), len(batch)))
            for i, one in enumerate(known):
                at = g == one
                mean_b, dev_b, mean_l, dev_l = (x[:, None] for x in table[i])
                z = weights[0] * (top[:, at] - mean_b) / dev_b + weights[1] * np.nan_to_num((lead[:, at] - mean_l) / dev_l)
                scores[:, row[at]] += z  # a page has one run of a granularity
            asked = batch.column(4)
            counts = np.diff(asked.offsets.to_numpy())
            if asked.null_count:
                counts = np.where(asked.is_null().to_numpy(zero_copy_only=False), 0, counts)
            if counts.sum():
                page, who_asks = np.repeat(np.arange(len(batch)), counts), asked.flatten().to_numpy()
                taken.append((who_asks, ids[page], scores[who_asks, page]))
            best, who = np.concatenate([best, scores], axis=1), np.concatenate([who, np.broadcast_to(ids, scores.shape)], axis=1)
            if best.shape[1] > k:
                # scores are compared to 9 decimals later, and equal ones by page; some more stay for those that differ in the tenth
                order = np.lexsort((who, -np.round(best, 9)), axis=1)[:, : k + 16]
                best, who = np.take_along_axis(best, order, axis=1), np.take_along_axis(who, order, axis=1)
        if best.shape[1]:
            taken.append((np.repeat(np.arange(len(q)), best.shape[1]), who.ravel(), best.ravel()))
        for a, b, c in taken:
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b), pa.array(c)], names=["q", "page_id", "dense"])

    return rows.select("page_id", "g", "c", "x", "wanted").mapInArrow(run, "q int, page_id bigint, dense double").dropDuplicates(["q", "page_id"])


def ranked(scores: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, page_id, score, rank) of the k best; ties to 9 decimals go to the smaller page."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "page_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def rerank(scores: DataFrame, clusters: DataFrame, k: int = TOP, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, page_id, rank): the best candidates by cluster; a cluster counts by its two best members, the order within stays.

    `clusters` is (page_id, cluster_id); a page without one is a cluster of its own.
    """
    top = ranked(scores, candidates).join(clusters, "page_id", "left").withColumn("_c", F.coalesce("cluster_id", "page_id"))
    own = Window.partitionBy("query_id", "_c")
    top = top.withColumn("_m", F.row_number().over(own.orderBy("rank")))
    top = top.withColumn("_cs", F.round(F.sum(F.when(F.col("_m") <= 2, F.col("score"))).over(own), 9)).withColumn("_first", F.min("rank").over(own))
    order = Window.partitionBy("query_id").orderBy(F.col("_cs").desc(), "_first", "_m")
    return top.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("query_id", "page_id", "rank")
