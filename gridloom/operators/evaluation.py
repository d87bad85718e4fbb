"""Scores of rankings against relevant ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.metrics import discount, ideal


def dcg(gains: DataFrame) -> DataFrame:
    """(query_id, dcg) of rows (query_id, rank, gain)."""
    return gains.groupBy("query_id").agg(F.sum(F.col("gain") * discount(F.col("rank"))).alias("dcg"))


def gains(ranking: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, gain): repeats of a page are skipped and later ones move up, then the list is cut to k."""
    first = ranking.groupBy("query_id", "page_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("query_id").orderBy("_r", "page_id")
    top = first.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    relevant = truth.select("query_id", F.explode(F.array_distinct("relevant")).alias("page_id")).withColumn("gain", F.lit(1.0))
    return top.join(relevant, ["query_id", "page_id"], "left").select("query_id", "rank", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def ndcg(ranking: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of every query of the truth; 0 where nothing is relevant or nothing was ranked."""
    got = dcg(gains(ranking, truth, k))
    size = F.coalesce(F.size(F.array_distinct("relevant")), F.lit(0))
    best = truth.select("query_id", ideal(F.least(size, F.lit(k))).alias("_ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.when(F.col("_ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def mean_ndcg(ranking: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(n_queries, mean_ndcg); 0 without queries."""
    return ndcg(ranking, truth, k).agg(F.count("*").alias("n_queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))


def evaluate(queries: list[str], run: list[list[int]], relevant: list[list[int]], spark, k: int = 10) -> dict[str, float]:
    """Mean score of a run given as lists, checked for shape."""
    if len(run) != len(queries) or len(relevant) != len(queries):
        raise ValueError("one ranking and one set of relevant ids is needed for each query")
    if not all(isinstance(r, list) for r in run):
        raise TypeError("rankings must be lists")
    rows = [(str(i), int(p), int(r)) for i, ranking in enumerate(run) for r, p in enumerate(ranking, 1)]
    ranking = spark.createDataFrame(rows, "query_id string, page_id bigint, rank bigint")
    truth = spark.createDataFrame([(str(i), [int(p) for p in r]) for i, r in enumerate(relevant)], "query_id string, relevant array<bigint>")
    row = mean_ndcg(ranking, truth, k).first()
    return {"num_queries": float(row["n_queries"]), "mean_ndcg": row["mean_ndcg"]}


def oracle_ceiling(truth: DataFrame, k: int = 10) -> DataFrame:
    """(n_queries, ceiling): what one fixed ranking for each query string could score at most, over queries that share a string.

    Slots go to the pages of greatest value, 1 / ideal of the query's set; ties to the query that comes first.
    """
    sized = truth.select("query", "query_id", F.array_distinct("relevant").alias("_r")).withColumn("_v", 1 / ideal(F.least(F.size("_r"), F.lit(k))))
    pool = sized.where(F.size("_r") > 0).select("query", "query_id", "_v", F.explode("_r").alias("page_id"))
    w = Window.partitionBy("query").orderBy(F.round("_v", 12).desc(), "query_id", "page_id")
    slots = pool.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    got = slots.groupBy("query", "query_id").agg(F.sum(F.col("_v") * discount(F.col("_k"))).alias("_s"))
    return truth.select("query", "query_id").join(got, ["query", "query_id"], "left").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("_s", F.lit(0.0))).alias("ceiling"))


def pooled_coverage(ranking: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(found, possible, coverage): over distinct query strings, the share of pooled relevant pages in the first ranking's top k."""
    first = truth.groupBy("query").agg(F.min("query_id").alias("query_id"), F.array_distinct(F.flatten(F.collect_list("relevant"))).alias("pool"))
    top = ranking.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("page_id").alias("top"))
    joined = first.join(top, "query_id", "left").withColumn("top", F.coalesce("top", F.array().cast("array<bigint>")))
    sums = joined.agg(F.sum(F.size(F.array_intersect("top", "pool"))).alias("found"), F.sum(F.least(F.size("pool"), F.lit(k))).alias("possible"))
    return sums.select(F.col("found").cast("bigint").alias("found"), F.col("possible").cast("bigint").alias("possible"), F.when(F.col("possible") > 0, F.col("found") / F.col("possible")).otherwise(0.0).alias("coverage"))
