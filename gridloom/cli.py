"""Commands: score a scenario, evaluate the text search, sweep its weights.

python -m gridloom.cli scenario FOLDER --scenario N [--recalibrate]
python -m gridloom.cli evaluate FOLDER
python -m gridloom.cli sweep FOLDER --dense 1 --lead 0.8 --bm25 1 --number 2.5 [--verbose]
FOLDER holds the parquet tables.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession, functions as F

from gridloom.functions.metrics import runtime_multiplier
from gridloom.operators import bm25, entity_clusters, evaluation, fusion
from gridloom.operators.vector_index import NaiveIndex, VectorIndex
from gridloom.plans import pipeline, scenario as plays
from gridloom.session import cut, prepare
from gridloom.sources import tables

#: Seconds after which a scenario stops, and runs that the baseline is the mean of.
WALL, RUNS = 50.0, 3
#: Numbers of a vector where a manifest doesn't say.
DIM = 64


def scenario(spark: SparkSession, folder: str, number: int, cache: str, recalibrate: bool) -> dict[str, float]:
    """Scores of one scenario: what the index gave back against the declarative replay, its time against the naive index."""
    log, ops = tables.table(spark, folder, "changelog"), tables.table(spark, folder, "manifest")
    queries = tables.table(spark, folder, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")
    dim = ops.where(F.col("scenario") == number).agg(F.max("dim")).first()[0] or DIM
    held = None if recalibrate else tables.read_timings(cache, RUNS)
    if held is None:
        runs = [plays.play(log, ops, number, queries, NaiveIndex(spark, dim))[2] for _ in range(RUNS)]
        held = {f"baseline_{k}": sum(r[k] for r in runs) / RUNS for k in ("initial", "dynamic")}
        tables.write_timings(cache, held, RUNS)
    said, answers, times = plays.play(log, ops, number, queries, VectorIndex(spark, dim), wall=WALL)
    scores = plays.score(log, ops, number, queries, said, answers, dim)
    ratio = times["dynamic"] / max(held["baseline_dynamic"], 1e-9)
    mark = spark.range(1).select(runtime_multiplier(F.lit(2.1 if times["timed_out"] else ratio)).alias("m")).first()["m"]
    return scores | times | {"ratio": ratio, "multiplier": mark, "final": scores["functional"] * mark}


def sweep(spark: SparkSession, folder: str, weights: tuple[float, float, float, float], verbose: bool = False) -> dict[str, float]:
    """Mean NDCG, coverage and ceiling of the text search at some weights; `verbose` prints each query's NDCG with what was missed."""
    pages = cut(tables.latest_pages(tables.table(spark, folder, "page")))
    passages = tables.table(spark, folder, "passage").dropDuplicates(["passage_id"])
    queries = tables.table(spark, folder, "search_query")
    leads = passages.where("granularity = 100 and chunk_id = 0").select("page_id", "embedding")
    index = bm25.build(pages) | {"passages": cut(pipeline.embed_passages(passages)), "clusters": cut(entity_clusters.clusters(pages, entity_clusters.similar_pairs(leads)))}
    start = time.perf_counter()
    ranking = cut(pipeline.search_batch(index, queries, fusion.TOP, weights=weights))
    took = time.perf_counter() - start
    if verbose:
        missed = ranking.groupBy("query_id").agg(F.collect_set("page_id").alias("_top"))
        rows = evaluation.ndcg(ranking, queries).join(queries.select("query_id", "query", "relevant"), "query_id").join(missed, "query_id", "left")
        for r in rows.select("query_id", "query", "ndcg", F.array_except("relevant", F.coalesce("_top", F.array().cast("array<bigint>"))).alias("missed")).orderBy("query_id").toLocalIterator():
            print(f"{r['query_id']}  {r['ndcg']:.4f}  {r['query']}  missed {r['missed']}", file=sys.stderr)
    score, cover, ceiling = evaluation.mean_ndcg(ranking, queries).first(), evaluation.pooled_coverage(ranking, queries).first(), evaluation.oracle_ceiling(queries).first()
    return {"num_queries": score["n_queries"], "mean_ndcg": score["mean_ndcg"], "coverage": cover["coverage"], "ceiling": ceiling["ceiling"], "seconds": took}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["scenario", "evaluate", "sweep"])
    parser.add_argument("folder")
    parser.add_argument("--scenario", type=int, default=1)
    parser.add_argument("--recalibrate", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--cache", default=".gridloom-baseline.json")
    for name, value in (("dense", fusion.DENSE), ("lead", fusion.LEAD), ("bm25", fusion.LEXICAL), ("number", fusion.NUMBER)):
        parser.add_argument(f"--{name}", type=float, default=value)
    args = parser.parse_args()
    spark = prepare(SparkSession.builder.appName("gridloom").getOrCreate())
    if args.command == "scenario":
        out = scenario(spark, args.folder, args.scenario, args.cache, args.recalibrate)
    else:
        weights = (fusion.DENSE, fusion.LEAD, fusion.LEXICAL, fusion.NUMBER) if args.command == "evaluate" else (args.dense, args.lead, args.bm25, args.number)
        out = sweep(spark, args.folder, weights, args.verbose)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
