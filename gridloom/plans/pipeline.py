"""The two pipelines: building the text index, and answering a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.embedding import hash_embed
from gridloom.functions.text import connective
from gridloom.functions.vectors import half
from gridloom.operators import bm25, chunking, entity_clusters, fusion
from gridloom.session import cut
from gridloom.sources import tables

#: Similarity of lead passages over which two pages are one entity.
ENTITY = 0.75


def embed_passages(passages: DataFrame, embed=hash_embed) -> DataFrame:
    """(granularity, page_id, chunk_id, embedding) of passages (granularity, page_id, chunk_id, text); no join, the key travels along."""
    keyed = passages.select(F.struct("granularity", "page_id", "chunk_id").alias("key"), "text")
    return embed(keyed, "key", "text").select("key.*", "embedding")


def embed_queries(queries: DataFrame, embed=hash_embed) -> DataFrame:
    return embed(queries.select("query_id", "query"), "query_id", "query")


def build_index(pages: DataFrame, path: str, granularities: tuple[int, ...] = chunking.GRANULARITIES, embed=hash_embed, entity: float = ENTITY) -> None:
    """Chunk, embed, cluster and count pages (page_id, title, content), and write all artefacts under a path."""
    passages = chunking.passages(pages, granularities)
    # half precision, as numbers of 4 bytes of which most bits are 0: they compress to what 2 bytes take
    halved = half(F.col("embedding")).cast("array<float>")
    fusion.nest(cut(embed_passages(passages, embed).withColumn("embedding", halved))).write.mode("overwrite").parquet(f"{path}/vectors")
    leads = fusion.unnest(pages.sparkSession.read.parquet(f"{path}/vectors")).where((F.col("granularity") == granularities[0]) & (F.col("chunk_id") == 0)).select("page_id", "embedding")
    entity_clusters.clusters(pages, entity_clusters.similar_links(leads, entity)).write.mode("overwrite").parquet(f"{path}/clusters")
    tables.write_postings(bm25.build(pages), path)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The artefacts that `build_index` wrote."""
    vectors = spark.read.parquet(f"{path}/vectors")
    return tables.read_postings(spark, path) | {"vectors": vectors, "passages": fusion.unnest(vectors), "clusters": spark.read.parquet(f"{path}/clusters")}


def signals(index: dict[str, DataFrame], queries: DataFrame, embed=hash_embed, weights: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(query_id, page_id, score) of every page for every query of the batch."""
    n_pages = index["corpus"].first()["n_docs"]
    z = fusion.z_dense(fusion.dense(embed_queries(queries, embed), index["passages"]), "best", "lead")
    return fusion.fuse(z, bm25.scores(index, queries), bm25.number_scores(index, queries), n_pages, weights or (fusion.DENSE, fusion.LEAD, fusion.LEXICAL, fusion.NUMBER))


def search_batch(index: dict[str, DataFrame], queries: DataFrame, k: int = fusion.TOP, embed=hash_embed, weights: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(query_id, page_id, rank): fused ranking, re-ranked by entity cluster for queries that ask how things are connected."""
    n_pages = index["corpus"].first()["n_docs"]
    own = weights or (fusion.DENSE, fusion.LEAD, fusion.LEXICAL, fusion.NUMBER)
    vectors = index["vectors"] if "vectors" in index else cut(fusion.nest(index["passages"]))
    scores = cut(fusion.best_pages(embed_queries(queries, embed), vectors, bm25.scores(index, queries), bm25.number_scores(index, queries), n_pages, own, max(k, fusion.CANDIDATES)))
    asks = queries.select("query_id", connective("query").alias("_ask"))
    plain = fusion.ranked(scores.join(asks.where("not _ask").select("query_id"), "query_id", "left_semi"), k).select("query_id", "page_id", "rank")
    regrouped = fusion.rerank(scores.join(asks.where("_ask").select("query_id"), "query_id", "left_semi"), index["clusters"], k)
    return plain.unionByName(regrouped)


class Retriever:
    """Answers batches of query strings from the artefacts of one path, which are loaded once."""

    def __init__(self, spark: SparkSession, path: str, embed=hash_embed) -> None:
        self.spark, self.embed = spark, embed
        self.index = load_index(spark, path)

    def run(self, queries: list[str], k: int = fusion.TOP) -> list[list[int]]:
        """The ranked page ids of each query; no queries give no lists."""
        if not queries:
            return []
        rows = self.spark.createDataFrame([(f"{i:09d}", q) for i, q in enumerate(queries)], "query_id string, query string")
        out: list[list[int]] = [[] for _ in queries]
        for r in search_batch(self.index, rows, k, self.embed).orderBy("query_id", "rank").collect():
            out[int(r["query_id"])].append(r["page_id"])
        return out
