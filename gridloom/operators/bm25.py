"""The lexical index and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.text import number_groups, text_of, tokens
from gridloom.session import cut

K1, B = 2.0, 1.0
#: Rows of a query side that may be sent to all tasks.
SENT = 100_000


def documents(pages: DataFrame) -> DataFrame:
    """(page_id, tokens) of title and content."""
    return pages.select("page_id", tokens(F.concat(text_of("title"), F.lit(" "), text_of("content"))).alias("tokens"))


def lengths(docs: DataFrame) -> DataFrame:
    """(page_id, doc_len): all tokens count, pruned terms' too."""
    return docs.select("page_id", F.size("tokens").cast("bigint").alias("doc_len"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(page_id, term, tf); counters stop at 65,535."""
    rows = docs.select("page_id", F.explode("tokens").alias("term"))
    return rows.groupBy("page_id", "term").agg(F.least(F.count("*"), F.lit(65535)).cast("bigint").alias("tf"))


def vocabulary(freq: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) of the terms of at least two pages."""
    df = freq.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    return df.withColumn("idf", F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def build(pages: DataFrame) -> dict[str, DataFrame]:
    """postings (term, page_id, tf), vocab (term, df, idf), lengths (page_id, doc_len), corpus (n_docs, avgdl).

    Each is written to the shared folder: texts are tokenised once, and queries read tables.
    """
    docs = cut(documents(pages))
    lens = lengths(docs)
    corpus = cut(lens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(1.0)).alias("avgdl")))
    n = corpus.first()["n_docs"]
    freq = cut(frequencies(docs))
    vocab = cut(vocabulary(freq, n))
    return {"postings": cut(freq.join(vocab.select("term"), "term", "left_semi").select("term", "page_id", "tf")), "vocab": vocab, "lengths": cut(lens), "corpus": corpus}


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the count allows it; a shuffled join otherwise."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def scores(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, page_id, score) of matching pages; a query's terms count once.

    The queries' terms prune the postings before anything is summed.
    """
    avgdl = index["corpus"].first()["avgdl"] or 1.0
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    wanted = _small(terms.join(index["vocab"], "term").select("query_id", "term", "idf"))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.lit(float(avgdl) or 1.0))
    hits = index["postings"].join(wanted, "term").join(index["lengths"], "page_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("query_id", "page_id").agg(F.sum(part).alias("score"))


def number_terms(queries: DataFrame) -> DataFrame:
    """(query_id, grp, term): each number group's alternatives; repeated groups count again."""
    return queries.select("query_id", F.posexplode(number_groups("query")).alias("grp", "_a")).select("query_id", "grp", F.explode("_a").alias("term"))


def number_scores(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, page_id, score): for each group that a page holds an alternative of, the greatest idf of the group's known alternatives."""
    known = number_terms(queries).join(index["vocab"].select("term", "idf"), "term")
    best = known.groupBy("query_id", "grp").agg(F.max("idf").alias("idf"))
    present = index["postings"].join(_small(known.select("query_id", "grp", "term")), "term").select("query_id", "grp", "page_id").distinct()
    return present.join(F.broadcast(best) if best.limit(SENT + 1).count() <= SENT else best, ["query_id", "grp"]).groupBy("query_id", "page_id").agg(F.sum("idf").alias("score"))
