"""Packing sentences into passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.text import chunk_spans, sentences, strip, text_of

GRANULARITIES = (100, 150)


def chunks(pages: DataFrame, target: int = 100) -> DataFrame:
    """(page_id, chunk_id, text) of pages (page_id, title, content): whole sentences up to `target` words a passage.

    Each passage opens with the title, stripped of white space. A page without sentences has its title, or its id, as the only one. No shuffle: a
    page's passages come from folds over its own sentences.
    """
    return _packed(pages, (target,)).select("page_id", "chunk_id", "text")


def passages(pages: DataFrame, granularities: tuple[int, ...] = GRANULARITIES) -> DataFrame:
    """(granularity, page_id, chunk_id, text) at each target size."""
    return _packed(pages, granularities)


def _packed(pages: DataFrame, targets: tuple[int, ...]) -> DataFrame:
    """The passages at all target sizes, from sentences that are split and counted once."""
    title = strip(text_of("title"))
    own = F.array(F.when(title != "", title).otherwise(F.col("page_id").cast("string")))
    found = pages.select("page_id", title.alias("_t"), sentences("content").alias("_s"), own.alias("_o"))
    found = found.withColumn("_s", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_o")))
    # sentences have no white space at their ends and aren't empty
    counted = found.withColumn("_w", F.transform("_s", lambda s: F.size(F.split(s, r"(?U)\s+"))))
    sizes = F.array(*(F.struct(F.lit(g).alias("g"), chunk_spans(F.col("_w"), g).alias("c")) for g in targets))
    spans = counted.select("page_id", "_t", "_s", F.explode(sizes).alias("_g"))
    prefix = F.when(F.col("_t") != "", F.concat("_t", F.lit(". "))).otherwise(F.lit(""))
    text = F.concat(prefix, F.array_join(F.slice("_s", F.col("_x.s") + 1, F.col("_x.e") - F.col("_x.s") + 1), " "))
    rows = spans.select(F.col("_g.g").alias("granularity"), "page_id", "_t", "_s", F.posexplode("_g.c").alias("chunk_id", "_x"))
    return rows.select("granularity", "page_id", "chunk_id", text.alias("text"))
