"""Problem 10: repetition inside one document, and lines shared across the documents of one host.

`repeated_share` measures how much of a text repeats an earlier part of the same text, over all windows of a
width. `line_frequency` is the cross-document method: lines are normalised and hashed, the distinct documents
per host are counted, lines above a limit are removed and documents left with too little are rejected. Line
counts across documents say nothing about a text that repeats itself, so p10_found rests on `repeated_share`.

Null, empty and blank texts repeat nothing: share 0. Repeated rows are measured row by row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import arrow_map, codepoints, squeeze, window_hashes

WIDTH, LEAST, SHARE = 20, 100, 0.25
#: A line is removed once more than this many distinct documents of its host hold it.
LINE_LIMIT = 3
#: A document is rejected if less than this share of its characters is left.
KEEP_SHARE = 0.5


def repeated(text: str, width: int = WIDTH) -> tuple[int, int]:
    """Windows of a text, and how many of them occurred at an earlier start."""
    if len(text) < width:
        return 0, 0
    hashes = window_hashes(codepoints(text), width)
    hashes.sort()
    return len(hashes), int(np.count_nonzero(hashes[1:] == hashes[:-1]))


def repeated_share(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_chars, n_windows, n_repeated, share) of each row's squeezed text."""

    def measure(batch: pa.RecordBatch):
        texts = [squeeze(x) for x in batch.column(1).to_pylist()]
        counts = [repeated(x, width) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([n for n, _ in counts], pa.int64()), pa.array([r for _, r in counts], pa.int64())],
            names=[key, "n_chars", "n_windows", "n_repeated"],
        )

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(key, text), measure, f"{key} {kind}, n_chars bigint, n_windows bigint, n_repeated bigint")
    return out.withColumn("share", F.when(F.col("n_windows") > 0, F.col("n_repeated") / F.col("n_windows")).otherwise(F.lit(0.0)))


def line_frequency(docs: DataFrame, limit: int = LINE_LIMIT, keep: float = KEEP_SHARE) -> DataFrame:
    """(doc_id, n_lines, n_removed, chars, chars_left, rejected): a host's lines in more than `limit` documents go.

    Lines are squeezed and trimmed, empty ones left out; a null source is a host of its own. Only hashes of lines
    travel. The distinct documents of a line are counted in two steps, so a line that a third of all
    documents hold is pre-aggregated; frequent lines then meet their rows in a join that may split skewed keys.
    Texts without lines keep nothing and are rejected.
    """
    line = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[ \t\r]+", " "))
    host = F.coalesce(F.col("source"), F.lit(""))
    own = docs.select("doc_id", host.alias("_host"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_l"))
    rows = own.select("doc_id", "_host", F.explode("_l").alias("_x")).select("doc_id", "_host", line(F.col("_x")).alias("_x")).where("_x <> ''")
    lines = rows.select("doc_id", "_host", F.xxhash64("_x").alias("_h"), F.length("_x").cast("bigint").alias("_n"))
    per_doc = lines.groupBy("_host", "_h", "doc_id").agg(F.count("*").alias("_c"), F.sum("_n").alias("_n"))
    common = per_doc.groupBy("_host", "_h").agg(F.count("*").alias("_d")).where(F.col("_d") > limit).select("_host", "_h", F.lit(True).alias("_common"))
    marked = per_doc.join(common, ["_host", "_h"], "left")
    hit = F.col("_common").isNotNull()
    sums = marked.groupBy("doc_id").agg(
        F.sum("_c").alias("n_lines"), F.sum(F.when(hit, F.col("_c")).otherwise(0)).alias("n_removed"),
        F.sum("_n").alias("chars"), F.sum(F.when(hit, 0).otherwise(F.col("_n"))).alias("chars_left"),
    )
    zero = {c: 0 for c in ("n_lines", "n_removed", "chars", "chars_left")}
    out = docs.select("doc_id").distinct().join(sums, "doc_id", "left").fillna(zero)
    return out.withColumn("rejected", (F.col("chars") == 0) | (F.col("chars_left") < keep * F.col("chars")))


def found(docs: DataFrame) -> DataFrame:
    """p10_found: texts of at least 100 squeezed characters, a quarter of whose windows occurred earlier."""
    share = repeated_share(docs)
    return share.where((F.col("n_chars") >= LEAST) & (4 * F.col("n_repeated") >= F.col("n_windows")) & (F.col("n_windows") > 0)).select("doc_id")
