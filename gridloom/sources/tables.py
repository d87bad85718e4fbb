"""Readers and writers of the engine's inputs and artefacts."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions.text import page_id
from gridloom.session import prepare

#: Bytes of a shard of a written matrix.
SHARD_BYTES = 95 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def pages_json(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(page_id, title, content, position) of one JSON file a page, or of one page a line; the file's stem stands in for a missing id.

    Null or missing titles and contents are empty. `position` orders pages by file name. A missing folder is an error, and a line without an id.
    """
    raw = spark.read.schema("page_id string, title string, content string").option("multiLine", not lines).option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = raw.withColumn("_stem", F.url_decode(stem))
    out = rows.select(page_id("page_id" if lines else F.coalesce("page_id", "_stem")).alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "_stem")
    return out.withColumnRenamed("_stem", "position")


def queries_json(spark: SparkSession, path: str, as_set: bool = False, lines: bool = False) -> DataFrame:
    """(query_id, query, relevant) of a JSON list of queries, or of one query a line, with relevant page ids; as sets without repeats."""
    raw = spark.read.schema("query_id string, query string, relevant_page_ids array<string>").option("multiLine", not lines).json(path)
    ids = F.transform(F.coalesce("relevant_page_ids", F.array().cast("array<string>")), page_id)
    return raw.select("query_id", "query", (F.array_distinct(ids) if as_set else ids).alias("relevant"))


def manifest_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(dim, seq, op, batch, queries, gt) of a scenario's manifest, in order; or of one manifest a line."""
    op = "type string, batch string, ids string, queries string, gt string"
    raw = spark.read.schema(f"dim int, operations array<struct<{op.replace(' ', ':')}>>".replace(",:", ",")).option("multiLine", not lines).json(path)
    return raw.select("dim", F.posexplode("operations").alias("seq", "_o")).select("dim", "seq", F.col("_o.type").alias("op"), F.coalesce("_o.batch", "_o.ids").alias("batch"), F.col("_o.queries").alias("queries"), F.col("_o.gt").alias("gt"))


def manifest_totals(spark: SparkSession, path: str) -> dict[str, int]:
    """The totals of inserts, deletes and searches that a manifest's config states, 1 at least."""
    raw = spark.read.schema("config struct<total_insert:bigint,total_delete:bigint,total_search:bigint>").option("multiLine", True).json(path).first()
    held = raw["config"] if raw else None
    return {op: max(1, (held[f"total_{op}"] if held else None) or 1) for op in ("insert", "delete", "search")}


def truth_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, succeeded, failed): the expected ids of mutations, one JSON object a file; missing lists are empty."""
    raw = spark.read.schema("succeeded array<bigint>, failed array<bigint>").option("multiLine", True).json(path)
    none = F.array().cast("array<bigint>")
    return raw.select(F.input_file_name().alias("file"), *(F.coalesce(c, none).alias(c) for c in ("succeeded", "failed")))


def arrays_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values) of saved number arrays: ids (a number a row), query vectors and expected search results (a list a row).

    Files are read by the tasks, each by one; arrays of Python objects are refused, for reading them runs code.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.load(io.BytesIO(data.as_buffer()), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(np.float64)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["file", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row bigint, values array<double>")


def batch_rows(changelog: DataFrame) -> DataFrame:
    """(batch, op, pos, vec_id, embedding): a batch as a map of ids, repeats of one id folded: last vector, first position.

    Deletes keep their repeats, for the second delete of an id fails. Exactly repeated rows count once.
    """
    one = changelog.where("vec_id is not null").select("batch", "op", "pos", "vec_id", "embedding")
    inserts = one.where("op = 'insert'").groupBy("batch", "op", "vec_id").agg(F.min("pos").alias("pos"), F.max_by("embedding", "pos").alias("embedding"))
    deletes = one.where("op = 'delete'").select("batch", "op", "pos", "vec_id").distinct().withColumn("embedding", F.lit(None).cast("array<float>"))
    return inserts.select("batch", "op", "pos", "vec_id", "embedding").union(deletes.select("batch", "op", "pos", "vec_id", "embedding"))


def operations(manifest: DataFrame) -> DataFrame:
    """(scenario, seq, op, batch) without repeated rows."""
    return manifest.select("scenario", "seq", "op", "batch").distinct()


def latest_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, lang): of each page the row crawled last; tied rows are identical. Null ids are dropped."""
    w = Window.partitionBy("page_id").orderBy(F.col("crawled_at").desc_nulls_last())
    rows = pages.where("page_id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return rows.select("page_id", "title", "content", "lang")


def write_matrix(vectors: DataFrame, path: str, dim: int, bytes_per_number: int = 4) -> None:
    """Vectors in files of at most SHARD_BYTES of numbers each."""
    rows = max(1, SHARD_BYTES // (dim * bytes_per_number))
    vectors.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """All shards; a missing path is an error."""
    return spark.read.parquet(path)


def write_postings(index: dict[str, DataFrame], path: str) -> None:
    """Postings sorted by term within files, so that a query's terms prune row groups; vocabulary, lengths and totals beside them."""
    index["postings"].repartitionByRange("term").sortWithinPartitions("term", "page_id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("vocab", "lengths", "corpus"):
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_postings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocab", "lengths", "corpus")}


def read_timings(path: str, runs: int, version: int = 2) -> dict | None:
    """Cached baseline timings, if they are of this version or later and of as many runs."""
    file = Path(path)
    if not file.is_file():
        return None
    held = json.loads(file.read_text())
    return held if held.get("cache_version", 0) >= version and held.get("n_runs") == runs else None


def write_timings(path: str, timings: dict, runs: int, version: int = 2) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(timings | {"cache_version": version, "n_runs": runs}))
