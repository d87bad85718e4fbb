"""What several text operators share: counted pages, Arrow batches, code points, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.session import prepare

#: A maximal run of letters, combining marks and numbers.
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: White space of the tables: blank, tab, carriage return, line feed. Nothing else counts.
WHITE = " \t\r\n"
WHITE_RUN = regex.compile(r"[ \t\r\n]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def counted_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """The row of each page with the latest crawled_at; rows that tie are identical, so any one stands.

    row_number() <= 1 becomes a group limit before the shuffle, so a page id that holds a third of all rows
    sends one row per map task. A null page_id is no page; a null crawled_at is older than any other.
    """
    w = Window.partitionBy("page_id").orderBy(F.col("crawled_at").desc_nulls_last())
    kept = pages.where("page_id is not null").select("page_id", "crawled_at", *columns)
    return kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "crawled_at")


def pairs_within(members: DataFrame, group: str, key: str, size: int = 4096) -> DataFrame:
    """(a, b), a < b: all pairs of keys of one group. A group of over `size` members is met in pairs of blocks, so no task has it all."""
    blocks = members.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("_n")).where("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    own = members.join(F.broadcast(blocks) if blocks.isEmpty() else blocks, group, "left").select(group, F.col(key).alias("a"), n.alias("_n"), F.pmod(F.xxhash64(key), n.cast("bigint")).cast("int").alias("_o"))
    x = own.select(group, "a", F.col("_o").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j"))
    y = own.select(group, F.col("a").alias("b"), F.col("_o").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    return x.join(y, [group, "_i", "_j"]).where("a < b").select("a", "b")


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About 1.5 x `most` rows drawn by a hash of the key, cut to `most`: for fitting only, never for what is found.

    The hash is filtered before the rows are ordered, so the tasks together send a bounded number of rows to the
    driver, however many tasks there are.
    """
    n = df.count()
    h = F.xxhash64(key)
    share = min(1.0, 1.5 * most / max(n, 1))
    drawn = df if share == 1 else df.where(h < F.lit(int(-(2**63) + share * (2**64 - 1))))
    return drawn.withColumn("_h", h).orderBy("_h").limit(most).drop("_h")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def squeeze(text: str | None) -> str:
    """Lower case, each run of white space one blank; null as empty."""
    return WHITE_RUN.sub(" ", text.lower()) if text else ""


def codepoints(text: str) -> np.ndarray:
    """One uint32 a code point; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@cache
def term_points() -> np.ndarray:
    """Of every code point, whether it is part of a term."""
    inside = np.zeros(0x110000, bool)
    for m in TERM.finditer(np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        inside[m.start() : m.end()] = True
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(cps: np.ndarray, width: int) -> np.ndarray:
    """Mixed 64-bit hash of every window of `width` code points; windows are combined by doubling, so few passes."""
    if len(cps) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, weight = cps.astype(np.uint64) + np.uint64(1), BASE
        out, done, size = None, 0, 1
        while True:
            if width & size:
                if out is None:
                    out, shift = power, weight
                else:
                    n = min(len(out), len(power) - done)
                    out = out[:n] + power[done : done + n] * shift
                    shift = shift * weight
                done += size
            size *= 2
            if size > width:
                break
            half = size // 2
            power = power[:-half] + power[half:] * weight
            weight = weight * weight
        return mix(out[: len(cps) - width + 1])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
