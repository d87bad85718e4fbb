"""Clusters of pages whose lead passages are alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.functions.vectors import usable
from gridloom.operators.components import connected_components
from gridloom.session import cut, prepare

#: Rows of a block of the comparison.
BLOCK = 4096
#: Rows of a block that are compared with another block at once, where links are found.
SLICE = 256
#: Links that a task holds before it reduces them (16 bytes each).
HELD = 1 << 20


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have; the smaller of two, 0 without vectors."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count()
    row = sizes.orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def similar_pairs(leads: DataFrame, threshold: float = 0.75, dim: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of (page_id, embedding) with a cosine over the threshold.

    Exact, hence quadratic in products: rows are hashed into blocks of bounded size, each pair of blocks is one
    task's matrix product, and only pairs over the threshold leave it. A row travels once for each block.
    Vectors of another length than `dim` (by default that of most) and unusable ones are left out.
    """
    rows, dim = _fit(leads, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, left_ids, left, right_ids, right in _blocks(batches, dim):
            for s in range(0, len(left), 1024):
                sim = np.round(left[s : s + 1024] @ right.T, 9)
                a, b = np.nonzero(sim > threshold)
                pa_, pb = left_ids[s : s + 1024][a], right_ids[b]
                keep = pa_ < pb if same else np.ones(len(a), bool)
                lo, hi = np.minimum(pa_, pb)[keep], np.maximum(pa_, pb)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(sim[a, b][keep])], names=["a", "b", "similarity"])

    return _placed(rows).mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_links(leads: DataFrame, threshold: float = 0.75, dim: int | None = None) -> DataFrame:
    """(a, b) whose components are those of `similar_pairs`, without a row for every pair.

    As exact as the pairs, and compared in the same blocks. Equal vectors are compared once. A task joins what its blocks
    link and hands on one link for each row it joined; ends of a link are joined, but needn't be alike themselves.
    Products are of single precision; those too close to the threshold for it are taken again in double.
    """
    rows, dim = _fit(leads, dim)
    one = cut(rows.groupBy("embedding").agg(F.min("page_id").alias("page_id")))
    copies = rows.join(one.select("embedding", F.col("page_id").alias("a")), "embedding").where(F.lit(threshold < 1) & (F.col("a") != F.col("page_id")))
    margin = (dim + 4) * 2.0**-22  # more than what single precision is off by, of unit vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0
        for same, left_ids, left, right_ids, right in _blocks(batches, dim):
            ids = left_ids if same else np.concatenate([left_ids, right_ids])
            shift, label = 0 if same else len(left_ids), np.arange(len(ids))
            single, other = left.astype(np.float32), right.astype(np.float32).T.copy()
            for s in range(0, len(left), SLICE):
                sim = single[s : s + SLICE] @ other
                a, b = np.nonzero(sim > threshold - margin)
                apart = label[a + s] != label[b + shift]
                a, b = a[apart], b[apart]
                near = sim[a, b] <= threshold + margin
                label = joined(label, a[~near] + s, b[~near] + shift)
                a, b = a[near] + s, b[near]
                apart = label[a] != label[b + shift]
                a, b = a[apart], b[apart]
                over = np.round(np.einsum("ij,ij->i", left[a], right[b]), 9) > threshold
                label = joined(label, a[over], b[over] + shift)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            us.append(ids[label[moved]])
            vs.append(ids[moved])
            n += len(moved)
            if n > HELD:
                u, v = _forest(us, vs)
                us, vs, n = [u], [v], len(u)
                if n > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])
                    us, vs, n = [], [], 0
        if n:
            u, v = _forest(us, vs)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return _placed(one).mapInArrow(run, "a bigint, b bigint").union(copies.select("a", F.col("page_id").alias("b")))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after links between nodes a and b; a label is a node of its component, and that node's own label."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        root = np.arange(len(label))
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
        label = root[label]


def _forest(us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One link for each node that the links join to another."""
    n = sum(len(u) for u in us)
    nodes, at = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
    label = joined(np.arange(len(nodes)), at[:n], at[n:])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _fit(leads: DataFrame, dim: int | None) -> tuple[DataFrame, int]:
    """The usable rows (page_id, embedding), one a page, and the length of their vectors."""
    prepare(leads.sparkSession)
    dim = dimension(leads) if dim is None else dim
    return cut(leads.where(F.col("page_id").isNotNull() & usable(F.col("embedding"), dim)).select("page_id", "embedding").dropDuplicates(["page_id"])), dim


def _placed(rows: DataFrame) -> DataFrame:
    """(i, j, o, page_id, embedding): each row of block o at every pair of blocks that it meets in."""
    n = max(1, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(j, F.col("o")).alias("i"), F.greatest(j, F.col("o")).alias("j")))
    spread = rows.withColumn("o", own).select("page_id", "embedding", "o", F.explode(meet).alias("_p")).select(F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "o", "page_id", "embedding")
    return spread.repartition("i", "j").sortWithinPartitions("i", "j", "o", "page_id")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks among placed rows: are they one block, and the ids and unit vectors of both."""
    at, held = None, []

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        i, j, o, ids = (t.column(c).to_numpy() for c in range(4))
        x = t.column(4).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left, right = (o == i[0], o == j[0])
        return i[0] == j[0], ids[left], x[left], ids[right], x[right]

    for batch in batches:
        i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(batch)] if len(batch) else [0]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            key = (int(i[s]), int(j[s]))
            if at is not None and key != at and held:
                yield flush()
                held.clear()
            at = key
            held.append(batch.slice(s, e - s))
    if held:
        yield flush()


def clusters(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, cluster_id) of all pages, by pairs or links: the smallest page that is joined directly or through others; singletons are kept."""
    labels = connected_components(cut(pairs.select("a", "b")))
    return pages.select("page_id").distinct().join(labels.withColumnRenamed("node", "page_id"), "page_id", "left").select("page_id", F.coalesce("component", "page_id").alias("cluster_id"))
