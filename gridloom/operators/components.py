"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.session import cut, forget, prepare


#: Copies of a node's least neighbour, so that a hub of a third of all links isn't joined in one task.
SALTS = 8
#: Edges up to which one task finds all components (16 bytes each).
LOCAL = 1 << 17


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges, where component is the smallest node of it.

    Up to LOCAL edges are one task's. More go by rounds that alternate two steps on the edge list until it stops changing: every node hands its smallest neighbour to its
    larger neighbours, then to all its smaller ones. Each component ends as a star around its smallest node
    after a logarithmic number of rounds. The minimum of a neighbourhood is an aggregate and joined by salted keys, so a
    hub is never gathered in one task. Rows with a null end are ignored; loops and repeated edges are harmless; no edges give no rows.
    """
    prepare(edges.sparkSession)
    x, y = F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(x, y)
    pairs = cut(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if pairs.count() <= LOCAL:
        return pairs.coalesce(1).mapInArrow(_whole, "node bigint, component bigint")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links = pairs.where("u <> v")
    before, written = None, False
    while True:
        old, links = links, cut(_small(_large(links)))
        if written:
            forget(old)
        written = True
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("_m")), "node", "left").select("node", F.coalesce("_m", "node").alias("component"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (u, v): every node takes the least label next to it, and its label's, until none changes."""
    held = list(batches)
    if not sum(len(x) for x in held):
        return
    u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[u], label[v])
        for end in (u, v):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)  # the label's own node as well, so chains halve
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _salted(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (u, v) with the least neighbour of u."""
    many = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(many, ["u", "_s"])


def _large(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest of it and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return _salted(both, least).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    down = links.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("_m"))
    moved = _salted(down, least).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(least.select("u", F.col("_m").alias("v"))).distinct()
