"""Problem 1: the most similar vectors for every vector, by an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is indexed. A vector goes to the
lists of its nearest centroids, as item and as query alike: two vectors are compared if they share a list. In a list,
a query's table entries sum up to the approximate similarity of every item; all that can be among the best within the error
of their codes are compared with their whole vectors. A list that grows over SPLIT has a quantiser of its own, fitted on
a bounded sample of its members, and is split into lists of a second level in the same way. Lists over a size are cut into
blocks of items, each of which meets the list's queries in blocks, so no task holds a hot list at once.

Every row is a query, so whole vectors travel to the lists anyway: codes needn't travel, and are made where a list is
compared. Vectors are scaled to length 1 (similarity is the cosine). Equal vectors are one representative until the end, and
only the least ids of a group are ever listed as somebody's neighbours, so copies of a third of all rows stay linear.
Unusable vectors (null, of another length, not finite, all zero) are left out. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions.vectors import usable
from gridloom.llm.common import arrow_map, bounded_sample
from gridloom.session import cut

DIM, K, SIMILARITY = 64, 10, 0.85
#: Vectors that the centroids and codebooks are fitted on, the most lists, lists a vector goes to, list size aimed at.
SAMPLE, LISTS, PROBES, AIM = 32_768, 4096, 4, 256
#: Sub-vectors of the residual, code words of each, rounds of fitting.
PARTS, WORDS, FIT = 8, 64, 8
#: Rows of a list over which it is split by a quantiser of its own, lists of the second level that a vector goes to, list size aimed at.
SPLIT, DEEPER, FINE = 16_384, 8, 1024
#: Rows of a block of a list; what single precision may add to the error of an approximate similarity.
BLOCK, SLACK = 2048, 1e-5
#: Ids that are sent to every task at most (8 bytes each); beyond, vectors are joined by shuffle.
SENT = 100_000
#: Copies of a group's few rows, so that a group of a third of all rows isn't joined in one task.
SALTS = 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Means of k groups of rows; a group that runs empty takes a row at random."""
    rng = np.random.default_rng(seed)
    means = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, means)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=len(means))
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        means[full] = np.add.reduceat(x[order], starts, axis=0) / counts[full, None]
        if not full.all():
            means[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return means


def _nearest(x: np.ndarray, means: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (means**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ means.T - half, axis=1) for i in range(0, len(x), step)])


class Index:
    """Coarse centroids and residual codebooks of one collection."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        sample = sample.astype(np.float32)
        lists = int(np.clip(n // AIM, 1, min(LISTS, max(1, len(sample) // 8))))
        self.centroids = _fit(sample, lists, FIT, 1)
        residual = sample - self.centroids[_nearest(sample, self.centroids)]
        width = sample.shape[1] // PARTS
        self.all, self.deeper = self.centroids, {}
        self.books = np.stack([_fit(np.ascontiguousarray(residual[:8192, i * width : (i + 1) * width]), WORDS, FIT, 2 + i) for i in range(PARTS)])

    def probe(self, x: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """The nearest centroids' numbers, nearest first."""
        return _probe(x, self.centroids, probes)

    def split(self, samples: dict[int, np.ndarray], counts: dict[int, int]) -> None:
        """Fit quantisers of the lists with samples. Their lists are numbered on from the coarse ones."""
        self.deeper: dict[int, tuple[int, np.ndarray]] = {}
        own, at = [self.centroids], len(self.centroids)
        for listed in sorted(samples):
            x = samples[listed].astype(np.float32)
            means = _fit(x, int(np.clip(counts[listed] // FINE, 1, max(1, len(x) // 8))), FIT, listed)
            self.deeper[listed] = at, means
            own.append(means)
            at += len(means)
        self.all = np.concatenate(own)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        width = residual.shape[1] // self.books.shape[0]
        return np.stack([_nearest(residual[:, i * width : (i + 1) * width], book) for i, book in enumerate(self.books)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def approximate(self, queries: np.ndarray, centroid: np.ndarray, decoded: np.ndarray) -> np.ndarray:
        """Products of queries with coded items: the centroid's product plus the sums of the queries' table entries.

        An entry is the product of a query's part with a code word, so an item's entries sum up to the product
        with its decoded residual: one matrix product takes all sums, where adding entries one by one takes ten times as long.
        """
        return queries @ decoded.T + (queries @ centroid)[:, None]


def _probe(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    score = x @ centroids.T - (centroids**2).sum(axis=1) / 2
    m = min(probes, score.shape[1])
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def _compare(index: Index, listed: int, queries: np.ndarray, q_ids: np.ndarray, items: np.ndarray, i_ids: np.ndarray, k: int, least: float) -> list[np.ndarray]:
    """(query, item, similarity) of each query's best k items at or over the least similarity, in one block.

    An approximate similarity is off by no more than the length of what the item's code leaves of it, as queries have
    length 1. Every item that can reach the least similarity and the query's k-th by this bound is compared exactly.
    """
    centroid = index.all[listed]
    decoded = index.decoded(index.codes(items - centroid))
    off = np.linalg.norm(items - centroid - decoded, axis=1) + SLACK
    whole = _double(items)
    out = []
    for s in range(0, len(queries), 1024):
        q, ids = queries[s : s + 1024], q_ids[s : s + 1024]
        score = index.approximate(q, centroid, decoded)
        score[ids[:, None] == i_ids[None, :]] = -np.inf
        floor = np.maximum(_kth(score - off, k), least)
        may = score + off >= floor[:, None]
        some = np.flatnonzero(may.any(axis=1))
        if not len(some):
            continue
        ids, may, exact = ids[some], may[some], _double(q[some]) @ whole.T
        exact[~may] = -2
        rows, cols = np.nonzero(exact >= np.maximum(_kth(exact, k) - 2e-9, least)[:, None])
        sim = exact[rows, cols]
        order = np.lexsort((i_ids[cols], -np.round(sim, 9), rows))
        rows, cols, sim = rows[order], cols[order], sim[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((ids[rows[first]], i_ids[cols[first]], sim[first]))
    if not out:
        return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _double(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of each row, or minus infinity if it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def fit(reps: DataFrame, n: int) -> Index:
    """An index fitted on at most SAMPLE of the vectors, drawn by a hash of the id."""
    rows = bounded_sample(reps.select("id", "embedding"), "id", SAMPLE).select("embedding").toArrow()
    flat = rows.column(0).combine_chunks().flatten().to_numpy()
    return Index(flat.reshape(len(rows), -1), n)


def similar(reps: DataFrame, index: Index, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): for every vector the k most similar of those it shares a list with, once a list or block. `reps` is a written table of id and unit embedding."""
    dim = index.centroids.shape[1]
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(index)  # at most LISTS centroids and PARTS x WORDS code words, whatever the input

    def spread(batch: pa.RecordBatch):
        n = len(batch)
        if not n:
            return
        x = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(n, dim), np.float32)
        lists = shared.value.probe(x)
        m = lists.shape[1]
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), n, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(lists.astype(np.int32).ravel()))
        yield pa.RecordBatch.from_arrays([held, batch.column(0), raw], names=["ls", "id", "x"])

    # a vector is written once with the numbers of its lists; copies for each list go to the shuffle only
    probed = cut(arrow_map(reps.select("id", "embedding"), spread, "ls array<int>, id bigint, x binary"))
    rows = probed.select(F.explode("ls").alias("l"), "id", "x")
    # one count a list: at most LISTS rows reach the driver
    counts = dict(rows.select("l").groupBy("l").count().where(F.col("count") > BLOCK).collect())
    large = {l: n for l, n in counts.items() if n > SPLIT}
    if large:
        index.split(_samples(rows, large, dim), large)
        shared = spark.sparkContext.broadcast(index)  # and at most SAMPLE / 8 centroids more
        rows = _split(rows, shared, large, dim)
        rows = cut(rows)
        counts = dict(rows.select("l").groupBy("l").count().where(F.col("count") > BLOCK).collect())
    blocks = spark.createDataFrame([(l, -(-n // BLOCK)) for l, n in counts.items()], "l int, n int")
    count = F.coalesce("n", F.lit(1))
    rows = rows.join(F.broadcast(blocks), "l", "left")
    own = F.pmod(F.xxhash64("id"), count.cast("bigint")).cast("int")
    hot = F.col("n") > 1
    numbered = rows.withColumn("n", count).withColumn("own", own)
    plain = numbered.where(~hot).select("l", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "x")
    todo = plain
    if counts:
        # block pairs (i, j): block i of the items meets block j of the queries
        item = numbered.where(hot).select("l", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.lit(1).alias("side"), "id", "x")
        query = numbered.where(hot).select("l", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.col("own").alias("j"), F.lit(2).alias("side"), "id", "x")
        todo = plain.union(item.select(*plain.columns)).union(query.select(*plain.columns))
    sorted_ = todo.repartition("l", "i", "j").sortWithinPartitions("l", "i", "j", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            listed, side, ids = rows.column(0)[0].as_py(), rows.column(3).to_numpy(), rows.column(4).to_numpy()
            x = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.float32).reshape(len(rows), dim)
            q, i = side != 1, side != 2
            if q.any() and i.any():
                a, b, sim = _compare(shared.value, listed, x[q], ids[q], x[i], ids[i], k, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim.astype(np.float64))], names=["a", "b", "similarity"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[s].tolist())
                if at is not None and key != at and held:
                    yield from flush()
                    held.clear()
                at = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from flush()

    return sorted_.mapInArrow(run, "a bigint, b bigint, similarity double")


def _samples(rows: DataFrame, large: dict[int, int], dim: int) -> dict[int, np.ndarray]:
    """About SAMPLE vectors of the large lists together, drawn by a hash of the id, as many a list as its share."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLE / sum(large.values()))
    some = rows.join(F.broadcast(spark.createDataFrame([(l,) for l in large], "l int")), "l", "left_semi")
    got = some.where(F.xxhash64("id", "l") < F.lit(min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1))).select("l", "id", "x").limit(2 * SAMPLE).toArrow()
    lists, ids = got.column(0).to_numpy(), got.column(1).to_numpy()
    x = np.frombuffer(b"".join(got.column(2).to_pylist()), np.float32).reshape(len(got), dim)
    out = {}
    for l in large:
        at = np.flatnonzero(lists == l)
        if len(at):
            out[l] = x[at[np.argsort(ids[at])]]
    return out


def _split(rows: DataFrame, shared, large: dict[int, int], dim: int) -> DataFrame:
    """Rows of large lists in the lists of their second level, others as they are."""
    keys = set(large)

    def run(batch: pa.RecordBatch):
        if not len(batch):
            return
        lists = batch.column(0).to_numpy()
        whole = np.isin(lists, list(keys), invert=True)
        if whole.any():
            yield batch.filter(pa.array(whole))
        for l in np.unique(lists[~whole]).tolist():
            some = batch.filter(pa.array(lists == l))
            if l not in shared.value.deeper:
                yield some
                continue
            first, means = shared.value.deeper[l]
            x = np.frombuffer(b"".join(some.column(2).to_pylist()), np.float32).reshape(len(some), dim)
            own = first + _probe(x, means, DEEPER)
            again = pa.array(np.repeat(np.arange(len(some)), own.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel().astype(np.int32)), some.column(1).take(again), some.column(2).take(again)], names=["l", "id", "x"])

    return arrow_map(rows, run, "l int, id bigint, x binary")


def _salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """The join of two tables on a key that most rows of the first may share; the second has few rows of each key."""
    salts = few.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salts, [key, "_s"]).drop("_s")


def most_similar(vectors: DataFrame, k: int = K, least: float = SIMILARITY) -> DataFrame:
    """(id, other, similarity): for every vector its k most similar others at or over the least similarity.

    `vectors` has a unique id and a usable embedding.
    """

    def scale(batch: pa.RecordBatch):
        n = len(batch)
        if n:
            x = _unit(batch.column(1).flatten().to_numpy().reshape(n, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))], names=["id", "embedding"])

    unit = cut(arrow_map(vectors.select(F.col("id").cast("bigint").alias("id"), "embedding"), scale, "id bigint, embedding array<float>"))
    h = F.struct(F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))
    groups = cut(unit.select("id", h.alias("_c")))
    sizes = groups.groupBy("_c").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # ids of a group that others may list: its k + 1 smallest; row_number <= k + 1 is limited before the shuffle
    w = Window.partitionBy("_c").orderBy("id")
    heads = groups.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1).select("_c", F.col("id").alias("head"))
    copied = cut(sizes.where("n > 1"))
    repeats = _salted(groups, copied.select("_c", "rep"), "_c", "id").where(F.col("id") != F.col("rep")).select("id")
    repeats = cut(repeats)
    few = F.broadcast(repeats) if repeats.count() <= SENT else repeats
    reps = cut(unit.join(few, "id", "left_anti"))
    n = reps.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "id bigint, other bigint, similarity double")
    near = similar(reps, fit(reps, n), k, least)
    # either side may have found a pair, in several lists; its cosine is that of the whole vectors each time
    both = F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    ways = cut(near.select(F.explode(both).alias("_w")).select("_w.*").groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    heads = heads.join(copied.select("_c", "rep"), "_c").select("rep", "head")
    # representatives' neighbours, spelled out by the smallest ids of their groups
    spelled = ways.join(heads.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("head", "b").alias("other"), "similarity")
    order = Window.partitionBy("a").orderBy(F.round("similarity", 9).desc(), "other")
    listed = spelled.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")
    single = listed.join(copied.select(F.col("rep").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), "other", "similarity")
    # members of a group of copies: the other copies first
    member = _salted(groups, copied.select("_c", "rep", "n"), "_c", "id").select("id", "rep", "n")
    own = _salted(member, heads, "rep", "id").where(F.col("id") != F.col("head")).select("id", F.col("head").alias("other"), F.lit(1.0).alias("similarity"))
    beyond = member.where(F.col("n") <= k).select("id", F.col("rep").alias("a")).join(listed, "a").select("id", "other", "similarity")
    again = Window.partitionBy("id").orderBy(F.round("similarity", 9).desc(), "other")
    many = own.union(beyond).withColumn("_rn", F.row_number().over(again)).where(F.col("_rn") <= k).drop("_rn")
    return single.union(many)


def batch_vectors(changelog: DataFrame, dim: int = DIM) -> DataFrame:
    """The live vectors of the batches: of each vec_id the insert with the earliest logged_at; deleted ids and unusable vectors are left out.

    Of inserts of one id that tie, the one that sorts first by its numbers stands.
    """
    deleted = changelog.where("op = 'delete' and vec_id is not null").select(F.col("vec_id").alias("id")).distinct()
    w = Window.partitionBy("id").orderBy(F.col("logged_at").asc_nulls_last(), "embedding")
    inserts = changelog.where("op = 'insert' and vec_id is not null").select(F.col("vec_id").alias("id"), "logged_at", "embedding")
    first = inserts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "embedding")
    return first.where(usable(F.col("embedding"), dim)).join(deleted, "id", "left_anti")


def passage_vectors(passages: DataFrame, dim: int = DIM) -> DataFrame:
    """The usable vectors of the passages; repeated rows are identical."""
    return passages.where(F.col("passage_id").isNotNull() & usable(F.col("embedding"), dim)).select(F.col("passage_id").alias("id"), "embedding").dropDuplicates(["id"])


def found(changelog: DataFrame, passages: DataFrame) -> DataFrame:
    """p1_found: pairs of one collection with a cosine of 0.85 at least, one among the 10 most similar of the other."""
    out = None
    for name, vectors in (("batch", batch_vectors(changelog)), ("passage", passage_vectors(passages))):
        near = most_similar(vectors)
        pairs = near.select(F.lit(name).alias("coll"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
        out = pairs if out is None else out.union(pairs)
    return out
