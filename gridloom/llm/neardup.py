"""Problem 7: near-duplicate records by generalised pigeonhole over minwise sketches.

A record's 5-character substrings are sketched by 128 minwise values. Values that agree together in unrelated
records are grouped into partitions, so that frequent boilerplate spoils few of them. Each partition gets a
threshold of its own: not probed, probed for agreement, or for agreement but for one value. A dynamic program
chooses the thresholds that cost the fewest estimated candidates, under a bound on the chance that a pair at the
similarity limit differs beyond every threshold. Records that meet in a probe and whose 128 sketch bits are close
enough are candidates; candidates are verified exactly.

The worst-case bound of the principle (thresholds that sum to the whole distance) would allow a third of all values
to differ and probe with one or two values only, which selects nothing; hence the bound is on probability.

Records with equal text are one representative until the end. Null texts and texts under the least length have no
row. Repeated rows of a page count once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import BASE, arrow_map, bounded_sample, codepoints, counted_pages, mix, pairs_within, squeeze, window_hashes
from gridloom.session import cut

WIDTH, SIMILARITY, LEAST_CHARS = 5, 0.7, 200
#: Minwise values: rounds of bins.
ROUNDS, BINS = 4, 32
VALUES = ROUNDS * BINS
#: Values of a partition, chance of missing a pair at the limit, and sketches of the sample that the estimates rest on.
GROUP, MISS, SAMPLE = 4, 1e-4, 4096
#: Candidates may differ in this many of the 128 bits: the mean at the limit and 4.5 deviations.
BITS = int(128 * (1 - SIMILARITY) / 2 + 4.5 * (128 * (1 - SIMILARITY) / 2 * (1 + SIMILARITY) / 2) ** 0.5)
#: Records of a probe's key from which they meet in pairs of blocks of about this size.
HOT = 4096
#: Parts of a class of copies that meet its links in turn.
PARTS = 8
#: Ids that are sent to every task at most (8 bytes each); beyond, texts are joined by shuffle.
SENT = 100_000

#: Least hash of each bin.
_EDGES = np.array([i * 2**64 // BINS for i in range(BINS)], np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all substrings of a width."""
    h = window_hashes(codepoints(text), width)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def sketch(hashes: np.ndarray) -> np.ndarray:
    """VALUES minwise values of 16 bits: in each round the least hash of each bin; empty bins borrow from a bin drawn by hash."""
    out = np.empty((ROUNDS, BINS), np.uint16)
    for r in range(ROUNDS):
        with np.errstate(over="ignore"):
            h = np.sort(mix(hashes + BASE * np.uint64(r + 1)))
        at = np.searchsorted(h, _EDGES)
        full = at < np.append(at[1:], len(h))
        value = h[np.minimum(at, len(h) - 1)]
        if not full.all():
            for i in np.flatnonzero(~full).tolist():
                j, step = i, 0
                while not full[j]:
                    step += 1
                    j = int(mix(np.array([i * 4096 + step + r], np.uint64))[0]) % BINS
                value[i] = value[j]
        out[r] = (mix(value) & np.uint64(0xFFFF)).astype(np.uint16)
    return out.ravel()


def sketches(docs: DataFrame, key: str, text: str, least: int = LEAST_CHARS) -> DataFrame:
    """(key, copy, sketch, b0, b1) of each record whose squeezed text is long enough."""

    def run(batch: pa.RecordBatch):
        ids, copies, values, bits = [], [], [], []
        for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = squeeze(value)
            if len(plain) < max(least, WIDTH):
                continue
            s = sketch(shingles(plain))
            ids.append(item)
            copies.append(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            values.append(s.tobytes())
            bits.append(np.packbits((s & 1).astype(np.uint8)))
        words = np.array(bits, np.uint8).reshape(-1, 16).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), pa.array(copies, pa.binary()), pa.array(values, pa.binary()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())],
            names=[key, "copy", "sketch", "b0", "b1"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.where(F.col(text).isNotNull()).select(key, text), run, f"{key} {kind}, copy binary, sketch binary, b0 bigint, b1 bigint")


def _meetings(keys: np.ndarray) -> int:
    """Pairs of equal keys."""
    _, counts = np.unique(keys, return_counts=True)
    return int((counts * (counts - 1) // 2).sum())


def _keys(values: np.ndarray, columns: list[int], skip: int | None, number: int) -> np.ndarray:
    """One 64-bit key a row from some columns of its sketch; `number` tells partitions and left-out columns apart."""
    with np.errstate(over="ignore"):
        key = np.full(len(values), np.uint64(number + 1) * BASE)
        for c in columns:
            if c != skip:
                key = mix(key ^ values[:, c].astype(np.uint64)) * BASE
    return key


def partitions(values: np.ndarray, size: int = GROUP) -> list[list[int]]:
    """Columns grouped so that those that agree together in unrelated rows are in one partition."""
    n, width = values.shape
    if n < 8:
        return [list(range(i, i + size)) for i in range(0, width, size)]
    rng = np.random.default_rng(7)
    left, right = rng.integers(0, n, 30000), rng.integers(0, n, 30000)
    agree = (values[left] == values[right])[left != right].astype(np.float32)
    rate = agree.mean(axis=0)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
    joint = (agree.T @ agree) / len(agree)
    together = (joint - np.outer(rate, rate)) / np.outer(spread, spread)
    open_, groups = set(range(width)), []
    while open_:
        first = max(open_, key=lambda c: (rate[c], -c))
        open_.remove(first)
        group = [first]
        while len(group) < size and open_:
            best = max(open_, key=lambda c: (float(together[group, c].sum()), -c))
            open_.remove(best)
            group.append(best)
        groups.append(group)
    return groups


def allocate(values: np.ndarray, groups: list[list[int]], similarity: float = SIMILARITY, miss: float = MISS) -> list[int]:
    """The threshold of each partition: -1 not probed, 0 all values agree, 1 all but one.

    A dynamic program over the partitions and the logarithm of the chance of a miss, in small units, finds the
    least sum of estimated candidates. Where even probing all partitions with threshold 1 misses more, as it can only at a lower
    similarity or with fewer partitions than the module's own, that is an error, for the bound couldn't be kept.
    """
    unit = 0.02
    need = int(np.ceil(-np.log(miss) / unit))
    options = []
    for number, group in enumerate(groups):
        same = _meetings(_keys(values, group, None, number))
        near = sum(_meetings(_keys(values, group, c, number)) for c in group) - (len(group) - 1) * same
        p0 = similarity ** len(group)
        p1 = p0 + len(group) * similarity ** (len(group) - 1) * (1 - similarity)
        # a key costs something besides its candidates: about a row of the sample for each 64 keys
        options.append([(-1, 0, 0.0), (0, int(-np.log(1 - p0) / unit), same + len(values) / 64), (1, int(-np.log(1 - p1) / unit), near + len(group) * len(values) / 64)])
    best = np.full(need + 1, np.inf)
    best[0] = 0
    choice = []
    for some in options:
        new, took = np.full(need + 1, np.inf), np.zeros(need + 1, np.int8)
        where = np.zeros(need + 1, np.int64)
        for t, gain, cost in some:
            for g in np.flatnonzero(np.isfinite(best)).tolist():
                to = min(need, g + gain)
                if best[g] + cost < new[to]:
                    new[to], took[to], where[to] = best[g] + cost, t, g
        choice.append((took, where))
        best = new
    if not np.isfinite(best[need]):
        raise ValueError(f"no thresholds keep the chance of a miss under {miss}")
    at, out = need, []
    for took, where in reversed(choice):
        out.append(int(took[at]))
        at = int(where[at])
    return out[::-1]


def candidates(reps: DataFrame, sample: np.ndarray, most_bits: int = BITS) -> DataFrame:
    """(a, b), a < b: representatives that meet in a probe and are close in their bits; no pair twice."""
    groups = partitions(sample)
    thresholds = allocate(sample, groups)
    probes = [(number, group, skip) for number, (group, t) in enumerate(zip(groups, thresholds, strict=True)) for skip in ([None] if t == 0 else group if t == 1 else [])]

    def run(batch: pa.RecordBatch):
        n = len(batch)
        if not n:
            return
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, VALUES)
        for i in range(0, len(probes), 16):
            part = probes[i : i + 16]
            keys = np.concatenate([_keys(values, group, skip, number * 64 + (0 if skip is None else 1 + group.index(skip))) for number, group, skip in part]).view(np.int64)
            again = [pa.chunked_array([batch.column(c)] * len(part)).combine_chunks() for c in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *again], names=["k", "a", "b0", "b1"])

    rows = arrow_map(reps.select("rep", "sketch", "b0", "b1"), run, "k bigint, a bigint, b0 bigint, b1 bigint")
    # near copies share many keys: a key of many records is met block by block, so no task holds them all
    hot = cut(rows.groupBy("k").count().where(F.col("count") > HOT).select("k", F.ceil(F.col("count") / HOT).cast("int").alias("n")))
    if hot.isEmpty():
        spread = rows.select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("o"), "a", "b0", "b1")
    else:
        known = F.broadcast(hot) if hot.count() <= SENT else hot
        n = F.coalesce("n", F.lit(1))
        own = F.pmod(F.xxhash64("a"), n.cast("bigint")).cast("int")
        placed = rows.join(known, "k", "left").withColumn("o", own).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
        spread = placed.select("k", F.least("o", "j").alias("i"), F.greatest("o", "j").alias("j"), "o", "a", "b0", "b1")
    other = spread.select("k", "i", "j", F.col("o").alias("p"), F.col("a").alias("b"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))
    near = F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1"))) <= most_bits
    # within a block by the records' order, between two blocks from the one to the other
    ordered = F.when(F.col("i") == F.col("j"), F.col("a") < F.col("b")).otherwise((F.col("o") == F.col("i")) & (F.col("p") == F.col("j")))
    return spread.join(other, ["k", "i", "j"]).where(ordered & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.sort(np.concatenate([a, b]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared) if len(both) else 0.0


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs at or over the limit, from their whole texts."""
    ids = cut(pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() <= SENT else ids
    texts = cut(counted_pages(docs.join(few, key, "left_semi"), text))
    left = pairs.join(texts.select(F.col(key).alias("a"), F.col(text).alias("ta")), "a")
    both = left.join(texts.select(F.col(key).alias("b"), F.col(text).alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batch: pa.RecordBatch):
        held: dict[int, np.ndarray] = {}

        def of(item: int, value: str) -> np.ndarray:
            if item not in held:
                if len(held) > 256:
                    held.clear()
                held[item] = shingles(squeeze(value))
            return held[item]

        scores = [_jaccard(of(a, ta), of(b, tb)) for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["a", "b", "similarity"])

    return arrow_map(both, run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similarity - 1e-12)


def near_duplicates(pages: DataFrame, key: str = "page_id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a, b, similarity), and membership (key, rep)."""
    all_ = cut(sketches(counted_pages(pages, text), key, text))
    members = all_.select(key, "copy").join(all_.groupBy("copy").agg(F.min(key).alias("rep")), "copy").select(key, "rep")
    members = cut(members)
    reps = cut(all_.join(members.where(F.col(key) == F.col("rep")), key).select("rep", "sketch", "b0", "b1"))
    # the sample is bounded; it sets the cost of probes, never what is found
    sampled = bounded_sample(reps.select("rep", "sketch"), "rep", SAMPLE).select("sketch").collect()
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in sampled), np.uint16).reshape(-1, VALUES)
    pairs = cut(candidates(reps, sample))
    return verified(pairs, pages, key, text), members


def found(pages: DataFrame) -> DataFrame:
    """p7_found: the pairs of pages with at least 0.7 of their 5-character substrings in common."""
    pairs, members = near_duplicates(pages)
    pairs = cut(pairs)
    within = pairs_within(members, "rep", "page_id").select(F.col("a").alias("page_a"), F.col("b").alias("page_b"))
    # a class of copies that is linked to many others is met by a hashed part of its members at a time
    part = F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int")
    links = pairs.select("a", "b").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    x = members.select(F.col("page_id").alias("x"), F.col("rep").alias("a"), part.alias("_s"))
    y = members.select(F.col("page_id").alias("y"), F.col("rep").alias("b"))
    both = links.join(x, ["a", "_s"]).select("x", "b").join(y, "b")
    return within.union(both.select(F.least("x", "y").alias("page_a"), F.greatest("x", "y").alias("page_b")))


def classes(pages: DataFrame) -> DataFrame:
    """(page_id, class_id, n_links): each page's class, its smallest page, and the number of its representative's links to other texts."""
    from gridloom.operators.components import connected_components

    pairs, members = near_duplicates(pages)
    pairs = cut(pairs)
    labels = connected_components(pairs)
    degree = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select("page_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
