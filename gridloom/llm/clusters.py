"""Problem 6: similarity clusters by neighbour descent and modularity communities.

Each record's distinct terms are sketched by 256 minwise bits, from which any two rows' similarity can be estimated
where they meet. A forest of prefix orders gives each record first neighbours; neighbour descent then compares the
neighbours of each record with each other and keeps its best K, round by round. All pairs that ever came close
are verified on whole term sets; verified links form the graph. Links between components that descent left apart are
found exactly, by a join on the rarest terms, so the components are those of all links. Communities form by modularity
gain, level by level, and are described by size and the members of highest internal weighted degree. What is joined
through other records follows from the communities and the links that leave them.

Records of equal term sets are one representative until the end. Records with null content or fewer than the least
number of distinct terms have no row. Repeated rows of a page count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from gridloom.llm.common import BASE, arrow_map, bounded_sample, codepoints, counted_pages, mix, pairs_within, term_points
from gridloom.operators.components import connected_components
from gridloom.session import cut, forget

SIMILARITY, LEAST_TERMS = 0.5, 30
#: Minwise values (a bit of each is kept), orders of the forest, values of an order's prefix, followers each row is compared with.
VALUES, ORDERS, PREFIX, AHEAD = 256, 24, 6, 4
#: Neighbours of a record in the graph, rounds of descent, share of neighbours whose change goes on, and the estimated similarity under which a pair isn't close.
K, ROUNDS, CHANGE, FLOOR = 24, 3, 0.001, 0.36
#: Ids that are sent to every task at most (8 bytes each); beyond, sets are joined by shuffle.
SENT = 100_000
#: Slots that terms are counted in, to order them by rarity, and records of a slot from which its terms are compared in blocks.
SLOTS, HOT = 1 << 20, 4096
#: Links of a component that one task may hold.
LOCAL = 1 << 17
#: Pairs that a task compares at once.
STEP = 1 << 19
#: Rows of `bridges` that a task looks at together, beside those of one term.
TOGETHER = 1 << 15

_WORDS = VALUES // 64
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * BASE) | np.uint64(1)
#: Bits in which a close pair of descent may differ; links over it are found by `bridges` if they join components.
_MOST = int(VALUES * (1 - FLOOR) / 2)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """VALUES minwise values of a set of 64-bit hashes, mixed."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            part = hashes[i : i + 512, None] * _SEEDS[None, :]
            np.minimum(least, part.min(axis=0), out=least)
    return mix(least)


#: Code points of a term up to which all terms of a batch are hashed at once; longer ones one by one.
LONG = 48


def hashed_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each lower-cased text as ascending 64-bit hashes, text by text, and how many each has.

    The terms are those of TERM.findall, found in whole arrays; three code points at a time are mixed into a term's hash.
    """
    cps = codepoints("\n".join(texts) + "\n")
    inside = np.zeros(len(cps) + 1, bool)
    np.take(term_points(), cps, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, width = edges[::2], edges[1::2] - edges[::2]
    padded = np.append(cps, np.zeros(3, np.uint32)).astype(np.uint64)
    hashes = width.astype(np.uint64) * BASE
    at = np.flatnonzero(width <= LONG)
    for k in range(0, LONG, 3):
        at = at[width[at] > k]
        if not len(at):
            break
        place, left = first[at] + k, width[at] - k
        # 21 bits a code point
        word = padded[place] | padded[place + 1] * (left > 1) << np.uint64(21) | padded[place + 2] * (left > 2) << np.uint64(42)
        hashes[at] = mix(hashes[at] ^ word)
    for i in np.flatnonzero(width > LONG).tolist():
        hashes[i] = xxh3_64_intdigest(cps[first[i] : first[i] + width[i]].tobytes())
    hashes = hashes.view(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.searchsorted(first, np.append(0, np.cumsum(sizes)))
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[starts[:-1][starts[:-1] < len(hashes)]] = True
    return hashes[new], np.diff(np.append(0, np.cumsum(new))[starts])


def term_sets(docs: DataFrame, key: str, *texts: str, least: int = LEAST_TERMS) -> DataFrame:
    """(key, terms): the distinct terms of a record's texts, joined by blanks, as ascending 64-bit hashes."""

    def run(batch: pa.RecordBatch):
        columns = [c.to_pylist() for c in batch.columns[1:]]
        terms, sizes = hashed_terms([" ".join(v or "" for v in values).lower() for values in zip(*columns, strict=True)])
        kept = sizes >= least
        offsets = pa.array(np.append(0, np.cumsum(sizes[kept])).astype(np.int32))
        sets = pa.ListArray.from_arrays(offsets, pa.array(terms[np.repeat(kept, sizes)]))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), sets], names=[key, "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, *texts), run, f"{key} {kind}, terms array<bigint>")


def _differ(left: str, right: str):
    """Bits in which two sketches differ."""
    out = None
    for i in range(_WORDS):
        n = F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}")))
        out = n if out is None else out + n
    return out


_BITS = [f"s{i}" for i in range(_WORDS)]
_BITS_SCHEMA = ", ".join(f"{c} bigint" for c in _BITS)


def sketches(sets: DataFrame) -> DataFrame:
    """(rep, p, s0..): of each record the bits, and in p the prefixes, two words each, that the orders of the forest sort it by; a written table."""

    def run(batch: pa.RecordBatch):
        n = len(batch)
        if not n:
            return
        terms, offsets = _flat(batch.column(1))
        values = np.stack([minwise(terms[i:j].view(np.uint64)) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
        bits = np.packbits((values & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        rng = np.random.default_rng(11)
        prefixes = np.empty((n, ORDERS, 2), np.int64)
        for order in range(ORDERS):
            picked = rng.permutation(VALUES)[:PREFIX]
            # 20 bits a value, three values a word
            for w in range(2):
                word = np.zeros(n, np.uint64)
                for c in picked[3 * w : 3 * w + 3]:
                    word = word << np.uint64(20) | (values[:, c] >> np.uint64(44))
                prefixes[:, order, w] = word.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), _rows(prefixes.reshape(n, -1)), *(pa.array(bits[:, i].copy()) for i in range(_WORDS))], names=["rep", "p", *_BITS])

    # written, for it is read in every round
    return cut(arrow_map(sets, run, f"rep bigint, p binary, {_BITS_SCHEMA}"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    """The values of a column of lists, and where each list begins and ends."""
    return lists.values.to_numpy(), lists.offsets.to_pylist()


def _rows(rows: np.ndarray) -> pa.Array:
    """A binary column of the bytes of each row of a matrix."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


#: Rows of an order of the forest that one task sorts, about; and ranges of an order at most, whose bounds are sent to every task.
RANGE, RANGES = 1 << 18, 1 << 12
#: A record in an order of the forest.
_PLACE = np.dtype([("o", "<i4"), ("p0", "<i8"), ("p1", "<i8"), ("rep", "<i8"), ("s", "<u8", (_WORDS,))])


def first_pairs(sketched: DataFrame) -> DataFrame:
    """(a, b, d): rows that follow each other in some order and are close, and in how many bits they differ; a written table.

    The orders are cut into ranges of like size, so no group of equal prefixes meets in one task, and each row is
    compared with AHEAD followers whatever the size of its group. The first and last AHEAD rows of every range
    are compared once more across the ranges' ends. Rows travel packed, those of a batch and a range as one.
    """
    names = ["a", "b", "d", "edge"]
    parts = max(int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    n = sketched.count()
    each = min(max(1, -(-parts // ORDERS), -(-n // RANGE)), RANGES)
    # a range is a task's; whole orders may share one
    tasks = ORDERS * each if each > 1 else min(ORDERS, max(parts, -(-ORDERS * n // RANGE)))
    bounds = sketched.sparkSession.sparkContext.broadcast(_bounds(sketched, each))

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = len(batch)
        if not n:
            return
        rows = np.empty((ORDERS, n), _PLACE)
        prefixes = _bytes(batch.column(1)).view(np.int64).reshape(n, ORDERS, 2)
        rows["o"], rows["rep"] = np.arange(ORDERS)[:, None], batch.column(0).to_numpy()
        rows["p0"], rows["p1"] = prefixes[:, :, 0].T, prefixes[:, :, 1].T
        rows["s"] = np.stack([batch.column(2 + i).to_numpy() for i in range(_WORDS)], axis=1).view(np.uint64)
        groups, packed = [], []
        for o in range(ORDERS):
            place = np.zeros(n, np.int64) if each == 1 else _range(rows[o], bounds.value[o])
            order = np.argsort(place, kind="stable")
            place, mine = place[order], rows[o][order]
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            groups += ((o * each + place[starts]) % tasks).tolist()
            packed += [mine[i:j].tobytes() for i, j in zip(starts, np.append(starts[1:], n), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(packed, pa.binary())], names=["g", "x"])

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Close pairs of sorted rows with their followers."""
        for step in range(1, min(AHEAD, len(rows) - 1) + 1):
            one, two = rows[:-step], rows[step:]
            d = np.bitwise_count(one["s"] ^ two["s"]).sum(axis=1)
            ok = (one["o"] == two["o"]) & (d <= _MOST) & (one["rep"] != two["rep"])
            a, b, d = one["rep"][ok], two["rep"][ok], d[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32)), pa.nulls(len(a), pa.binary())], names=names)

    def gathered(batches: Iterator[pa.RecordBatch], column: int) -> np.ndarray:
        held = [_bytes(x.column(column)) for x in batches if len(x)]
        rows = np.concatenate(held).view(_PLACE) if held else np.empty(0, _PLACE)
        return rows[_sorted(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches, 1)
        yield from pairs(rows)
        if each > 1 and len(rows):
            ends = np.append(rows[:AHEAD], rows[max(AHEAD, len(rows) - AHEAD) :])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())), pa.array([ends.tobytes()], pa.binary())], names=names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs(gathered(batches, 3))

    schema = "a bigint, b bigint, d int, edge binary"
    near = arrow_map(sketched, spread, "g int, x binary").repartitionById(tasks, "g").mapInArrow(run, schema)
    if each == 1:
        return cut(near.select("a", "b", "d").distinct())
    near = cut(near)
    # at most 2 x AHEAD rows a range
    more = near.where("edge is not null").coalesce(1).mapInArrow(across, schema)
    out = cut(near.where("edge is null").union(more).select("a", "b", "d").distinct())
    forget(near)
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The order of rows by order, prefix and record."""
    return np.lexsort((rows["rep"], rows["p1"], rows["p0"], rows["o"]))


def _bounds(sketched: DataFrame, each: int) -> np.ndarray:
    """For every order the rows at which its ranges but the first begin, from a sample."""
    if each == 1:
        return np.empty((ORDERS, 0), _PLACE)
    drawn = bounded_sample(sketched.select("rep", "p"), "rep", min(32 * each, 32_768)).toArrow().combine_chunks()
    n = len(drawn)
    rows = np.zeros((ORDERS, n), _PLACE)
    if n:
        prefixes = np.frombuffer(b"".join(drawn.column("p").to_pylist()), np.int64).reshape(n, ORDERS, 2)
        rows["rep"], rows["p0"], rows["p1"] = drawn.column("rep").to_numpy(), prefixes[:, :, 0].T, prefixes[:, :, 1].T
    at = np.unique(np.arange(1, each) * n // each) if n else np.empty(0, np.int64)
    return np.stack([x[_sorted(x)][at] for x in rows])


def _range(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of an order's bounds are at or before each row."""
    whole = np.append(bounds, rows)
    order = np.lexsort((np.arange(len(whole)), whole["rep"], whole["p1"], whole["p0"]))
    out = np.empty(len(whole), np.int64)
    out[order] = np.cumsum(order < len(bounds))
    return out[len(bounds) :]


def _joined(tail: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if tail is None or not len(tail) else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]


def _both_ways(pairs: DataFrame, k: int = K) -> DataFrame:
    """(u, v, new): the K nearest neighbours of each record, from pairs in either direction."""
    ways = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "d", "new").union(pairs.select("b", "a", "d", "new"))
    w = Window.partitionBy("u").orderBy("d", "v")
    return ways.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("u", "v", "new")


def descend(pairs: DataFrame, sketched: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """All close pairs after rounds of neighbour descent: neighbours of one record are compared with each other.

    A record brings at most K x K pairs to a round, hubs included. Two neighbours that were a record's before the last round have
    been compared then, for a neighbour only ever drops out of the K nearest; so one of two must be new. Ends early once a round adds
    fewer pairs than CHANGE of all records' K neighbours; links that it leaves between components are found by `bridges`. `pairs` is a
    written table, which is removed once it isn't needed.
    """
    bits = sketched.select(F.col("rep").alias("v"), *_BITS)
    found, written = pairs.withColumn("new", F.lit(True)), pairs
    n, least = pairs.count(), CHANGE * K * sketched.count()
    for _ in range(rounds):
        near = _both_ways(found).join(bits, "v")
        one = near.select("u", F.col("v").alias("a"), F.col("new").alias("xn"), *(F.col(f"s{i}").alias(f"x{i}") for i in range(_WORDS)))
        two = near.select("u", F.col("v").alias("b"), F.col("new").alias("yn"), *(F.col(f"s{i}").alias(f"y{i}") for i in range(_WORDS)))
        d = _differ("x", "y")
        met = one.join(two, "u").where((F.col("a") < F.col("b")) & (F.col("xn") | F.col("yn")) & (d <= _MOST)).select("a", "b", d.cast("int").alias("d"), F.lit(True).alias("new"))
        whole = found.withColumn("new", F.lit(False)).union(met).groupBy("a", "b").agg(F.min("d").alias("d"), F.bool_and("new").alias("new"))
        old, found = written, cut(whole)
        written = found
        forget(old)
        before, n = n, found.count()
        if n - before <= least:
            break
    return found


def links(sets: DataFrame, key: str = "page_id", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links of representatives (a, b, similarity), membership (key, rep), and components (node, component) of the links.

    `sets` is from a written table.
    """
    copy = F.struct(F.xxhash64("terms").alias("h"), F.hash("terms").alias("g"), F.size("terms").alias("n"))
    marked = sets.select(key, copy.alias("_c"))
    members = cut(marked.join(marked.groupBy("_c").agg(F.min(key).alias("rep")), "_c").select(key, "rep"))
    # term sets are read several times: copies are left out by sending their ids, or once by a shuffle where they are many
    copies = cut(members.where(F.col(key) != F.col("rep")).select(key))
    few = copies.count() <= SENT
    own = sets.join(F.broadcast(copies) if few else copies, key, "left_anti").select(F.col(key).alias("rep"), "terms")
    own = own if few else cut(own)
    sketched = sketches(own)
    close = descend(first_pairs(sketched), sketched)
    forget(sketched)
    graph = _verified(close, own, similarity)
    forget(close)
    parts = cut(connected_components(graph))
    apart = _verified(cut(bridges(own, parts, similarity)), own, similarity)
    if apart.isEmpty():
        return graph, members, parts
    # a bridge's end may have had no link before
    ends = apart.select(F.col("a").alias("node")).union(apart.select("b")).distinct()
    label = ends.join(parts, "node", "full").select("node", F.coalesce("component", "node").alias("community"))
    return cut(graph.union(apart)), members, cut(joined(apart, label))


def _verified(close: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the similarity on whole term sets, as a written table. `close` is from a written table."""
    close = close.select("a", "b")
    ids = cut(close.select(F.col("a").alias("rep")).union(close.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() <= SENT else ids
    wanted = own.join(few, "rep", "left_semi")
    left = close.join(wanted.select(F.col("rep").alias("a"), F.col("terms").alias("ta")), "a")
    both = left.join(wanted.select(F.col("rep").alias("b"), F.col("terms").alias("tb")), "b")
    # sets of too different sizes can't reach it
    both = both.where(F.least(F.size("ta"), F.size("tb")) >= F.greatest(F.size("ta"), F.size("tb")) * similarity - 1e-6)

    def run(batch: pa.RecordBatch):
        scores = np.zeros(len(batch))
        (x, xs), (y, ys) = _flat(batch.column(2)), _flat(batch.column(3))
        for i in range(len(batch)):
            both = np.concatenate([x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            scores[i] = shared / (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["a", "b", "similarity"])

    scored = arrow_map(both.select("a", "b", "ta", "tb"), run, "a bigint, b bigint, similarity double")
    return cut(scored.where(F.col("similarity") >= similarity))


def _slots(own: DataFrame) -> np.ndarray:
    """How many records hold a term of each slot, a slot being the upper bits of a term's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            counts += np.bincount(_slot(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])

    # at most SLOTS rows reach the driver
    got = own.select("terms").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _parities(terms: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of records with so many terms each, one after another: a number of words, the records that have it, and their bits.

    A bit is the parity of the number of terms in a group; there are at least 2.5 groups a term, in a power of 2 of 64-bit words.
    """
    words = 1 << np.maximum(2, np.ceil(np.log2(np.maximum(sizes, 1) * 2.5 / 64)).astype(np.int64))
    for w in np.unique(words).tolist():
        some = np.flatnonzero(words == w)
        inside = np.repeat(words == w, sizes)
        at = np.repeat(np.arange(len(some)), sizes[some]) * (w * 64) + (terms[inside] & np.uint64(w * 64 - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(some) * w * 64) & 1
        yield w, some, np.packbits(odd.astype(np.uint8)).reshape(len(some), w * 8)


#: What a record sends to each of its terms, before its parities.
_HEAD = np.dtype([("c", "<i8"), ("rep", "<i8"), ("side", "<i4"), ("size", "<i4"), ("place", "<i4")])


class _Parities:
    """The parities of a batch of records (their bytes one after another), folded to a common number of groups on demand."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.words = (ends - starts) // 8
        self.folded: dict[int, np.ndarray] = {}
        self.groups = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.groups[w] = np.ascontiguousarray(data[starts[at][:, None] + np.arange(8 * w)]).view(np.uint64)

    def _of(self, words: int) -> np.ndarray:
        """All records' parities in so many words; rows of records with fewer are empty."""
        if words not in self.folded:
            out = np.zeros((len(self.words), words), np.uint64)
            for w, held in self.groups.items():
                if w >= words:
                    out[self.words == w] = np.bitwise_xor.reduce(held.reshape(len(held), w // words, words), axis=1)
            self.folded[words] = out
        return self.folded[words]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many groups pairs of records differ: no more than the terms that only one of the two holds."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.words[a], self.words[b])
        for w in np.unique(least).tolist():
            at = np.flatnonzero(least == w)
            both = self._of(w)
            out[at] = np.bitwise_count(both[a[at]] ^ both[b[at]]).sum(axis=1)
        return out


def bridges(own: DataFrame, label: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): every pair of different components that can reach the similarity, and few others.

    With terms in one order for all records, rarest first, two such records share a term within the first
    size - ceil(similarity x size) + 1 of either. A pair that meets in such a term is dropped only where its sizes, the
    term's places (for its first shared term) or the parities of groups of terms prove it to be under the similarity: each
    parity that differs stands for a term that only one holds. Terms of hot slots are compared in pairs of blocks.
    """
    counts = own.sparkSession.sparkContext.broadcast(_slots(own))  # SLOTS numbers, whatever the input

    def spread(batch: pa.RecordBatch):
        if not len(batch):
            return
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        terms = batch.column(2).flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(batch)), sizes)
        held = counts.value[_slot(terms)]
        order = np.lexsort((terms, held, row))
        place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
        own_terms, own_held = terms[order], held[order]
        at = np.flatnonzero((place < prefix[row]) & (own_held > 1))  # a term of one record meets nobody
        blocks = -(-own_held[at] // HOT)
        reps = batch.column(0).to_numpy()
        mine = ((mix(reps.view(np.uint64)) % np.uint64(1 << 31)).astype(np.int64))[row[at]] % blocks
        again = np.repeat(np.arange(len(at)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at, mine = at[again], mine[again]
        head = np.empty(len(at), _HEAD)
        head["c"], head["rep"], head["size"], head["place"] = batch.column(1).to_numpy()[row[at]], reps[row[at]], sizes[row[at]], place[at]
        head["side"] = np.where(mine == other, 0, np.where(mine < other, 1, 2))
        pair = np.minimum(mine, other).astype(np.uint64) << np.uint64(32) | np.maximum(mine, other).astype(np.uint64)
        with np.errstate(over="ignore"):
            # a term and a pair of blocks; should two keys be equal, their records are compared for nothing
            keys = mix(own_terms[at] + pair * BASE).view(np.int64)
        bytes_ = head.view(np.uint8).reshape(len(at), _HEAD.itemsize)
        for words, some, bits in _parities(terms, sizes):
            number = np.full(len(batch), -1)
            number[some] = np.arange(len(some))
            mine = np.flatnonzero(number[row[at]] >= 0)
            packed = np.concatenate([bytes_[mine], bits[number[row[at[mine]]]]], axis=1)
            offsets = np.arange(len(mine) + 1, dtype=np.int32) * packed.shape[1]
            column = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys[mine]), column], names=["k", "x"])

    marked = own.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("c"), "terms")
    sorted_ = arrow_map(marked, spread, "k bigint, x binary").repartition("k").sortWithinPartitions("k")

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Pairs within whole groups of one key."""
        column = rows.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        head = np.ascontiguousarray(data[offsets[:-1, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).ravel()
        k = rows.column(0).to_numpy()
        order = np.lexsort((head["c"], head["side"], k))
        k, head = k[order], head[order]
        c, rep, side, size, place = (np.ascontiguousarray(head[f]) for f in ("c", "rep", "side", "size", "place"))
        parities = _Parities(data, offsets[:-1][order] + _HEAD.itemsize, offsets[1:][order])
        n = len(k)
        new = np.concatenate([[True], k[1:] != k[:-1]])
        last = lambda starts: np.append(starts[1:], n)[np.searchsorted(starts, np.arange(n), side="right") - 1]
        end = last(np.flatnonzero(new))
        sides = last(np.flatnonzero(new | np.concatenate([[True], side[1:] != side[:-1]])))
        runs = last(np.flatnonzero(new | np.concatenate([[True], (side[1:] != side[:-1]) | (c[1:] != c[:-1])])))
        # in one block a record meets those of later components, in two the records of the other block
        low = np.where(side == 0, runs, np.where(side == 1, sides, end))
        many = np.cumsum(end - low)
        s = 0
        while s < n:
            e = max(s + 1, int(np.searchsorted(many, (many[s - 1] if s else 0) + STEP, side="right")))
            width = (end - low)[s:e]
            a = np.repeat(np.arange(s, e), width)
            b = np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width) + low[a]
            both = size[a] + size[b]
            need = both * (similarity / (1 + similarity)) - 1e-6
            ok = (np.minimum(size[a] - place[a], size[b] - place[b]) >= need) & (np.minimum(size[a], size[b]) >= need) & (c[a] != c[b])
            a, b, both = a[ok], b[ok], both[ok]
            ok = parities.differ(a, b) <= both * ((1 - similarity) / (1 + similarity)) + 1e-6
            x, y = rep[a[ok]], rep[b[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            s = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= TOGETHER:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                k = whole.column(0).to_numpy()
                rest = int(np.searchsorted(k, k[-1]))
                if rest:
                    yield from compare(whole.slice(0, rest))
                held = [whole.slice(rest)]
                size = len(whole) - rest
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return sorted_.mapInArrow(run, "a bigint, b bigint").dropDuplicates(["a", "b"])


def communities(graph: DataFrame, parts: DataFrame | None = None, local: int = LOCAL, rounds: int = 32) -> DataFrame:
    """(node, community) of every node of weighted links (a, b, similarity), by moves of greatest modularity gain; a written table.

    Nodes move between their neighbours' communities until none can gain; then communities become the nodes of the
    next level, until a level joins none. A node only ever moves along links, so a community never
    spans two components (`parts`: node, component). A component of at most `local` links is
    worked on by one task, node by node. In larger ones all nodes move at once, in each round a hashed half of them, so
    neighbours don't swap for ever; a level of more than `rounds` rounds goes on to the next as it is. Ties go to the smaller community.
    """
    parts = connected_components(graph) if parts is None else parts
    placed = cut(graph.join(parts.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b", F.col("similarity").alias("w")))
    whole = placed.agg(F.sum("w")).first()[0] or 0.0
    sizes = placed.groupBy("component").count()
    large = cut(sizes.where(F.col("count") > local).select("component"))
    small = placed.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None

        def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
            c, a, b, w = (rows.column(k).to_numpy() for k in range(4))
            nodes, labels = [], []
            edges = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                for node, label in _louvain(a[s:e].tolist(), b[s:e].tolist(), w[s:e].tolist(), whole, 8 * rounds).items():
                    nodes.append(node)
                    labels.append(label)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "community"])

        for batch in batches:
            if not len(batch):
                continue
            held = _joined(tail, batch)
            c = held.column(0).to_numpy()
            rest = int(np.searchsorted(c, c[-1]))
            if rest:
                yield solve(held.slice(0, rest))
            tail = held.slice(rest)
        if tail is not None:
            yield solve(tail)

    label = small.mapInArrow(run, "node bigint, community bigint")
    if large.isEmpty():
        return cut(label)
    return cut(label.union(_by_rounds(placed.join(large, "component", "left_semi"), whole, rounds)))


def _louvain(a: list[int], b: list[int], w: list[float], whole: float, passes: int) -> dict[int, int]:
    """The community of each node of one component's links; `whole` is the weight of all links of the graph.

    A level ends after so many passes over its nodes, should rounding keep nodes moving; the last level is the one that joins none.
    """
    near: dict[int, dict[int, float]] = {}
    for x, y, z in zip(a, b, w, strict=True):
        near.setdefault(x, {})[y] = z
        near.setdefault(y, {})[x] = z
    degree = {x: sum(v.values()) for x, v in near.items()}
    label = {x: x for x in near}
    while True:
        own, volume = {x: x for x in near}, dict(degree)
        for _ in range(passes):
            going = False
            for x in sorted(near):
                at, k = own[x], degree[x]
                towards = {at: 0.0}
                for y, z in near[x].items():
                    if y != x:
                        towards[own[y]] = towards.get(own[y], 0.0) + z
                volume[at] -= k
                gain = {c: round(z - k * volume[c] / (2 * whole), 9) for c, z in towards.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] > gain[at]:
                    own[x], going = best, True
                volume[own[x]] += k
            if not going:
                break
        if len(set(own.values())) == len(near):
            return label
        label = {x: own[c] for x, c in label.items()}
        up: dict[int, dict[int, float]] = {}
        for x, v in near.items():
            row = up.setdefault(own[x], {})
            for y, z in v.items():
                row[own[y]] = row.get(own[y], 0.0) + z
        near = up
        degree = {x: sum(v.values()) for x, v in near.items()}


def _by_rounds(links: DataFrame, whole: float, rounds: int) -> DataFrame:
    """(node, community) of components that no task holds. `links` is (a, b, w)."""
    ways = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(links.select("b", "a", "w")))
    label = None
    while True:
        own = _level(ways, 2 * whole, rounds)
        joins = own.select("community").distinct().count() < own.count()
        if label is None:
            label = own
        elif joins:
            old, label = label, cut(label.join(own.select(F.col("node").alias("community"), F.col("community").alias("_up")), "community").select("node", F.col("_up").alias("community")))
            forget(old)
        if not joins:
            return label
        u, v = (own.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
        old, ways = ways, cut(ways.join(u, "u").join(v, "v").groupBy("cu", "cv").agg(F.sum("w").alias("w")).select(F.col("cu").alias("u"), F.col("cv").alias("v"), "w"))
        forget(old)
        if own is not label:
            forget(own)


#: Copies of a community's volume, so that a community of a third of all nodes isn't joined in one task.
_SALTS = 16


def _level(ways: DataFrame, twice: float, rounds: int) -> DataFrame:
    """(node, community) after moves within one level. `ways` has every link both ways, and loops."""
    degree = cut(ways.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("deg")))
    label = cut(degree.select("node", F.col("node").alias("community"), F.lit(False).alias("wants")))
    for r in range(rounds):
        here = label.select("node", "community").join(degree, "node")
        volume = here.groupBy("community").agg(F.sum("deg").alias("vol")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        towards = ways.where("u <> v").join(label.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
        options = towards.union(here.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        options = options.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(volume, ["community", "_s"]).join(here.withColumnRenamed("community", "_own"), "node")
        stays = F.col("community") == F.col("_own")
        gain = F.round(F.col("w") - F.col("deg") * (F.col("vol") - F.when(stays, F.col("deg")).otherwise(0.0)) / F.lit(twice), 9)
        best = options.groupBy("node").agg(F.max_by("community", F.struct(gain, -F.col("community"))).alias("_best"), F.max(gain).alias("_gain"), F.max(F.when(stays, gain)).alias("_stay"), F.first("_own").alias("_own"))
        wants = F.col("_gain") > F.col("_stay")
        moves = wants & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        old, label = label, cut(best.select("node", F.when(moves, F.col("_best")).otherwise(F.col("_own")).alias("community"), wants.alias("wants")))
        forget(old)
        if label.where("wants").isEmpty():
            break
    return label.select("node", "community")


def modularity(graph: DataFrame, label: DataFrame) -> float:
    """Of a labelling (node, community) of links (a, b, similarity); 0 without links."""
    ends = graph.join(label.select(F.col("node").alias("a"), F.col("community").alias("_ca")), "a").join(label.select(F.col("node").alias("b"), F.col("community").alias("_cb")), "b")
    inside, whole = ends.agg(F.sum(F.when(F.col("_ca") == F.col("_cb"), F.col("similarity"))), F.sum("similarity")).first()
    if not whole:
        return 0.0
    volume = ends.select(F.col("_ca").alias("c"), "similarity").union(ends.select("_cb", "similarity")).groupBy("c").agg(F.sum("similarity").alias("vol"))
    return (inside or 0.0) / whole - volume.agg(F.sum(F.pow("vol", F.lit(2)))).first()[0] / (2 * whole) ** 2


def joined(graph: DataFrame, label: DataFrame) -> DataFrame:
    """(node, component): communities that a link joins, directly or through others, are one component."""
    a, b = (label.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    between = graph.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    between = cut(between)
    if between.isEmpty():
        return label.withColumnRenamed("community", "component")
    whole = connected_components(between)
    return label.join(whole.select(F.col("node").alias("community"), "component"), "community", "left").select("node", F.coalesce("component", "community").alias("component"))


def clusters(pages: DataFrame, typical: int = 3) -> DataFrame:
    """(community, n_members, rank, page_id, weight): each community's size and its members of highest internal weighted degree.

    A representative's copies count as members at full weight; ties go to the smaller page. The community's id is its smallest page.
    """
    sets = cut(term_sets(counted_pages(pages, "title", "content").where("content is not null"), "page_id", "title", "content"))
    graph, members, parts = links(sets)
    label = communities(graph, parts)
    inner = graph.join(label.select(F.col("node").alias("a"), F.col("community").alias("_ca")), "a").join(label.select(F.col("node").alias("b"), F.col("community").alias("_cb")), "b").where("_ca = _cb")
    weight = inner.select(F.col("a").alias("rep"), "similarity").union(inner.select("b", "similarity")).groupBy("rep").agg(F.sum("similarity").alias("weight"))
    copies = members.groupBy("rep").agg(F.count("*").alias("_copies"))
    rows = members.join(copies, "rep").join(label.select(F.col("node").alias("rep"), "community"), "rep", "left").join(weight, "rep", "left")
    rows = rows.select("page_id", F.coalesce("community", "rep").alias("_g"), (F.coalesce("weight", F.lit(0.0)) + F.col("_copies") - 1).alias("weight"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n_members"), F.min("page_id").alias("community")).where("n_members > 1")
    w = Window.partitionBy("_g").orderBy(F.round("weight", 9).desc(), "page_id")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    return top.join(sizes, "_g").select("community", "n_members", "rank", "page_id", F.round("weight", 9).alias("weight"))


def found(pages: DataFrame) -> DataFrame:
    """p6_found: the pairs of pages that are joined by links, directly or through others.

    Communities may split what is joined by few links, so they are put together again by the links between them.
    """
    sets = cut(term_sets(counted_pages(pages, "title", "content").where("content is not null"), "page_id", "title", "content"))
    graph, members, parts = links(sets)
    label = joined(graph, communities(graph, parts))
    grouped = cut(members.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("page_id", F.coalesce("component", "rep").alias("_g")))
    return pairs_within(grouped, "_g", "page_id").select(F.col("a").alias("page_a"), F.col("b").alias("page_b"))
