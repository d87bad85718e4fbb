"""Problem 9: filling containers of fixed capacity with texts, along a space-filling curve.

Each document's token ids are hashed to a few dimensions by a fixed random projection; each dimension, squeezed by the
hyperbolic tangent, is cut into equal cells, and the cell's place on the Hilbert curve is a key. Stretches of the curve hold
about equally many pieces and follow from the pieces' keys alone, not from cores or partitions. In a stretch, documents fill containers window by window: best fit, largest first, among a bounded number
of containers that stay open, so neighbours on the curve share containers and little room is left over. What is
still open at a stretch's end is filled up once more over all stretches, as wholes, by the same rule.

Only a text of more than the capacity is split, into full containers and a rest that is packed like any other.
Null and empty texts have no token; they are items of size 0 and take a place in a container all the same.
Repeated rows are items of their own. Ties are broken by doc_id, so the same input gives the same containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.common import BASE, mix
from gridloom.llm.encoding import TOKENIZERS, distinct, shipped, vocabulary
from gridloom.session import cut

CAPACITY = 2048
#: Dimensions of the projected vectors and bits of each on the curve.
DIMS, BITS = 4, 8
#: Items sorted by size together, and containers kept open between such windows.
WINDOW, OPEN = 2048, 64
#: Pieces of a stretch, about; bits of a key that stretches are counted by; stretches whose open containers are merged together.
STRETCH, COUNTED, MERGED = 32_768, 16, 4096


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of non-negative cell numbers below 2**bits (transpose method, all rows at once)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[dims - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] ^ turn) >> bit & 1)
    return key


def _projection(width: int) -> np.ndarray:
    """A row of DIMS signs for every token id, from a hash of the id."""
    seeds = np.arange(width * DIMS, dtype=np.uint64) * BASE
    return np.where(mix(seeds) >> np.uint64(63), 1.0, -1.0).reshape(width, DIMS).astype(np.float32)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens, place): the size of each text in tokens, and its place on the curve."""
    file = shipped(docs.sparkSession, tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(file)
        signs = _projection(bpe.width)
        for batch, ids in bpe.stream(batches):
            # a term counts once a document: frequent pieces would else drown the rest
            sums = np.array([signs[distinct(x)].sum(axis=0) if len(x) else np.zeros(DIMS, np.float32) for x in ids]).reshape(-1, DIMS)
            norm = np.sqrt(np.array([len(x) for x in ids], np.float32)).reshape(-1, 1)
            spread = sums / np.maximum(norm, 1)
            cells = np.clip(((np.tanh(spread) + 1) * (1 << BITS - 1)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(hilbert(cells))], names=[key, "n_tokens", "place"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint, place bigint")


class Filler:
    """Best fit among the open containers; of those still open after a window, only the emptiest stay."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.room: list[tuple[int, int]] = []
        self.made = 0

    def put(self, size: int) -> int:
        """The container that an item goes to."""
        i = bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, box = self.room.pop(i)
        else:
            left, box = self.capacity, self.made
            self.made += 1
        if left > size or not size:
            insort(self.room, (left - size, box))
        return box

    def close(self) -> None:
        del self.room[: max(0, len(self.room) - self.most)]


def fill(sizes: np.ndarray, capacity: int, window: int = WINDOW, most: int = OPEN) -> tuple[np.ndarray, Filler]:
    """Container numbers of items that come in the curve's order."""
    filler = Filler(capacity, most)
    boxes = np.empty(len(sizes), np.int64)
    for i in range(0, len(sizes), window):
        part = sizes[i : i + window]
        for j in np.argsort(-part, kind="stable").tolist():
            boxes[i + j] = filler.put(int(part[j]))
        filler.close()
    return boxes, filler


def stretches(pieces: DataFrame, size: int) -> DataFrame:
    """The pieces with the number of their stretch: neighbouring cells of the curve with about `size` pieces together.

    A cell of more than that is cut by a hash of its pieces' keys. At most 2**COUNTED counts reach the driver and the tasks.
    """
    spark = pieces.sparkSession
    cell = F.shiftright("place", DIMS * BITS - COUNTED).cast("int")
    counts = sorted((r[0], r[1]) for r in pieces.groupBy(cell.alias("cell")).count().collect())
    rows, at, held = [], 0, 0
    for c, n in counts:
        parts = max(1, -(-n // (2 * size)))
        if held and held + n > size:
            at, held = at + 1, 0
        rows.append((c, at, parts))
        held += n
        if parts > 1:
            at, held = at + parts, 0
    known = spark.createDataFrame(rows, "cell int, first int, parts int")
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts").cast("bigint")).cast("int")
    return pieces.withColumn("cell", cell).join(F.broadcast(known), "cell").withColumn("stretch", F.col("first") + part).drop("cell", "first", "parts")


def pack(docs: DataFrame, capacity: int = CAPACITY, stretch: int = STRETCH, **names: str) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container): every token of every text in one container.

    A stretch is packed by one task that holds the keys and sizes of at most twice `stretch` pieces. The stretches' open
    containers, at most OPEN each, are merged by further tasks, each over at most MERGED neighbouring stretches.
    """
    items = cut(sized(docs, **names))
    whole = F.col("n_tokens").cast("bigint")
    n_pieces = F.greatest(F.lit(1), F.ceil(whole / capacity)).cast("int")
    pieces = items.select("doc_id", "place", "n_tokens", F.posexplode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece", "_p")).select(
        "doc_id", "place", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"), F.least(F.lit(capacity), whole - F.col("piece").cast("bigint") * capacity).alias("n_tokens")
    )
    order = ["stretch", "place", "doc_id", "piece", "n_tokens"]
    sorted_ = stretches(pieces, stretch).select(*order, "token_start").repartition("stretch").sortWithinPartitions(*order)
    schema = "doc_id bigint, piece int, token_start bigint, n_tokens bigint, stretch int, box bigint, open boolean, fill bigint"

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows.column("n_tokens").to_numpy()
        boxes, filler = fill(sizes, capacity)
        filled = np.zeros(filler.made, np.int64)
        np.add.at(filled, boxes, sizes)
        still = np.zeros(filler.made, bool)
        still[[b for _, b in filler.room]] = True
        out = pa.Table.from_arrays(
            [*(rows.column(c) for c in ("doc_id", "piece", "token_start", "n_tokens", "stretch")), pa.array(boxes), pa.array(still[boxes]), pa.array(filled[boxes])],
            names=[c.split()[0] for c in schema.split(", ")],
        )
        yield from out.combine_chunks().to_batches(max_chunksize=65536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != at[s]:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from solve(pa.Table.from_batches(held))

    packed = cut(sorted_.mapInArrow(run, schema))
    group = F.floor(F.col("stretch") / MERGED).cast("int").alias("group")
    open_boxes = packed.where("open").select(group, "stretch", "box", "fill").distinct().repartition("group").sortWithinPartitions("group", "stretch", "box")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        for g in np.unique(rows.column("group").to_numpy()).tolist():
            own = rows.filter(pc.equal(rows.column("group"), g))
            boxes, _ = fill(own.column("fill").to_numpy(), capacity)
            names = [f"m{g}-{b}" for b in boxes.tolist()]
            yield from pa.Table.from_arrays([own.column("stretch"), own.column("box"), pa.array(names)], names=["stretch", "box", "shared"]).combine_chunks().to_batches(max_chunksize=65536)

    shared = open_boxes.mapInArrow(merge, "stretch int, box bigint, shared string")
    name = F.coalesce("shared", F.concat(F.col("stretch"), F.lit("-"), F.col("box")))
    return packed.join(shared, ["stretch", "box"], "left").select("doc_id", "piece", "token_start", "n_tokens", name.alias("container"))


def summary(docs: DataFrame, capacity: int = CAPACITY, **names: str) -> DataFrame:
    """(n_documents, n_over, n_wrong, n_split), one row: containers over the capacity, documents whose pieces aren't all of their tokens
    once and in order, and documents in several pieces that would have fitted in one container."""
    sizes = sized(docs, **names).groupBy("doc_id").agg(F.sum("n_tokens").alias("_n"), F.count("*").alias("_rows"))
    packed = cut(pack(docs, capacity, **names))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("_fill")).agg(F.count_if(F.col("_fill") > capacity).alias("n_over"))
    w = Window.partitionBy("doc_id").orderBy("token_start")
    placed = packed.withColumn("_gap", F.col("token_start") - F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(w), F.lit(0)))
    held = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("_sum"), F.count("*").alias("_pieces"), F.max(F.abs("_gap")).alias("_gap"))
    both = sizes.join(held, "doc_id", "full")
    right = (F.col("_sum") == F.col("_n")) & ((F.col("_gap") == 0) | (F.col("_rows") > 1))
    counts = both.agg(F.count("*").alias("n_documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong"), F.count_if((F.col("_pieces") > F.col("_rows")) & (F.col("_n") <= capacity)).alias("n_split"))
    return counts.join(over).select("n_documents", "n_over", "n_wrong", "n_split")
