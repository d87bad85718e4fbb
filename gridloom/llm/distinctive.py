"""Problem 4: how distinctive a term is per record, by a parsimonious language model.

For each record, expectation-maximisation splits the terms' mass between the record's own model and the background
of all records: terms that the background explains lose their mass, the others keep it, and the converged
probabilities rank the terms.

Records are read in blocks of bounded size. A block's distinct terms, not its occurrences, are numbered, written with
their sums and added up over all blocks; records are written as numbers of terms. A block's slice of the background
comes back as rows that precede the block's records in a sorted partition. Nothing is broadcast, and a term that
every record holds travels once a block.

Null titles and contents count as empty; records without terms give no row. Repeated rows of a page count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm.common import codepoints, counted_pages, term_points
from gridloom.session import cut

#: Share of the record's own model, steps and change at which EM stops, and probability below which a term is dropped.
#: The share is small, so a record keeps what the background can't explain: everyday words hold half of the mass at 0.9, a hundredth at 0.05.
OWN, STEPS, CHANGE, LEAST = 0.05, 60, 1e-7, 1e-9
#: Records and characters at which a block ends; they bound what a task holds, the slice of the background too.
BLOCK, CHARS = 2048, 1 << 22
#: Numbers of a matrix of EM: few enough to stay in a core's cache.
CELLS = 1 << 14


def count_terms(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all texts in code-point order; how many different ones each text has; and, text by text, their numbers and counts.

    Equal to TERM.findall on each text, but in whole arrays, without a string for every occurrence.
    """
    cps = codepoints("\n".join(texts) + "\n")
    inside = np.zeros(len(cps) + 1, bool)
    np.take(term_points(), cps, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    # what is no term is left out, so the terms lie end to end
    kept = cps[inside[1:]]
    data = kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    ends = np.cumsum(last - first)
    if len(data) > len(kept):
        width = np.ones(len(kept), np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += kept >= least
        ends = np.cumsum(width, dtype=np.int64)[ends - 1]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.searchsorted(first, np.cumsum(sizes) - sizes)
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(first))))
    both = text * max(len(order), 1) + number[words.indices.to_numpy()]
    both.sort()
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    text, codes = np.divmod(both[new], max(len(order), 1))
    return words.dictionary.take(pa.array(order)), np.bincount(text, minlength=len(texts)), codes, np.diff(np.append(new, len(both)))


def _blocks(docs: DataFrame, key: str, texts: tuple[str, ...], block: int) -> DataFrame:
    """Two kinds of rows: (_b, key, codes, counts), a record's terms, and (_b, code, term, cf, df), a term of the block _b and its sums."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for item, *values in zip(*columns, strict=True):
                ids.append(item)
                held.append(" ".join(v or "" for v in values).lower())
                size += len(held[-1])
                if len(ids) >= block or size >= CHARS:
                    yield from made(b, pa.array(ids, batch.schema.field(0).type), held)
                    b, ids, held, size = b + 1, [], [], 0
        if ids:
            yield from made(b, pa.array(ids, batch.schema.field(0).type), held)

    def made(b: int, ids: pa.Array, held: list[str]) -> Iterator[pa.RecordBatch]:
        terms, sizes, codes, counts = count_terms(held)
        n, m, offsets = len(ids), len(terms), pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (codes, counts)]
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b)), ids, *lists, *none], names=names)
        cf, df = np.bincount(codes, weights=counts, minlength=m).astype(np.int64), np.bincount(codes, minlength=m).astype(np.int32)
        none = [pa.nulls(m, t) for t in (ids.type, lists[0].type, lists[1].type)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, b)), *none, pa.array(np.arange(m, dtype=np.int32)), terms, pa.array(cf), pa.array(df)], names=names)

    names = ["_b", key, "codes", "counts", "code", "term", "cf", "df"]
    return docs.select(key, *texts).mapInArrow(run, f"_b bigint, {key} {kind}, codes array<int>, counts array<int>, code int, term string, cf bigint, df int")


def parsimonious(counts: np.ndarray, background: np.ndarray, starts: np.ndarray, own: float = OWN) -> np.ndarray:
    """Converged probabilities of the terms of several records; starts are the records' first places, none is empty.

    Records of like size are the columns of a matrix, filled up with zeros.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    order = np.argsort(-sizes, kind="stable")
    p, done = np.empty(len(counts)), 0
    while done < len(order):
        high = int(sizes[order[done]])
        some = order[done : done + max(1, CELLS // high)]
        done += len(some)
        size = sizes[some]
        column = np.repeat(np.arange(len(some)), size)
        row = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(starts[some], size) + row
        c, q = np.zeros((high, len(some))), np.ones((high, len(some)))
        c[row, column], q[row, column] = counts[place], np.maximum(background[place] * ((1 - own) / own), 1e-300)
        p[place] = _converge(c, q)[row, column]
    return p


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, each added up from the top, so neither zeros nor other columns change them."""
    return x.sum(axis=0) if x.shape[1] > 1 else np.cumsum(x)[-1:]


def _converge(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Probabilities from counts and the background's share by the record's own, a record a column."""
    out, at, ended = np.zeros(c.shape), np.arange(c.shape[1]), np.zeros(c.shape[1], bool)
    now = c / _sums(c)
    new, work = np.empty_like(now), np.empty_like(now)
    for _ in range(STEPS):
        np.add(now, q, out=work)
        np.divide(now, work, out=new)
        new *= c
        new *= 1 / np.maximum(_sums(new), 1e-300)
        np.greater_equal(new, LEAST, out=work, casting="unsafe")
        new *= work
        np.subtract(new, now, out=work)
        # a record stops by its own change, whatever else is in the matrix; columns that ended leave it a few at a time
        over = ~ended & (np.abs(work, out=work).max(axis=0) < CHANGE)
        now, new = new, now
        if over.any():
            out[:, at[over]] = now[:, over]
            ended |= over
            if 4 * np.count_nonzero(ended) >= len(at):
                going = np.flatnonzero(~ended)
                at, ended = at[going], ended[going]
                if not len(at):
                    break
                c, q, now = (x.take(going, axis=1) for x in (c, q, now))
                new, work = np.empty_like(now), np.empty_like(now)
    out[:, at[~ended]] = now[:, ~ended]
    return out


def _scored(docs: DataFrame, key: str, texts: tuple[str, ...], own: float, block: int, least: int, emit: Callable[..., pa.RecordBatch], schema: str) -> tuple[DataFrame, int]:
    """Rows of emit(keys, sizes, terms, counts, records, probabilities, number of records), called with some records at a time; and their number.

    Sizes are the records' numbers of terms; counts, records and probabilities have an entry for each term of each. terms(places)
    gives the strings, null for terms that fewer than `least` records hold.
    """
    blocks = cut(_blocks(docs, key, texts, block))
    n, total = blocks.agg(F.count("*") - F.count("code"), F.coalesce(F.sum("cf"), F.lit(1))).first()
    same = Window.partitionBy("term")
    sums = [F.sum("cf").over(same).alias("cf"), F.sum("df").over(same).alias("records")]
    known = blocks.where("code is not null").select("_b", "code", "term", *sums).where(F.col("records") >= least)
    nulls = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in (key, "codes", "counts")]
    head = known.select("_b", *nulls, "code", "term", "cf", "records")
    body = blocks.where("code is null").select("_b", key, "codes", "counts", "code", "term", "cf", F.lit(None).cast("bigint").alias("records"))
    rows = head.unionByName(body).repartition("_b").sortWithinPartitions("_b", F.col("code").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, table = None, [], None
        for batch in batches:
            b = batch.column(0).to_numpy()
            for i, j in _runs(b):
                if b[i] != at:
                    at, heads, table = b[i], [], None
                part = batch.slice(i, j - i)
                m = part.column(4).null_count
                if m < len(part):
                    heads.append(part.slice(0, len(part) - m))
                if m:
                    table = table or background(heads)
                    yield score(part.slice(len(part) - m), *table)

    def background(heads: list[pa.RecordBatch]) -> tuple:
        """Place of each number of a term, and by place its string, sum and records; the last place is that of terms left out."""
        code, cf, records = (np.concatenate([*(h.column(i).to_numpy() for h in heads), last]) for i, last in ((4, np.empty(0, np.int64)), (6, [0]), (7, [1])))
        place = np.full(code.max(initial=-1) + 2, len(code))
        place[code] = np.arange(len(code))
        return place, pa.concat_arrays([*(h.column(5).cast(pa.string()) for h in heads), pa.nulls(1, pa.string())]), cf, records

    def score(rows: pa.RecordBatch, place: np.ndarray, terms: pa.Array, cf: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
        sizes = pc.list_value_length(rows.column(2)).to_numpy().astype(np.int64)
        counts = rows.column(3).flatten().to_numpy().astype(np.float64)
        at = place[np.minimum(rows.column(2).flatten().to_numpy(), len(place) - 1)]
        # a term left out is this record's alone
        mass = np.where(at < len(terms) - 1, cf[at], counts)
        p = parsimonious(counts, mass / total, (np.cumsum(sizes) - sizes)[sizes > 0], own)
        return emit(rows.column(1), sizes, lambda x: terms.take(pa.array(at[x])), counts, records[at], p, n)

    return rows.mapInArrow(run, schema), n


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(values) else iter(())


def scores(docs: DataFrame, key: str, *texts: str, own: float = OWN, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(key, terms, counts, records, probabilities) of each record, arrays side by side; and the number of records.

    Terms are in code-point order; those whose mass went to the background have probability 0.
    """
    names = [key, "terms", "counts", "records", "probabilities"]

    def emit(ids: pa.Array, sizes: np.ndarray, terms: Callable, counts: np.ndarray, records: np.ndarray, p: np.ndarray, n: int) -> pa.RecordBatch:
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        values = (terms(np.arange(len(p))), pa.array(counts.astype(np.int32)), pa.array(records), pa.array(p))
        return pa.RecordBatch.from_arrays([ids, *(pa.ListArray.from_arrays(offsets, x) for x in values)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return _scored(docs, key, texts, own, block, 1, emit, f"{key} {kind}, terms array<string>, counts array<int>, records array<bigint>, probabilities array<double>")


def _greatest(weights: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks of the k greatest weights of each record, the first of equal ones; those of minus infinity are none of them."""
    record, size = np.repeat(np.arange(len(sizes)), sizes), sizes[sizes > 0]
    left, places, ranks = weights.copy(), [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for rank in range(1, k + 1 if len(left) else 0):
        most = np.repeat(np.maximum.reduceat(left, np.cumsum(size) - size), size)
        at = np.flatnonzero((left == most) & (left > -np.inf))
        if not len(at):
            break
        at = at[np.append(True, record[at[1:]] != record[at[:-1]])]
        left[at] = -np.inf
        places.append(at)
        ranks.append(np.full(len(at), rank, np.int32))
    return np.concatenate(places), np.concatenate(ranks)


def _best(pages: DataFrame, k: int, weigh: Callable[..., np.ndarray], name: str) -> DataFrame:
    """(page_id, rank, term, name): of the terms that two pages at least hold, the k of greatest weight, ties to 9 decimals in code-point order.

    Terms to which weigh(sizes, counts, records, probabilities, number of pages) gives minus infinity are none of them.
    """

    def emit(ids: pa.Array, sizes: np.ndarray, terms: Callable, counts: np.ndarray, records: np.ndarray, p: np.ndarray, n: int) -> pa.RecordBatch:
        w = np.round(np.where(records > 1, weigh(sizes, counts, records, p, n), -np.inf), 9)
        # terms are in code-point order, so the first of equal ones is the first in it
        places, ranks = _greatest(w, sizes, k)
        record = np.repeat(np.arange(len(sizes)), sizes)[places]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(record)), pa.array(ranks), terms(places), pa.array(w[places])], names=["page_id", "rank", "term", name])

    kind = pages.schema["page_id"].dataType.simpleString()
    texts = ("title", "content")
    return _scored(counted_pages(pages, *texts), "page_id", texts, OWN, BLOCK, 2, emit, f"page_id {kind}, rank int, term string, {name} double")[0]


def top_terms(pages: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, rank, term, probability): of the terms that two pages at least hold, the k of greatest converged probability.

    Terms left to the background are none of them; ties to 9 decimals in code-point order.
    """
    return _best(pages, k, lambda sizes, counts, records, p, n: np.where(p > 0, p, -np.inf), "probability")


def found(pages: DataFrame) -> DataFrame:
    """p4_found: of the terms that two pages at least hold, the three of greatest weight.

    The weight is exact: occurrences in the page x ln(pages / pages that hold the term). The model proposes the terms that it
    keeps; of those it left to the background, all that weigh as much as the third of them are weighed too, so none is lost.
    """

    def weigh(sizes: np.ndarray, counts: np.ndarray, records: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
        w = counts * np.log(n / records)
        kept = np.where((p > 0) & (records > 1), w, -np.inf)
        places, ranks = _greatest(kept, sizes, 3)
        record, third = np.repeat(np.arange(len(sizes)), sizes), places[ranks == 3]
        least = np.full(len(sizes), -np.inf)
        least[record[third]] = w[third]
        return np.where((p > 0) | (w >= least[record] - 1e-9), w, -np.inf)

    return _best(pages, 3, weigh, "weight").select("page_id", "term")
