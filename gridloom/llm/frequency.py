"""Problem 2: occurrences and records of every distinct term, by burst-trie counting.

Each worker counts into a burst trie: inner nodes branch by character, leaves are containers of suffixes that burst
into a node once they hold too many. Containers go to the shared folder as rows of suffixes and counters. The
prefixes that hold more than a cap over all workers, the inner nodes of a shared trie, decide where a term goes:
to its shortest prefix that isn't one of them. Workers' containers are cut along these routes, matching subtrees meet in
one task and are merged there, one route at a time.

The inner nodes are the only thing that all tasks get: at most `ROUTES` prefixes per character of depth, whatever
the input, since the cap grows with the number of entries. Frequent terms are one entry per worker, so no term is hot.

Null, empty and blank contents hold no term but count as records. Repeated rows of a page count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import TERM, counted_pages
from gridloom.session import cut

#: Entries at which a container bursts, entries at which a worker writes its trie out, and the most routes.
BURST, FLUSH, ROUTES = 512, 400_000, 4096
#: Least entries of a route, so that small inputs don't scatter.
LEAST_CAP = 20_000

SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters each."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.size = burst, 0
        #: A node is [True, children by character, counters of the term that ends here or None]; a container [False, entries].
        self.root: list = [False, {}]

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while node[0]:
            if depth == len(term):
                if node[2] is None:
                    node[2] = [0, 0]
                    self.size += 1
                node[2][0] += occurrences
                node[2][1] += records
                return
            child = node[1].get(term[depth])
            if child is None:
                child = node[1][term[depth]] = [False, {}]
            node, depth = child, depth + 1
        held = node[1]
        suffix = term[depth:]
        entry = held.get(suffix)
        if entry is not None:
            entry[0] += occurrences
            entry[1] += records
            return
        held[suffix] = [occurrences, records]
        self.size += 1
        if len(held) > self.burst:
            self._burst(node)

    @staticmethod
    def _burst(node: list) -> None:
        children: dict[str, list] = {}
        own = None
        for suffix, entry in node[1].items():
            if suffix:
                children.setdefault(suffix[0], [False, {}])[1][suffix[1:]] = entry
            else:
                own = entry
        node[:] = [True, children, own]

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """Every container with its prefix; a term that ends at a node is a container of its own."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if not node[0]:
                if node[1]:
                    yield prefix, node[1]
                continue
            if node[2] is not None:
                yield prefix, {"": node[2]}
            todo.extend((prefix + c, child) for c, child in node[1].items())


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        columns = list(zip(*rows[i : i + most], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COUNTS = pa.list_(pa.int64())
_SCHEMA = pa.schema([("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", _COUNTS), ("records", _COUNTS)])


def _rows(trie: BurstTrie) -> list[tuple]:
    return [(prefix, list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]) for prefix, held in trie.containers()]


def count_subtrees(docs: DataFrame, text: str) -> DataFrame:
    """Each worker's containers, and a row with a null prefix that has its number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n = BurstTrie(), 0
        for batch in batches:
            occurrences, records = Counter(), Counter()
            for value in batch.column(0).to_pylist():
                n += 1
                if value:
                    terms = TERM.findall(value.lower())
                    occurrences.update(terms)
                    records.update(set(terms))
            for term, count in occurrences.items():
                trie.add(term, count, records[term])
            if trie.size > FLUSH:
                yield from _batches(_rows(trie), _SCHEMA)
                trie = BurstTrie()
        yield from _batches([*_rows(trie), (None, [], [], [n])], _SCHEMA)

    return docs.select(text).mapInArrow(run, SUBTREE)


def inner_nodes(subtrees: DataFrame, routes: int = ROUTES) -> frozenset[str]:
    """Prefixes that hold more entries than a route may.

    At one depth fewer than `routes` prefixes can hold more than 1/routes of all entries, so the set is bounded.
    """
    sizes = subtrees.where("prefix is not null").groupBy("prefix").agg(F.sum(F.size("suffixes")).alias("n"))
    above = sizes.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring("prefix", F.lit(1), i))).alias("p"))
    totals = above.groupBy("p").agg(F.sum("n").alias("n"))
    whole = totals.where("p = ''").agg(F.sum("n")).first()[0] or 0
    cap = max(LEAST_CAP, -(-whole // routes))
    return frozenset(r[0] for r in totals.where(F.col("n") > cap).select("p").collect())


def term_counts(docs: DataFrame, text: str, routes: int = ROUTES) -> tuple[DataFrame, int]:
    """(term, n_occurrences, n_records) of all terms, and the number of records."""
    subtrees = cut(count_subtrees(docs, text))
    n = subtrees.where("prefix is null").agg(F.sum(F.element_at("records", 1))).first()[0] or 0
    inner = inner_nodes(subtrees, routes)

    def route(term: str) -> str:
        for i in range(len(term)):
            if term[:i] not in inner:
                return term[:i]
        return term

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                way = route(prefix)
                if way not in inner or way != prefix:
                    rows.append((way, [prefix[len(way) :] + s for s in suffixes], occurrences, records))
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for s, o, r in zip(suffixes, occurrences, records, strict=True):
                    way = route(prefix + s)
                    part = parts.setdefault(way, ([], [], []))
                    part[0].append((prefix + s)[len(way) :])
                    part[1].append(o)
                    part[2].append(r)
                rows.extend((way, *part) for way, part in parts.items())
            yield from _batches(rows, _SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "n_occurrences", "n_records"]

        def emit(prefix: str, trie: BurstTrie) -> Iterator[pa.RecordBatch]:
            for way, held in trie.containers():
                terms = [prefix + way + s for s in held]
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())], names=names)

        at, trie = None, BurstTrie(4096)
        for batch in batches:
            for prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prefix != at:
                    if at is not None:
                        yield from emit(at, trie)
                    at, trie = prefix, BurstTrie(4096)
                for s, o, r in zip(suffixes, occurrences, records, strict=True):
                    trie.add(s, o, r)
        if at is not None:
            yield from emit(at, trie)

    sent = subtrees.where("prefix is not null").mapInArrow(send, SUBTREE)
    merged = sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(merge, "term string, n_occurrences bigint, n_records bigint")
    return merged, n


def marked(docs: DataFrame, text: str) -> DataFrame:
    """(term, n_occurrences, n_records, mark): 'rare' in one record, 'common' in more than a tenth of them, else null; rare goes first."""
    counts, n = term_counts(docs, text)
    mark = F.when(F.col("n_records") == 1, "rare").when(F.col("n_records") * 10 > n, "common")
    return counts.withColumn("mark", mark)


def found(pages: DataFrame) -> DataFrame:
    """p2_found: the marked terms of the counted pages."""
    return marked(counted_pages(pages, "content"), "content").where("mark is not null").select("term", "mark")
