"""Problem 8: encoding with a public byte-level BPE vocabulary by a hierarchical-bitmap rank queue.

The distinct pre-tokens of a block of texts lie in one linked list of symbols. A bucket for each merge rank holds
the list positions whose pair has that rank; a three-level bitmap marks the buckets that hold any. Find-first-set
gives the next rank, all its positions are merged at once, entries that a former merge made stale are skipped,
and the new pairs go into their buckets. A merge can only give pairs of higher rank, so one sweep over the ranks
encodes the whole block, and a pre-token of any length costs its merges, not their square.

Null and empty texts give an empty list. The vocabulary is read from a path in the workers, never copied.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import list_array

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: The vocabulary's own split of texts into pre-tokens. Fixed value.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters of texts encoded together; distinct pre-tokens, and bytes of them, that a worker keeps between blocks.
BLOCK, KEPT, KEPT_BYTES = 1 << 24, 400_000, 1 << 25


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


class RankQueue:
    """Bucket queue over ranks 0..n-1; three levels of 64-bit words say which buckets hold entries."""

    def __init__(self, n: int) -> None:
        self.words = [[0] * (-(-n // 64**level)) for level in (1, 2, 3)]
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for words in self.words:
            words[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def push_sorted(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push positions under ranks that ascend."""
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for rank, i, j in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            self.push(rank, positions[i:j])

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank that has entries, with them."""
        rank = 0
        for words in reversed(self.words):
            word = next((w for w in words if w), 0) if words is self.words[2] else words[rank]
            if not word:
                return None
            base = next(i for i, w in enumerate(words) if w) if words is self.words[2] else rank
            rank = (base << 6) + (word & -word).bit_length() - 1
        found = self.buckets.pop(rank)
        index = rank
        for words in self.words:
            words[index >> 6] &= ~(1 << (index & 63))
            if words[index >> 6]:
                break
            index >>= 6
        return rank, found


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Bpe:
    """A byte-level BPE vocabulary, with the encoded pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        # bytes that print stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.n = len(pairs)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, self.n).astype(np.int32)
        self.index, self.encoded, self.held = _Numbered(), [], 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; n where the pair doesn't merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(self.n))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each non-empty piece, as the bytes of int32."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(flat)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        # one spare slot at the end takes what is written beyond a piece
        ids = np.append(self.byte_ids[flat], np.int32(-1))
        after = np.arange(1, size + 2, dtype=np.int32)
        after[ends - 1] = size
        after[size] = size
        before = np.arange(-1, size, dtype=np.int32)
        before[ends - sizes] = size
        before[size] = size
        rank = np.full(size + 1, self.n, np.int32)
        inner = np.flatnonzero(after[:size] != size).astype(np.int32)
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        queue = RankQueue(self.n)
        inner = inner[rank[inner] < self.n]
        inner = inner[np.argsort(rank[inner], kind="stable")]
        if len(inner):
            queue.push_sorted(rank[inner], inner)
        alive = np.ones(size + 1, bool)
        alive[size] = False
        while (top := queue.pop()) is not None:
            r, held = top
            at = held[0] if len(held) == 1 else distinct(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:
                at = self._alternate(at, after)
            eaten = after[at]
            beyond = after[eaten]
            alive[eaten] = False
            rank[eaten] = self.n
            ids[at] = self.made[r]
            after[at] = beyond
            before[beyond] = at
            before[size] = size
            back = before[at]
            touched = np.concatenate([at, back[back != size]])
            if len(back) > 1 and len(touched) > len(at):
                touched = distinct(touched)
            follow = after[touched]
            fresh = np.where(follow == size, np.int32(self.n), self.rank(ids[touched], ids[follow]))
            rank[touched] = fresh
            some = fresh < self.n
            if some.any():
                touched, fresh = touched[some], fresh[some]
                if len(touched) > 1:
                    order = np.argsort(fresh, kind="stable")
                    touched, fresh = touched[order], fresh[order]
                queue.push_sorted(fresh, touched)
        # what is alive, cut at the pieces' ends
        left = ids[:size][alive[:size]]
        edges = np.concatenate([[0], np.cumsum(alive[:size])[ends - 1]]).tolist()
        raw = left.astype("<i4").tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(edges, edges[1:], strict=False)]

    @staticmethod
    def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal symbols, every second one of each adjoining run, from the left."""
        joined = after[at[:-1]] == at[1:]
        if not joined.any():
            return at
        index = np.arange(len(at))
        first = np.concatenate([[True], ~joined])
        return at[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]

    def note(self, text: str | None) -> np.ndarray:
        """The text as numbers of its pre-tokens; new ones are merged by the next `settle`."""
        tokens = PATTERN.findall(text) if text else []
        return np.fromiter(map(self.index.__getitem__, tokens), np.int32, len(tokens))

    def settle(self) -> None:
        """Merge all pre-tokens noted since the last call, together."""
        new = [p.encode("utf-8", "replace") for p in islice(self.index, len(self.encoded), None)]
        self.held += sum(map(len, new))
        if new:
            self.encoded.extend(self.merge(new))

    def ids(self, noted: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.encoded.__getitem__, noted.tolist())), "<i4")

    def trim(self) -> None:
        """Forget the pre-tokens once they hold too much; only between blocks."""
        if len(self.encoded) > KEPT or self.held > KEPT_BYTES:
            self.index, self.encoded, self.held = _Numbered(), [], 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        noted = [self.note(x) for x in texts]
        self.settle()
        out = [self.ids(x) for x in noted]
        self.trim()
        return out

    def stream(self, batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Each batch with the ids of its texts; blocks reach over batches, for the sweep costs by its distinct ranks."""
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def flush():
            self.settle()
            for batch, noted in held:
                yield batch, [self.ids(x) for x in noted]
            held.clear()
            self.trim()

        for batch in batches:
            texts = batch.column(column).to_pylist()
            size += sum(len(x) for x in texts if x)
            held.append((batch.drop_columns([batch.schema.names[column]]), [self.note(x) for x in texts]))
            if size >= BLOCK:
                yield from flush()
                size = 0
        yield from flush()


_LOADED: dict[str, Bpe] = {}


def shipped(spark: SparkSession, tokenizers: str, name: str) -> str:
    """Have a vocabulary's file sent to every executor, which needn't have the folder; the name that `vocabulary` finds it by."""
    spark.sparkContext.addFile(f"{tokenizers}/{name}.json")
    return f"{name}.json"


def vocabulary(file: str) -> Bpe:
    """The vocabulary of a file that was sent; a worker loads it once."""
    path = SparkFiles.get(file)
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): every row's ids without special tokens; strings that look like special tokens are ordinary text."""
    file = shipped(docs.sparkSession, tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in vocabulary(file).stream(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, pa.int32())], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
