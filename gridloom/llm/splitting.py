"""Problem 5: cutting long texts at natural boundaries, with overlap, by pointer doubling.

Every position of a text is a possible start. One pass over sorted boundaries joins each start to its farthest
legal end and, by the overlap, to the next start: a successor table. Squaring the table doubles the distance it
spans, and the set of reached starts doubles with it, so all cuts of a text fall out in log2(pieces) steps
without walking from piece to piece.

Null texts and texts within the limit give no piece (see `pieces(..., short=True)`). Repeated rows give repeated pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import WHITE, arrow_map, codepoints, counted_pages

LIMIT, LEAST, OVERLAP = 1500, 750, 150
#: Sentence ends that need nothing after them, and those that need white space. Fixed values.
WIDE_ENDS, SPACED_ENDS = "。！？", ".!?।"


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def _last_at_or_before(flags: np.ndarray) -> np.ndarray:
    """For every position the greatest flagged position up to it, or -1."""
    where = np.where(flags, np.arange(len(flags), dtype=np.int32), np.int32(-1))
    return np.maximum.accumulate(where)


def successors(cps: np.ndarray, limit: int, least: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start 0..n: the end of its piece, and the start of the next piece (n if there is none)."""
    n = len(cps)
    white = np.isin(cps, _codes(WHITE))
    feed = cps == 10
    # flags of positions 0..n: what stands just before a position, and just after
    after_white = np.zeros(n + 1, bool)
    after_white[1:] = white
    paragraph = np.zeros(n + 1, bool)
    paragraph[2:] = feed[1:] & feed[:-1]
    paragraph[:n] &= ~feed
    sentence = np.zeros(n + 1, bool)
    sentence[1:] = np.isin(cps, _codes(WIDE_ENDS))
    sentence[1:n] |= np.isin(cps[:-1], _codes(SPACED_ENDS)) & white[1:]
    starts = np.arange(n + 1, dtype=np.int32)
    reach = np.minimum(starts + limit, n)
    end = reach.copy()
    open_ = starts + limit < n
    for flags in (paragraph, sentence, after_white):
        if not open_.any():
            break
        last = _last_at_or_before(flags)[reach]
        hit = open_ & (last > starts + least)
        end[hit] = last[hit]
        open_ &= ~hit
    whole = starts + limit >= n
    end[whole] = n
    # the smallest position from e - overlap on, before e, just after white space
    ahead = np.where(after_white, starts, np.int32(n + 1))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    back = np.maximum(end - overlap, 0)
    near = ahead[back]
    following = np.where(near < end, near, back).astype(np.int32)
    following[whole] = n
    return end, following


def cuts(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces of a text."""
    cps = codepoints(text)
    n = len(cps)
    end, table = successors(cps, limit, least, overlap)
    reached = np.zeros(1, np.int32)
    while True:
        # after round k, reached holds the first 2**k starts and table leads 2**k pieces on
        more = table[reached]
        more = more[more < n]
        reached = np.concatenate([reached, more])
        if not len(more) or len(more) < len(reached) // 2:
            break
        table = table[table]
    return reached, end[reached]


def pieces(items: DataFrame, kind: str, key: str, text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, short: bool = False) -> DataFrame:
    """(item_kind, item_id, piece_start, piece_end) of every item over the limit; with `short`, also items within it.

    The limits must leave room to go forward: overlap < least < limit.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("overlap < least < limit is needed")

    def run(batch: pa.RecordBatch):
        ids, starts, ends = [], [], []
        for item, value in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), strict=True):
            s, e = cuts(value, limit, least, overlap)
            ids.append(np.full(len(s), item, np.int64))
            starts.append(s)
            ends.append(e)
        if ids:
            columns = [np.concatenate(ids), np.concatenate(starts).astype(np.int32), np.concatenate(ends).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_id", "piece_start", "piece_end"])

    size = F.length(text)
    wanted = items.where(F.col(key).isNotNull() & (size > (0 if short else limit)))
    out = arrow_map(wanted.select(F.col(key).cast("bigint").alias("item_id"), text), run, "item_id bigint, piece_start int, piece_end int")
    return out.select(F.lit(kind).alias("item_kind"), "item_id", "piece_start", "piece_end")


def long_passages(passages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each passage over the limit; repeated rows are identical, and only long ones travel."""
    return passages.where(F.length("text") > limit).select("passage_id", "text").dropDuplicates(["passage_id"])


def found(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """p5_found: all pieces of page contents and passage texts of more than 1,500 characters."""
    whole = counted_pages(pages, "content")
    return pieces(whole, "page", "page_id", "content").unionByName(pieces(long_passages(passages), "passage", "passage_id", "text"))
