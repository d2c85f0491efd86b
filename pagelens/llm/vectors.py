"""Helpers shared by the operators on embedding tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one broadcast group of query blocks.
GROUP_BYTES = 16 << 20

NONE = np.iinfo(np.int64).max


def finite(vec: Column) -> Column:
    """Whether a vector is there, has components and all are finite numbers."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors without nulls as rows of float64; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(column.offsets.to_numpy())
    width = int(n.max(initial=0))
    if len(n) and (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = values
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Best:
    """The k best (score descending, id ascending) of each of some queries."""

    def __init__(self, rows: int, k: int, dtype):
        low = -np.inf if np.dtype(dtype).kind == "f" else np.iinfo(dtype).min
        self.k, self.low = k, low
        self.scores, self.ids = np.full((rows, k), low, dtype), np.full((rows, k), NONE, np.int64)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates in any number; ``rows`` says whose they are."""
        if not len(rows):
            return
        order = np.lexsort((ids, _down(scores), rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        keep = rank < self.k
        at, col = rows[keep], rank[keep]
        own = rows[start]
        where = np.searchsorted(own, at)
        s = np.concatenate((self.scores[own], np.full((len(own), self.k), self.low, self.scores.dtype)), axis=1)
        i = np.concatenate((self.ids[own], np.full((len(own), self.k), NONE, np.int64)), axis=1)
        s[where, self.k + col], i[where, self.k + col] = scores[keep], ids[keep]
        order = np.lexsort((i, _down(s)), axis=1)[:, : self.k]
        self.scores[own], self.ids[own] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self):
        """(row, rank, id, score) of all that are there."""
        row, rank = np.nonzero(self.ids != NONE)
        return row, rank, self.ids[row, rank], self.scores[row, rank]


def _down(scores: np.ndarray) -> np.ndarray:
    """Sorts as ``scores`` downwards (the smallest long has no negative)."""
    return -scores if scores.dtype.kind == "f" else ~scores


def leaders(scores: np.ndarray, allowed: np.ndarray, k: int):
    """(row, column) of entries that can be among the k best allowed of their
    row: all at least as good as the k-th, so no tie is lost."""
    if scores.shape[1] > k:
        low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
        s = np.where(allowed, scores, low)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (scores >= kth[:, None])
    return np.nonzero(allowed)


def pairs(chunks: DataFrame, blocks: DataFrame, n_blocks: int, block_bytes: int):
    """For every group of blocks that is small enough to be broadcast, each
    chunk beside each block of the group (columns of both).

    Chunks are never shuffled: with several groups they are read several times.
    """
    per = max(1, GROUP_BYTES // max(1, block_bytes))
    for first in range(0, n_blocks, per):
        last = min(n_blocks, first + per) - 1
        side = F.broadcast(blocks.filter(F.col("block").between(first, last)))
        yield chunks.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(side, "block")
