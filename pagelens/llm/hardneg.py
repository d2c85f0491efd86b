"""Hard-negative mining with Four-Russians scores.

Components become integers, floor(``SCALE`` * x).  Candidates are stored as
packed bit planes (two's complement): for each plane and each group of eight
dimensions one byte.  For each anchor and group a table holds the sums of all
256 subsets of the anchor's eight components, so one look-up by such a byte
scores eight dimensions of a plane; look-ups are added over groups, shifted by
the plane's weight and added to the full exact inner product.

Anchors are a stated query set: they are packed into blocks, groups of blocks
of bounded size are broadcast, and chunks of candidates meet every block where
they lie.  A task keeps the best of each anchor over all its chunks and emits
them once, so what is shuffled is a few rows for each anchor and task.  The
first pass finds the positives (only candidates of the anchor's label are
scored), the second the negatives within each positive's score range.

Defined cases: rows with a null id, a null label, a null or empty vector, or
any component that is null or not finite take no part; missing trailing
components of shorter vectors count as zero; an anchor's other rows are those
with another id; a repeated candidate row counts once per row, a repeated
anchor row is one anchor (rows that share an id but differ are anchors of their
own); integers saturate at the root of 2**62 / dimensions, so that scores
fit a long; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import by_value, small_batches, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5

#: Rows of a chunk of candidates, anchors of a block, candidates scored at once.
CHUNK, BLOCK, STEP = 4096, 256, 1024


def quantised(m: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as saturated integers."""
    most = np.floor(np.sqrt(2.0**62 / max(1, m.shape[1])))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * m), -most, most).astype(np.int64)


def bit_planes(v: np.ndarray) -> np.ndarray:
    """uint8[plane][group][row]: bit j of a byte is the plane's bit of
    dimension 8 * group + j; the last plane holds the signs."""
    n, dims = v.shape
    planes = max(int(np.maximum(v, ~v).max(initial=0)).bit_length(), 0) + 1
    wide = vectors.widened(v, -(-dims // 8) * 8)
    out = np.empty((planes, wide.shape[1] // 8, n), np.uint8)
    for p in range(planes):
        out[p] = np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group][byte][anchor]: sums of the components that the byte selects, in
    the narrowest integers that hold a whole plane."""
    a, dims = anchors.shape
    wide = vectors.widened(anchors, -(-dims // 8) * 8)
    total = int(np.abs(wide).sum(axis=1).max(initial=0))
    kind = np.int16 if total < 1 << 15 else np.int32 if total < 1 << 31 else np.int64
    parts = wide.astype(kind).T.reshape(-1, 8, a)
    table = np.zeros((len(parts), 256, a), kind)
    for j in range(8):  # subsets with j as their largest member
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + parts[:, j, None]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [candidate][anchor] by look-ups, shifts and additions."""
    groups = min(len(table), planes.shape[1])
    out = np.zeros((planes.shape[2], table.shape[2]), np.int64)
    for at in range(0, planes.shape[2], STEP):
        part = planes[:, :, at : at + STEP]
        n = part.shape[2]
        line, got = np.empty((n, table.shape[2]), table.dtype), np.empty((n, table.shape[2]), table.dtype)
        for p in range(len(part)):
            line[:] = 0
            for g in range(groups):
                np.take(table[g], part[p, g], axis=0, out=got, mode="clip")
                line += got
            weighed = line.astype(np.int64) << p
            if p == len(part) - 1:
                out[at : at + n] -= weighed
            else:
                out[at : at + n] += weighed
    return out


def prepared(vecs: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    return vecs.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vec_col).alias("vec")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.finite(F.col("vec")))


def chunks(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Rows of up to ``CHUNK`` candidates: ids, labels and planes as bytes,
    sorted by label and id."""

    def packed(ids, labels, parts):
        width = max(m.shape[1] for m in parts)
        v = np.concatenate([vectors.widened(m, width) for m in parts])
        ids, labels = np.concatenate(ids), np.concatenate(labels)
        order = np.lexsort((ids, labels))
        planes = bit_planes(v[order])
        return pa.RecordBatch.from_pydict({
            "n": pa.array([len(ids)], pa.int32()), "n_planes": pa.array([len(planes)], pa.int32()),
            "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "planes": [planes.tobytes()]})

    def run(batches):
        held, n = ([], [], []), 0
        for b in batches:
            ids, labels = b.column("id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)
            v = quantised(vectors.matrix(b.column("vec")), scale)
            at = 0
            while at < len(ids):
                take = min(CHUNK - n, len(ids) - at)
                for store, x in zip(held, (ids, labels, v)):
                    store.append(x[at : at + take])
                n, at = n + take, at + take
                if n == CHUNK:
                    yield packed(*held)
                    held, n = ([], [], []), 0
        if n:
            yield packed(*held)

    return rows.mapInArrow(run, "n int, n_planes int, ids binary, labels binary, planes binary")


def blocks(anchors: DataFrame, n_blocks: int) -> DataFrame:
    """(block, a): about ``BLOCK`` anchors in a row, dealt by their hash."""
    number = F.pmod(F.xxhash64("id", "label", "vec"), F.lit(n_blocks)).cast("int")
    return anchors.groupBy(number.alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "label", "vec"))).alias("a"))


class _Chunk:
    def __init__(self, row):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.planes = np.frombuffer(row["planes"], np.uint8).reshape(row["n_planes"], -1, row["n"])


class _Block:
    """Anchors of a block with their tables; ``best`` lives as long as a task."""

    def __init__(self, a: pa.StructScalar, scale: float, slots: int, k: int):
        a = a.values
        self.ids, self.labels = (a.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        self.vec, self.scale = a.field("vec"), scale
        self.best = [vectors.Best(len(self.ids), k, np.int64) for _ in range(slots)]
        self.high = None
        if slots > 1:  # scores of the positives; the smallest long where there is none
            p = a.field("p")
            self.high = np.full((slots, len(self.ids)), np.iinfo(np.int64).min)
            for i, own in enumerate(p.to_pylist()):
                self.high[: len(own), i] = own

    def table(self, of=slice(None)):
        return subset_sums(quantised(vectors.matrix(self.vec), self.scale)[of])


def _positives(block: _Block, chunk: _Chunk) -> None:
    """Candidates of the anchors' own labels only."""
    whole = None
    for label in np.intersect1d(block.labels, chunk.labels):
        a, b = np.searchsorted(chunk.labels, [label, label + 1])
        own = np.flatnonzero(block.labels == label)
        whole = block.table() if whole is None else whole
        s = scores(np.ascontiguousarray(whole[:, :, own]), chunk.planes[:, :, a:b]).T
        row, col = vectors.leaders(s, chunk.ids[None, a:b] != block.ids[own, None], block.best[0].k)
        block.best[0].offer(own[row], chunk.ids[a + col], s[row, col])


def _negatives(block: _Block, chunk: _Chunk) -> None:
    s = scores(block.table(), chunk.planes).T
    other = chunk.labels[None] != block.labels[:, None]
    for slot, best in enumerate(block.best):
        high = block.high[slot]
        there = np.flatnonzero(high >= 0)  # below zero the range is empty
        if len(there):
            top, x = high[there, None], s[there]
            row, col = vectors.leaders(x, other[there] & (x <= top) & (x >= top - top // 5), best.k)
            best.offer(there[row], chunk.ids[col], x[row, col])


FOUND = "block int, anchor int, slot int, rank int, id long, score long"


def _best(chunked: DataFrame, blocked: DataFrame, n_blocks: int, width: int, scale: float, scan, slots: int, k: int) -> DataFrame:
    """The k best of each (block, anchor, slot) over all chunks."""

    def run(batches):
        state: dict[int, _Block] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("block", "n", "n_planes", "ids", "labels", "planes")}
                if row["block"] not in state:
                    state[row["block"]] = _Block(b.column("a")[i], scale, slots, k)
                scan(state[row["block"]], _Chunk(row))
        for number, block in state.items():
            for slot, best in enumerate(block.best):
                anchor, rank, ids, score = best.found()
                n = len(anchor)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(n, number), pa.int32()), "anchor": pa.array(anchor, pa.int32()), "slot": pa.array(np.full(n, slot), pa.int32()),
                    "rank": pa.array(rank, pa.int32()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    parts = [p.mapInArrow(run, FOUND) for p in vectors.pairs(chunked, blocked, n_blocks, BLOCK * (8 * width + 64 + 8 * slots))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("block", "anchor", "slot").orderBy(F.desc("score"), "id", "rank")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vecs: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE) -> DataFrame:
    """For every row that satisfies ``anchor`` (a condition on ``id``) and each
    of its best ``positives`` of the same label: the best ``negatives`` of other
    labels that score between 0.8 and 1 times the positive's score.

    Columns: anchor_id, positive_id, positive_rank, rank, negative_id,
    positive_score, negative_score.
    """
    by_value(__name__, vectors.__name__)
    small_batches(vecs.sparkSession)
    rows = prepared(vecs, id_col, vec_col, F.col("label") if label is None else label)
    anchors = stored(rows.filter(anchor).distinct())
    n, width = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_blocks = max(1, -(-n // BLOCK))
    blocked = stored(blocks(anchors, n_blocks))
    chunked = stored(chunks(rows, scale))
    found = stored(_best(chunked, blocked, n_blocks, width, scale, _positives, 1, positives).drop("slot"))
    names = blocked.select("block", F.posexplode("a").alias("anchor", "a")).select("block", "anchor", F.col("a.id").alias("anchor_id"))
    # Each anchor takes its positives' scores along, in the order of the ranks.
    own = found.groupBy("block", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    with_p = blocked.select("block", F.posexplode("a").alias("anchor", "a")).join(own, ["block", "anchor"], "left").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("anchor", "a.id", "a.label", "a.vec", F.coalesce(
            F.transform("p", lambda x: x["score"]), F.array().cast("array<bigint>")).alias("p")))).alias("a"))
    hard = _best(chunked, stored(with_p), n_blocks, width, scale, _negatives, positives, negatives)
    return hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).withColumn("positive_rank", F.col("slot") + 1).join(
        found.select("block", "anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["block", "anchor", "positive_rank"]).join(names, ["block", "anchor"]).select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
