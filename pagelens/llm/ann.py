"""Approximate nearest neighbours by cosine: inverted lists with an adaptive
dimension scan.

Unit vectors are turned by a random rotation, so that any first dimensions are
a fair sample of a distance.  A list's vectors are stored in chunks, and a
chunk is scanned in blocks of columns: after each block the partial squared
distance of a candidate, scaled up to all dimensions, is tested against the
distance r of the query's current k-th neighbour; a candidate is abandoned when
it exceeds (1 + ``EPSILON`` / sqrt(d))**2 * r**2, which a true neighbour does
only with a small probability.  What is left after the last column is scored
exactly on the original vectors.

Centroids, rotation and the number of probed lists are fitted on a bounded
sample (``SAMPLE`` distinct vectors, chosen by hash); the number of
probes is the smallest that finds the share ``RECALL`` of the sample's true
neighbours.  Every row is indexed: dealt to its list, cut into chunks of bounded
size (a crowded list is salted over many tasks).  Queries are packed into
blocks, in an order that puts near lists side by side, and groups of blocks
of bounded size are broadcast to the chunks of the lists that they probe.  The
queries' home lists are scanned first, which gives each query an r to start
from.  A task keeps the best of each query over all its chunks.

Defined cases: rows with a null id, a null, empty or zero vector, or any
component that is null or not finite take no part; missing trailing components
of shorter vectors count as zero; a query's own row is every row with its id;
a repeated candidate row counts once per row, a repeated query row is one
query (rows that share an id but differ are queries of their own); ties go to
the smaller id; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .common import by_value, small_batches, stored

K = 5
#: Fit: vectors and bytes of the sample, rows aimed at for a list, most lists.
SAMPLE, SAMPLE_BYTES, LIST_ROWS, MAX_LISTS = 4096, 32 << 20, 48, 1024
RECALL, ROUNDS, SEED = 0.98, 10, 20
#: Scan: columns of a block, constant of the hypothesis test, rows of a chunk, queries of a block.
COLUMNS, EPSILON, CHUNK, BLOCK = 16, 2.1, 2048, 256
#: Slack for the single precision of the scan.
SLACK = 1e-4


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), 1e-300)  # squares neither overflow nor vanish
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows side by side, in double precision."""
    scale = lambda m: m / np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), 1e-300)
    safe = lambda m: m if not len(m) or 1e-60 < np.abs(m).max() < 1e60 else scale(m)
    a, b = safe(a), safe(b)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Index:
    """Centroids (in an order that puts near ones side by side), rotation, probes."""

    def __init__(self, centroids: np.ndarray, rotation: np.ndarray, probes: int):
        self.centroids, self.rotation, self.probes = centroids, rotation, probes

    @property
    def parts(self):
        """What travels to the tasks."""
        return self.centroids, self.rotation, self.probes

    @property
    def width(self) -> int:
        return len(self.rotation)

    def home(self, u: np.ndarray) -> np.ndarray:
        return (u @ self.centroids.T).argmax(axis=1)

    def probed(self, u: np.ndarray) -> np.ndarray:
        """bool[query][list]"""
        s = u @ self.centroids.T
        out = np.zeros(s.shape, bool)
        np.put_along_axis(out, np.argsort(-s, axis=1, kind="stable")[:, : self.probes], True, axis=1)
        return out


def _lists(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means; an emptied list starts again at a random vector."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        lost = np.bincount(of, minlength=k) == 0
        total[lost] = x[rng.choice(len(x), int(lost.sum()))]
        c = unit(total)
    order, left = [0], np.ones(k, bool)
    left[0] = False
    while left.any():  # each list's nearest that is not yet placed follows it
        s = np.where(left, c @ c[order[-1]], -np.inf)
        order.append(int(s.argmax()))
        left[order[-1]] = False
    return c[order]


def fit(rows: DataFrame, n: int, width: int, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> Index:
    """The index of ``n`` valid rows (id, vec) from a sample of bounded size."""
    most = max(64, min(sample, SAMPLE_BYTES // max(1, 8 * width)))
    few = rows
    if n > most:
        few = rows.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(1.2 * most / n * (1 << 30)))
    few = few.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(most)
    x = unit(vectors.widened(np.array([_filled(r.vec, width) for r in few.toLocalIterator()]).reshape(-1, width), width))
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    if not len(x):
        return Index(np.ones((1, width)), rotation, 1)
    lists = max(1, min(MAX_LISTS, len(x) // 4, n // LIST_ROWS))
    index = Index(_lists(x, lists, rng), rotation, lists)
    asked = rng.choice(len(x), min(len(x), 512), replace=False)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(x[asked] @ index.centroids.T), axis=1, kind="stable"), axis=1)
    need = np.sort(np.take_along_axis(rank, index.home(x)[near], axis=1).ravel())
    if len(need):
        index.probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1
    return index


def _filled(v, width):
    return np.pad(np.array(v, np.float64), (0, width - len(v)))


def prepared(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    return vecs.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec")).filter(
        F.col("id").isNotNull() & vectors.finite(v) & F.exists(v, lambda x: x != 0))


def chunks(rows: DataFrame, index: Index) -> DataFrame:
    """Rows of up to ``CHUNK`` vectors of one list: ids, original vectors, turned unit vectors."""
    spark = rows.sparkSession
    shared, width = spark.sparkContext.broadcast(index.parts), index.width

    def dealt(batches):
        ix = Index(*shared.value)
        for b in batches:
            u = unit(vectors.widened(vectors.matrix(b.column("vec")), width))
            yield pa.RecordBatch.from_arrays([pa.array(ix.home(u), pa.int32()), b.column("id"), b.column("vec")], ["list", "id", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    lists = stored(rows.mapInArrow(dealt, f"list int, id long, vec {kind}").withColumn("row", F.monotonically_increasing_id()))
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"))  # at most MAX_LISTS rows
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / (4 * CHUNK)))
    spread = lists.join(F.broadcast(sizes), "list").repartition("list", salt).sortWithinPartitions("list").select("list", "id", "vec")

    def packed(number, ids, parts, ix):
        v = np.concatenate([vectors.widened(m, width) for m in parts])
        turned = (unit(v) @ ix.rotation).astype(np.float32)
        return pa.RecordBatch.from_pydict({
            "list": pa.array([number], pa.int32()), "n": pa.array([len(v)], pa.int32()), "ids": [np.concatenate(ids).tobytes()],
            "vecs": [v.tobytes()], "turned": [turned.tobytes()]})

    def run(batches):
        ix, held, of = Index(*shared.value), ([], []), None
        for b in batches:
            lists, ids, v = (b.column("list").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False), vectors.matrix(b.column("vec")))
            cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else []
            for a, z in zip(cuts, [*cuts[1:], len(lists)]):
                if held[0] and of != lists[a]:
                    yield packed(of, *held, ix)
                    held = ([], [])
                of = int(lists[a])
                while a < z:
                    take = min(CHUNK - sum(map(len, held[0])), z - a)
                    held[0].append(ids[a : a + take])
                    held[1].append(v[a : a + take])
                    a += take
                    if sum(map(len, held[0])) == CHUNK:
                        yield packed(of, *held, ix)
                        held = ([], [])
        if held[0]:
            yield packed(of, *held, ix)

    return spread.mapInArrow(run, "list int, n int, ids binary, vecs binary, turned binary")


def blocks(asked: DataFrame, index: Index) -> tuple[DataFrame, int]:
    """(block, q: array of id, vec, home) of the queries, and the number of
    blocks: runs of neighbouring home lists together hold about ``BLOCK``
    queries, a list with more is dealt over several blocks."""
    spark = asked.sparkSession
    shared, width = spark.sparkContext.broadcast(index.parts), index.width

    def at_home(batches):
        for b in batches:
            u = unit(vectors.widened(vectors.matrix(b.column("vec")), width))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(Index(*shared.value).home(u), pa.int32())], ["id", "vec", "home"])

    q = stored(asked.mapInArrow(at_home, f"id long, vec {asked.schema['vec'].dataType.simpleString()}, home int"))
    first, filled, place = 0, 0, []
    for home, n in sorted(map(tuple, q.groupBy("home").count().collect())):  # at most MAX_LISTS rows
        if filled and filled + n > BLOCK:
            first, filled = first + 1, 0
        many = -(-n // BLOCK)
        place.append((home, first, many))
        first, filled = (first + many, 0) if many > 1 else (first, filled + n)
    total = first + bool(filled)
    place = spark.createDataFrame(place or [(0, 0, 1)], "home int, first int, many int")
    number = (F.col("first") + F.pmod(F.xxhash64("id", "vec"), F.col("many"))).cast("int")
    return q.join(F.broadcast(place), "home").groupBy(number.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "vec", "home"))).alias("q")), max(1, total)


class _Queries:
    """A block of queries; ``best`` lives as long as a task."""

    def __init__(self, q: pa.ListScalar, index: Index, k: int, own_list: bool):
        q, width = q.values, index.width
        self.ids = q.field("id").to_numpy(zero_copy_only=False)
        self.vecs = vectors.widened(vectors.matrix(q.field("vec")), width)
        u = unit(self.vecs)
        self.turned = (u @ index.rotation).astype(np.float32)
        home = q.field("home").to_numpy(zero_copy_only=False)
        self.probed = np.arange(len(index.centroids)) == home[:, None] if own_list else index.probed(u)
        self.far = np.full(len(self.ids), np.inf, np.float32)  # squared distance of the k-th neighbour
        if not own_list:
            r = q.field("r").to_numpy(zero_copy_only=False).astype(np.float32)
            self.far = np.where(np.isnan(r), np.inf, r + SLACK).astype(np.float32)
        self.best = vectors.Best(len(self.ids), k, np.float64)

    def scan(self, number: int, ids: np.ndarray, vecs: np.ndarray, turned: np.ndarray) -> None:
        """All queries that probe list ``number`` against one of its chunks."""
        rows = np.flatnonzero(self.probed[:, number])
        if not len(rows):
            return
        q, far, dims = self.turned[rows], self.far[rows, None], turned.shape[1]
        d2 = np.zeros((len(rows), len(ids)), np.float32)
        pair = None  # (query, candidate) of what is left once it is few
        for at in range(0, dims, COLUMNS):
            a, b = q[:, at : at + COLUMNS], turned[:, at : at + COLUMNS]
            seen = min(at + COLUMNS, dims)
            limit = far * (1 if seen == dims else (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dims)
            if pair is None:
                d2 += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
                left = d2 <= limit
                if np.count_nonzero(left) < 0.2 * left.size:
                    pair = np.nonzero(left)
                    part = d2[pair]
            else:
                gap = a[pair[0]] - b[pair[1]]
                part += np.einsum("ij,ij->i", gap, gap)
                stay = part <= limit[pair[0], 0]
                pair, part = (pair[0][stay], pair[1][stay]), part[stay]
        if pair is None:
            pair = np.nonzero(left)
            part = d2[pair]
        pair, part = _nearest(pair, part, self.best.k + 1, len(rows))
        row, col = pair
        other = ids[col] != self.ids[rows[row]]
        row, col = rows[row[other]], col[other]
        self.best.offer(row, ids[col], cosine(self.vecs[row], vecs[col]))
        kth = self.best.scores[rows, -1]
        self.far[rows] = np.minimum(self.far[rows], np.where(np.isfinite(kth), 2 - 2 * kth + SLACK, np.inf))


def _nearest(pair, part, k, rows):
    """Pairs that are no farther than the k-th of their query, within the
    precision of the scan (only these need exact scores)."""
    order = np.lexsort((part, pair[0]))
    row, d = pair[0][order], part[order]
    first = np.searchsorted(row, np.arange(rows))
    end = np.searchsorted(row, np.arange(rows), "right")
    kth = np.where(end - first >= k, d[np.minimum(first + k - 1, max(0, len(d) - 1))] if len(d) else np.inf, np.inf)
    keep = d <= kth[row] + SLACK
    return (row[keep], pair[1][order][keep]), d[keep]


def _search(chunked: DataFrame, blocked: DataFrame, n_blocks: int, index: Index, k: int, own_list: bool) -> DataFrame:
    shared = chunked.sparkSession.sparkContext.broadcast(index.parts)

    def run(batches):
        state: dict[int, _Queries] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("block", "list", "n", "ids", "vecs", "turned")}
                if row["block"] not in state:
                    state[row["block"]] = _Queries(b.column("q")[i], Index(*shared.value), k, own_list)
                state[row["block"]].scan(
                    row["list"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"]).reshape(row["n"], -1),
                    np.frombuffer(row["turned"], np.float32).reshape(row["n"], -1))
        for number, block in state.items():
            query, rank, ids, score = block.best.found()
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(query), number), pa.int32()), "query": pa.array(query, pa.int32()), "rank": pa.array(rank, pa.int32()),
                "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    parts = [p.mapInArrow(run, "block int, query int, rank int, id long, score double")
             for p in vectors.pairs(chunked, blocked, n_blocks, BLOCK * (9 * index.width + 64))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("block", "query").orderBy(F.desc("score"), "id", "rank")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vecs: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows found of every row that satisfies ``query`` (a
    condition on ``id``): query_id, rank, vec_id, score (cosine)."""
    spark: SparkSession = vecs.sparkSession
    by_value(__name__, vectors.__name__)
    small_batches(spark)
    rows = prepared(vecs, id_col, vec_col)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    index = fit(rows, n, width, k, recall, sample)
    chunked = stored(chunks(rows, index))
    blocked, n_blocks = blocks(rows.filter(query).distinct(), index)
    blocked = stored(blocked)
    home = stored(_search(chunked, blocked, n_blocks, index, k, True))
    # Squared distance of the k-th neighbour in the home list, where it has so many.
    r = home.filter(F.col("rank") == k).select("block", "query", (2 - 2 * F.col("score")).alias("r"))
    started = blocked.select("block", F.posexplode("q").alias("query", "q")).join(r, ["block", "query"], "left").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("query", "q.id", "q.vec", "q.home", "r"))).alias("q"))
    found = _search(chunked, stored(started), n_blocks, index, k, False)
    names = blocked.select("block", F.posexplode("q").alias("query", "q")).select("block", "query", F.col("q.id").alias("query_id"))
    return found.join(names, ["block", "query"]).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
