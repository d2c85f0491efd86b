"""Toxicity severity by cumulative-link ordinal regression.

A text's features are its words and the 4- and 6-byte beginnings of longer
words, hashed to ``BUCKETS``.  The grades 0 to 3 are ordered:

* 0: labelled not toxic;
* 1 to 3: labelled toxic, by how often features occur in the text that occur
  mainly in toxic training texts, cut at the terciles of the toxic texts.

One weight vector is shared by all thresholds: P(grade > k) = s(w.x - c_k) with
c_0 < c_1 < c_2.  The output is the expected severity, the sum of the three.

Fitted in numpy on at most ``SAMPLE`` labelled texts of each class (the bound
is a parameter); features are extracted on the executors, and rows are weighted
back to the class sizes counted over all labels.

Defined cases: null and empty texts have no features and severity by the
thresholds alone; without labels of both classes every severity is 0; very long
texts are read whole; repeated rows get equal rows; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import bounded_sample, by_value, small_batches, stored

BITS = 18
BUCKETS = 1 << BITS
PREFIXES = (4, 6)
SAMPLE = 2000
FEATURES, MIN_TEXTS, EVIDENCE, GRADES = 1024, 3, 8.0, 3
STEPS, RATE, L2 = 600, 0.1, 1e-4

#: Words are runs of letters (all non-ASCII bytes count as letters).
TABLE = textops.byte_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def features(texts: list[bytes]):
    """(word, 3) buckets of all words, -1 for none; where each text's words begin."""
    w = textops.words(texts, TABLE, PREFIXES)
    long = w.ends - w.starts
    parts = [w.hashes] + [np.where(long > k, p, 0) for k, p in zip(PREFIXES, w.prefixes)]
    # A shorter word has no beginning of its own: bucket -1.
    cols = [((h ^ np.uint64(i * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            for i, h in enumerate(parts)]
    for k, c in zip(PREFIXES, cols[1:]):
        c[long <= k] = -1
    return np.stack(cols, axis=1), w.first


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.chosen, self.weights, self.cuts = chosen, weights, cuts
        self.place = np.full(BUCKETS + 1, -1, np.int32)  # the last stands for bucket -1
        self.place[chosen] = np.arange(len(chosen))

    def severity(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text, one column per threshold."""
        if not len(self.cuts):
            return np.zeros((len(texts), GRADES))
        f, first = features(texts)
        at = self.place[f]
        row, _ = np.nonzero(at >= 0)
        place = at[at >= 0]
        text = np.searchsorted(first, row, "right") - 1
        key, n = np.unique(text * len(self.chosen) + place, return_counts=True)
        z = np.bincount(key // max(1, len(self.chosen)), np.log1p(n) * self.weights[key % max(1, len(self.chosen))], len(texts))
        return _sigmoid(z[:, None] - self.cuts)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(w, cuts): maximum likelihood by Adam.  cuts = c_0 and positive gaps."""
    n, d = x.shape
    w, c = np.zeros(d), np.concatenate(([0.0], np.zeros(grades - 1)))
    state = [np.zeros(d), np.zeros(d), np.zeros(grades), np.zeros(grades)]
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate((c[:1], np.exp(c[1:]))))
        above = np.concatenate((np.ones((n, 1)), _sigmoid((x @ w)[:, None] - cuts), np.zeros((n, 1))), axis=1)
        rows = np.arange(n)
        hi, lo = above[rows, y], above[rows, y + 1]  # P(>= y) and P(> y)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        gz = dlo - dhi  # of the negative log likelihood by z
        gcut = np.zeros(grades)
        np.add.at(gcut, (y - 1)[y > 0], dhi[y > 0])
        np.add.at(gcut, y[y < grades], -dlo[y < grades])
        tail = np.cumsum(gcut[::-1])[::-1]
        gc = np.concatenate((tail[:1], tail[1:] * np.exp(c[1:])))
        for v, g, i in ((w, x.T @ gz + L2 * w, 0), (c, gc, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * g * g
            v -= RATE * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-8)
    return w, np.cumsum(np.concatenate((c[:1], np.exp(c[1:]))))


def _sparse(texts: list[bytes]):
    """(buckets, counts) of each text."""
    f, first = features(texts)
    for a, b in zip(first, first[1:]):
        own = f[a:b].ravel()
        at, n = np.unique(own[own >= 0], return_counts=True)
        yield at.astype("<i4"), n.astype("<i4")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = SAMPLE) -> Model:
    by_value(__name__, textops.__name__)
    small_batches(docs.sparkSession)
    flags = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).distinct()
    sizes = {r.toxic: r["count"] for r in flags.groupBy("toxic").count().collect()}
    some = stored(bounded_sample(flags, "toxic", per_class, sizes, F.lit("toxicity"), F.col("doc_id")))
    # At most 2 * per_class narrow rows.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches):
        for b in batches:
            s = list(_sparse([t or b"" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([x[0].tobytes() for x in s], pa.binary()),
                 pa.array([x[1].tobytes() for x in s], pa.binary())], ["doc_id", "toxic", "at", "n"])

    got = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic boolean, at binary, n binary")
    # A doc_id may have many rows; one of its texts is enough.
    got = got.groupBy("doc_id").agg(F.min(F.struct("toxic", "at", "n")).alias("r")).select("r.*").collect()
    return fit(sorted((r.toxic, bytes(r.at), bytes(r.n)) for r in got), sizes)


def fit(rows: list[tuple], sizes: dict) -> Model:
    bad = np.array([r[0] for r in rows], bool)
    if not bad.any() or bad.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    at, n = [np.frombuffer(r[1], "<i4") for r in rows], [np.frombuffer(r[2], "<i4") for r in rows]
    texts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for k, a in zip(bad, at):
        texts[int(k)][a] += 1
    share = [(texts[k] + 0.5) / ((bad == bool(k)).sum() + 1) for k in (0, 1)]
    gain = np.log(share[1] / share[0])
    # Features that tell the classes apart beyond chance (likelihood ratio test).
    pooled = (texts[0] + texts[1] + 1) / (len(rows) + 2)
    size = [(~bad).sum(), bad.sum()]
    value = 2 * sum(size[k] * (share[k] * np.log(share[k] / pooled) + (1 - share[k]) * np.log(np.maximum(1 - share[k], 1e-12) / (1 - pooled)))
                    for k in (0, 1))
    value[texts[0] + texts[1] < min(MIN_TEXTS, size[1])] = 0
    chosen = np.argsort(-value, kind="stable")[:FEATURES]
    chosen = chosen[value[chosen] > EVIDENCE]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    strong = np.zeros(BUCKETS, bool)
    strong[chosen] = gain[chosen] > np.log(5)
    x, much = np.zeros((len(rows), len(chosen))), np.zeros(len(rows))
    for i, (a, c) in enumerate(zip(at, n)):
        k = place[a]
        x[i, k[k >= 0]] = np.log1p(c[k >= 0])
        much[i] = c[strong[a]].sum()
    edges = np.quantile(much[bad], [1 / 3, 2 / 3])
    y = np.where(bad, 1 + np.searchsorted(edges, much, "left"), 0)
    weight = np.where(bad, sizes.get(True, 1) / bad.sum(), sizes.get(False, 1) / (~bad).sum())
    w, cuts = fit_ordinal(x, y, weight)
    return Model(chosen, w, cuts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity 0..3, grade, toxic) of each document: grade is the
    most probable one, toxic means that a grade above 0 is more likely."""
    by_value(__name__, textops.__name__)
    spark = docs.sparkSession
    small_batches(spark)
    blob = pickle.dumps((model.chosen, model.weights, model.cuts))
    shared, key = spark.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        model = textops.stash(("toxicity", key), lambda: Model(*pickle.loads(shared.value)))
        for b in batches:
            p = model.severity([t or b"" for t in b.column("text").to_pylist()])
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)],
                ["doc_id", "severity", "grade", "toxic"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean")
