"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy.

Subwords are the byte 2- to 4-grams of the lower-cased text in which all but
letters became spaces.  A text's vector is the mean of its grams' embeddings.
Training uses at most ``SAMPLE`` labelled texts of each language (the bound is
a parameter); their grams are counted on the executors, so only bounded
vectors reach the driver.  A fifth of the sample is not trained on: it fits the
softmax temperature and the rejection.

Rejection looks at the softmax score, which is high for whatever lies on one
side, and at how usual a text's grams are in the language found: their mean log
frequency against that language's own texts, where short texts are drawn to its
mean.  Each has a threshold, set on the kept fifth, on the same texts with their
letters shuffled, and on each language's texts with that language not to choose.  The
threshold lies below all but ``REJECTED`` / 2 of the correct texts, and in the
middle of the gap where the others leave one.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
is rejected; if no labelled text exists every text is ``und``; very long texts
are read whole, in blocks; repeated rows get equal rows; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import bounded_sample, by_value, small_batches

BUCKETS, DIM, ORDERS = 1 << 13, 16, (2, 3, 4)
SAMPLE, MAX_LANGUAGES = 400, 64
EPOCHS, RATE, BATCH = 12, 0.2, 32
REJECTED, UNKNOWN = 0.01, "und"
#: Grams at the language's mean that are added to a text's own.
DRAWN = 20
#: Characters of a text that are shuffled.
JUNK = 10_000

LETTER = re.compile(r"[^\W\d_]")
#: Letters keep their (lower-cased) bytes, everything else is one separator.
TABLE = textops.byte_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
#: Odd multipliers of the gram hash.
MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _buckets(x: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (n - 1 fewer than bytes)."""
    h = np.full(len(x) - n + 1, n, np.uint32)
    for j in range(n):
        h = h * MIX[0] + x[j : j + len(h)]
    h ^= h >> np.uint32(15)
    h *= MIX[1]
    return (h >> np.uint32(32 - 13)).astype(np.int32)


def _blocks(texts: list[str]):
    """(bytes, gram starts, text of each start's run) block by block: arrays
    x, number of usable starts, and the texts' bounds within them."""
    rows = [b" " + t.lower().encode("utf-8", "replace").translate(TABLE).replace(b"\0", b" ") + b"   " for t in texts]
    buf = b"".join(rows)
    a = np.frombuffer(buf, np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    for at in range(0, len(a), textops.BLOCK):
        stop = min(at + textops.BLOCK, len(a))
        first, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, stop, "left")
        cut = np.clip(bounds[first : last + 1], at, stop) - at
        yield a[at : stop + max(ORDERS) - 1], stop - at, first, cut


def _each_order(x, n_starts):
    """(buckets, valid) of each order; a gram needs a letter in its first two
    bytes, so separators add nothing and no gram spans two texts."""
    letter = x != 0x20
    ok = letter.copy()
    ok[:-1] |= letter[1:]
    for n in ORDERS:
        if len(x) >= n:
            b = _buckets(x.astype(np.uint32), n)[:n_starts]
            yield b, ok[: len(b)]


def gram_counts(text: str) -> np.ndarray:
    """Counts of the text's grams by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for x, n, _, _ in _blocks([text]):
        for b, ok in _each_order(x, n):
            out += np.bincount(b[ok], minlength=BUCKETS)
    return out


class Model:
    """``table`` = embeddings times output weights, already divided by the
    temperature; ``bias`` likewise.  ``usual`` holds each language's log gram
    frequencies less their mean over its texts."""

    def __init__(self, langs, table, bias, threshold, usual, least):
        self.langs, self.table, self.bias, self.threshold, self.usual, self.least = langs, table, bias, threshold, usual, least

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, usualness) of each text in each language."""
        k = len(self.langs)
        total, n = np.zeros((2, len(texts), k)), np.zeros(len(texts))
        for x, starts, first, cut in _blocks(texts):
            for b, ok in _each_order(x, starts):
                bounds = np.minimum(cut, len(b))
                rows = np.arange(first, first + len(cut) - 1)
                add = lambda v: np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.float64)))[bounds])
                n[rows] += add(ok)
                b = np.where(ok, b, BUCKETS)
                for i in range(k):
                    total[0, rows, i] += add(self.table[i][b])
                    total[1, rows, i] += add(self.usual[i][b])
        return total[0] / np.maximum(n, 1)[:, None] + self.bias, total[1] / (n + DRAWN)[:, None]

    def predict(self, texts: list[str | None]):
        """(language, score, rejected) of each text."""
        blank = [t is None or not LETTER.search(t) for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        z, usual = self.logits([t or "" for t in texts])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(UNKNOWN, 0.0, True) if e else (self.langs[k], min(1.0, float(q[k])), bool(q[k] < self.threshold or u[k] < self.least))
                for e, k, q, u in zip(blank, best.tolist(), p, usual)]


def threshold(right: np.ndarray, other: np.ndarray) -> float:
    """Below all but ``REJECTED`` / 2 of ``right``; if nearly all of ``other``
    lie lower still, in the middle of the gap."""
    if not len(right):
        return -math.inf
    low = float(np.sort(right)[int(REJECTED / 2 * len(right))])
    high = float(np.quantile(other, 0.99)) if len(other) else low
    return (low + high) / 2 if high < low else low


def shuffled(text: str, seed: int) -> str:
    """``text`` with its letters in any order, the rest where it was."""
    at = [m.start() for m in LETTER.finditer(text, 0, JUNK)]
    out = list(text[:JUNK])
    letters = [out[i] for i in at]
    random.Random(seed).shuffle(letters)
    for i, c in zip(at, letters):
        out[i] = c
    return "".join(out)


def fit(langs: list[str], x: np.ndarray, y: np.ndarray, check: np.ndarray, n: np.ndarray, junk: np.ndarray, junk_n: np.ndarray,
        seed: int = 7) -> Model:
    """Train on rows of mean gram frequencies ``x`` of ``n`` grams with classes
    ``y``; ``check`` marks the rows kept for calibration.  ``junk`` and
    ``junk_n`` are of texts in no language."""
    if not langs:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0), 1.0, np.zeros((0, BUCKETS + 1), np.float32), 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    fitted = np.flatnonzero(~check) if (~check).any() else np.arange(len(y))
    seen = [np.full_like(v, 1e-8) for v in (emb, out, bias)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(fitted), max(1, len(fitted) // BATCH)):
            v = x[part] @ emb
            z = v @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            # Step sizes by parameter: rare grams move as far as common ones.
            for param, total, grad in zip((emb, out, bias), seen, (x[part].T @ (p @ out.T), v.T @ p, p.sum(axis=0))):
                total += grad * grad
                param -= rate * grad / np.sqrt(total)
    table = (emb @ out).T
    held = np.flatnonzero(check) if check.any() else fitted
    z, want = x[held] @ table.T + bias, y[held]

    def soft(z, t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(soft(z, t)[np.arange(len(held)), want], 1e-12)).mean()
    t = min(np.geomspace(0.05, 20, 61), key=loss)
    # Texts weigh alike, however long; no gram is impossible.
    usual = np.zeros((len(langs), BUCKETS), np.float32)
    for k in range(len(langs)):
        own = x[fitted[y[fitted] == k]]
        freq = (own.sum(axis=0) + 1 / BUCKETS) / (len(own) + 1)
        log = np.log(freq / freq.sum())
        usual[k] = log - (own @ log).mean() if len(own) else log

    def found(rows, size, z, among):
        """Score and usualness in the best of the languages ``among``."""
        p, u = soft(z[:, among], t), rows @ usual[among].T * (size / (size + DRAWN))[:, None]
        best = p.argmax(axis=1)
        return best, p.max(axis=1), u[np.arange(len(rows)), best]

    every = np.arange(len(langs))
    best, score, own = found(x[held], n[held], z, every)
    right = best == want
    others = [found(junk, junk_n, junk @ table.T + bias, every)[1:]] if len(junk) else []
    for k in every if len(langs) > 1 else ():
        of = want == k
        if of.any():
            others.append(found(x[held[of]], n[held[of]], z[of], every[every != k])[1:])
    other = [np.concatenate([o[i] for o in others]) if others else np.zeros(0) for i in (0, 1)]
    wide = lambda v: np.concatenate((v, np.zeros((len(langs), 1))), axis=1).astype(np.float32)
    return Model(langs, wide(table / t), (bias / t).astype(np.float64), threshold(score[right], other[0]), wide(usual), threshold(own[right], other[1]))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = SAMPLE) -> Model:
    """Model from the labelled rows that ``learn`` selects: of each language
    the ``per_language`` rows with the smallest hash of id and text."""
    by_value(__name__, textops.__name__)
    small_batches(docs.sparkSession)
    known = docs.filter(learn).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)).alias("h")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    some = bounded_sample(known, "lang", per_language, sizes, F.col("h"))

    def run(batches):
        for b in batches:
            rows = []
            for lang, text, h in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "h"))):
                for t, junk in ((text, False), (shuffled(text, h), True)) if h % 5 == 0 else ((text, False),):
                    if LETTER.search(t):
                        n = gram_counts(t)
                        at = np.flatnonzero(n)
                        rows.append((lang, h, junk, int(n.sum()), at.astype("<i2").tobytes(), (n[at] / n.sum()).astype("<f4").tobytes()))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["lang", "h", "junk", "n", "at", "share"])

    rows = some.select("lang", "text", "h").mapInArrow(run, "lang string, h long, junk boolean, n long, at binary, share binary").collect()
    rows = sorted(rows, key=lambda r: (r.junk, *r))
    langs = sorted({r.lang for r in rows})
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, "<i2")] = np.frombuffer(r.share, "<f4")
    y, n = np.array([langs.index(r.lang) for r in rows], np.int64), np.array([r.n for r in rows], np.float64)
    check, real = np.array([r.h % 5 == 0 for r in rows], bool), sum(not r.junk for r in rows)
    return fit(langs, x[:real], y[:real], check[:real], n[:real], x[real:], n[real:])


def _predictor(spark, model: Model):
    blob = pickle.dumps((model.langs, model.table, model.bias, model.threshold, model.usual, model.least))
    shared, key = spark.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()
    return lambda: textops.stash(("langid", key), lambda: Model(*pickle.loads(shared.value)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each document."""
    by_value(__name__, textops.__name__)
    small_batches(docs.sparkSession)
    get = _predictor(docs.sparkSession, model)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        model = get()
        for b in batches:
            p = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([x[0] for x in p], pa.string()), pa.array([x[1] for x in p], pa.float64()),
                pa.array([x[2] for x in p], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns kept."""
    by_value(__name__, textops.__name__)
    small_batches(docs.sparkSession)
    get, at = _predictor(docs.sparkSession, model), docs.columns.index(text_col)

    def run(batches):
        model = get()
        for b in batches:
            yield b.filter(pa.array([not x[2] for x in model.predict(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))
