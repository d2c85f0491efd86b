"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
Documents and benchmark items are winnowed alike: the minimum hash of k-grams
in every window of w consecutive k-grams is kept, with k + w - 1 = ``SPAN``
words, so every shared span of ``SPAN`` words shares a kept fingerprint.  Hits
are extended along their diagonal word by word, and runs of at least ``SPAN``
equal words are marked.  Items shorter than ``SPAN`` are matched whole.

The benchmark is a stated query set: it is cut into overlapping segments of
bounded size, dealt into blocks of about ``BLOCK_BYTES``, and each block is
broadcast against all documents.  With one block (the usual case) nothing is
shuffled; with more, the marks of a document are united by a shuffle.

Defined cases: null and empty texts have no words; a null item_id counts as
the empty string; repeated documents get a row each; repeated items count once
per item_id; empty tables work; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import ascii_lower, by_value, free_names, maybe_broadcast, small_batches, stored

SPAN = 10
SEGMENT_WORDS = 4096
BLOCK_BYTES = 8 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class as a byte table: digits, a-z and all bytes of non-ASCII.
TABLE = textops.byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

MARKS = "n_words long, hits array<int>, items array<string>"


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions whose k-gram hash is the minimum of some window of w."""
    if not len(g):
        return np.zeros(0, np.int64)
    n = max(1, len(g) - w + 1)
    low = g[:n].copy()
    for j in range(1, min(w, len(g))):
        np.minimum(low, g[j : j + n], out=low)
    keep = np.zeros(len(g), bool)
    for j in range(min(w, len(g))):
        keep[j : j + n] |= g[j : j + n] == low
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of one block of benchmark segments."""

    def __init__(self, segments: list[tuple[str, str]], span: int):
        self.span, self.k = span, (span + 1) // 2
        self.w = span - self.k + 1
        self.ids = [i for i, _ in segments]
        t = textops.words([s.encode() for _, s in segments], TABLE)
        self.t = t
        fp, where, short = [], [], {}
        for s in range(len(segments)):
            a, b = t.first[s], t.first[s + 1]
            if b - a < span:
                if b > a:
                    short.setdefault(int(b - a), []).append(s)
                continue
            g = textops.grams(t.hashes[a:b], self.k)
            keep = winnow(g, self.w)
            fp.append(g[keep])
            where.append(np.column_stack((np.full(len(keep), s), keep)))
        fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
        where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(fp, kind="stable")
        self.fp, self.where = fp[order], where[order]
        self.short = {}
        for n, segs in short.items():
            h = np.array([textops.grams(t.hashes[t.first[s] : t.first[s + 1]], n)[0] for s in segs], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], np.array([(segs[i], 0) for i in order])

    def candidates(self, d):
        """(document word, segment, segment word) of every shared fingerprint."""
        g = textops.grams(d.hashes, self.k)
        yield from _lookup(g, winnow(g, self.w), self.fp, self.where)
        for n, (fp, where) in self.short.items():
            g = textops.grams(d.hashes, n)
            yield from _lookup(g, np.arange(len(g)), fp, where)

    def marks(self, texts: list[bytes]):
        """Per text: number of words, hit word positions, item ids."""
        d = textops.words(texts, TABLE)
        n = len(texts)
        hits, items, seen = [[] for _ in range(n)], [set() for _ in range(n)], set()
        for p, s, q in self.candidates(d):
            doc = int(np.searchsorted(d.first, p, "right")) - 1
            if (doc, s, p - q) in seen:  # one diagonal is extended once
                continue
            seen.add((doc, s, p - q))
            a, b = d.first[doc], d.first[doc + 1]
            i, j = self.t.first[s], self.t.first[s + 1]
            back, ahead = min(p - a, q), min(b - p, j - i - q)
            x, y = p - back, i + q - back
            same = d.hashes[x : p + ahead] == self.t.hashes[y : i + q + ahead]
            need = min(self.span, j - i)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            for u, v in zip(edge[::2], edge[1::2]):
                if v - u >= need and _span(d, x + u, x + v) == _span(self.t, y + u, y + v):
                    hits[doc].append(np.arange(x + u - a, x + v - a))
                    items[doc].add(self.ids[s])
        for doc in range(n):
            h = np.unique(np.concatenate(hits[doc])) if hits[doc] else ()
            yield int(d.first[doc + 1] - d.first[doc]), h, sorted(items[doc])


def _span(t, i, j) -> bytes:
    return b" ".join(t.buf[s:e] for s, e in zip(t.starts[i:j], t.ends[i:j]))


def _lookup(g, positions, fp, where):
    if not len(fp) or not len(positions):
        return
    h = g[positions]
    lo = np.searchsorted(fp, h, "left")
    found = np.flatnonzero(fp[np.minimum(lo, len(fp) - 1)] == h)
    hi = np.searchsorted(fp, h[found], "right")
    for k, end in zip(found.tolist(), hi.tolist()):
        p = int(positions[k])
        for s, q in where[lo[k] : end].tolist():
            yield p, s, q


def segments(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(item_id, segment): words of an item in overlapping pieces that together
    hold all its windows of ``span`` words."""
    w = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    one = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), w.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - span, F.lit(0))
    return one.select("item_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(SEGMENT_WORDS))).alias("at")).select(
        "item_id", F.array_join(F.slice("w", F.col("at") + 1, F.lit(SEGMENT_WORDS + span - 1)), " ").alias("segment")).distinct()


def _blocks(bench: DataFrame, id_col: str, text_col: str, span: int, block_bytes: int):
    """Broadcast variables of bounded size that together hold the benchmark."""
    s = segments(bench, id_col, text_col, span)
    spark = bench.sparkSession
    total = s.agg(F.sum(F.octet_length("segment") + 32)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = s.filter(F.pmod(F.xxhash64("item_id", "segment"), F.lit(n)) == k)
        rows = sorted((r.item_id, r.segment) for r in part.collect())
        digest = hashlib.sha256(repr(rows).encode()).hexdigest()
        yield n, spark.sparkContext.broadcast((digest, span, rows))


def _index(block) -> Index:
    digest, span, rows = block.value
    return textops.stash(("decontam", digest, span), lambda: Index(rows, span))


def document_marks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", bench_text_col: str = "text", span: int = SPAN,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word positions inside
    benchmark windows, from 0), items (ids, sorted as strings)."""
    spark = docs.sparkSession
    by_value(__name__, textops.__name__)
    small_batches(spark)
    many, parts = 1, []
    for many, block in _blocks(bench, item_col, bench_text_col, span, block_bytes):
        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
        schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_key long, {MARKS}"

        def run(batches, block=block):
            index = _index(block)
            for b in batches:
                texts = [t or b"" for t in b.column("text").to_pylist()]
                marks = list(index.marks(texts))
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("text_key"), pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.list_(pa.int32())),
                    pa.array([m[2] for m in marks], pa.list_(pa.string()))], ["doc_id", "text_key", "n_words", "hits", "items"])

        parts.append(d.mapInArrow(run, schema))
    if many == 1:
        return parts[0].drop("text_key")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # Rows with the same doc_id and text have the same marks: unite, then repeat.
    one = every.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / many).cast("int").alias("copies"))
    return one.select("doc_id", "n_words", F.array_sort("hits").alias("hits"), F.array_sort("items").alias("items"),
                      F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def clean_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept."""
    mark, i, k = free_names(docs, "_llm_row", "_llm_i", "_llm_k")
    keyed = docs.withColumn(mark, F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("k")))
    hit = document_marks(keyed, bench, mark, text_col, **kw).filter(F.size("hits") > 0).select("doc_id").distinct()
    hit = stored(hit.select(F.col("doc_id.i").alias(i), F.col("doc_id.k").alias(k)))
    return keyed.join(maybe_broadcast(hit), [F.col(f"{mark}.i").eqNullSafe(F.col(i)),
                                             F.col(f"{mark}.k") == F.col(k)], "left_anti").drop(mark)
