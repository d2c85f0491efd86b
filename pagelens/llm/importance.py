"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its words and runs of two consecutive words; a feature's
bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  Source and target counts
of the buckets give every bucket a gain, the texts' mean gain is their weight,
and the weights plus Gumbel noise from a hash of the id decide, so the highest
scores are a draw without replacement (weights are per word, in thousandths).

Texts are read in batches: a batch's texts are joined with separators, one
regex pass finds all words, and the documents' offsets, looked up by binary
search, mask word pairs that cross a border before the buckets are counted.
A text longer than a batch is cut behind a word into pieces; each further piece
begins with the last word of the one before, which counts only as the first
half of a pair, so memory is bounded and every text is counted whole.

The corpus is counted in one pass and scored in a second; between them stand
``BUCKETS`` rows.  Scores are ranked by a range-partitioned sort with the
partitions' sizes as offsets.

Defined cases: null and empty texts have no features and weight 0; ids are
hashed by their decimal text, a null id as the empty string, and rank after
all others; equal rows get consecutive ranks; a document needs ``MIN_WORDS``
words to be drawn; empty tables work (without a target every gain compares
with nothing but the added ones); only the named columns are read.
"""

from __future__ import annotations

import re
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, free_names, small_batches, stored

BUCKETS, MIN_WORDS, SHARE, SEED = 10_000, 20, 25, 7

#: Bytes of joined texts that one regex pass reads.
BATCH = 1 << 20

#: Words of lower-cased UTF-8: digits, a-z and every byte of non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Where a long text may be cut (upper-case letters are words once lower-cased).
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _read(pieces: list[bytes], carried: list[bool]):
    """Of joined pieces: buckets of all features, the piece that each belongs
    to, and the last word.  ``carried``: the first word is known already."""
    found = list(WORD.finditer(b"\0".join(pieces).lower()))  # bytes.lower changes A-Z only
    words = [m[0] for m in found]
    offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
    of = np.searchsorted(offsets, np.array([m.start() for m in found], np.int64), "right") - 1
    one = list(map(crc32, words))
    two = list(map(crc32, words[1:], map(crc32, repeat(b" "), one)))  # continued over a space
    fresh = np.ones(len(words), bool)
    known = np.flatnonzero(carried)
    fresh[np.searchsorted(of, known)] = False
    joined = of[1:] == of[:-1]
    crc = np.concatenate((np.array(one, np.int64)[fresh], np.array(two, np.int64)[joined]))
    return crc % BUCKETS, np.concatenate((of[fresh], of[1:][joined])), words[-1] if words else b""


def features(texts: list[bytes]):
    """(text number, bucket) arrays of all features, a batch at a time."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        if len(text) <= BATCH:
            held.append(text)
            numbers.append(number)
            size += len(text) + 1
            if size > BATCH:
                buckets, of, _ = _read(held, [False] * len(held))
                yield np.array(numbers)[of], buckets
                held, numbers, size = [], [], 0
            continue
        at, last = 0, b""
        while at < len(text):
            cut = NO_WORD.search(text, at + BATCH)
            stop = cut.start() if cut else len(text)
            buckets, of, word = _read([last + text[at:stop]], [bool(last)])
            yield np.full(len(buckets), number), buckets
            at, last = stop, word
    if held:
        buckets, of, _ = _read(held, [False] * len(held))
        yield np.array(numbers)[of], buckets


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) of the buckets that occur; a task sends its sums once."""
    by_value(__name__)
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, buckets in features([t or b"" for t in b.column(0).to_pylist()]):
                total += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all ``BUCKETS`` buckets from two tables of counts."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))).unionByName(
        source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    one = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every = Window.partitionBy()  # BUCKETS rows
    ratio = ((F.col("t") + 1) * (F.sum("s").over(every) + BUCKETS)) / ((F.col("s") + 1) * (F.sum("t").over(every) + BUCKETS))
    return one.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_features and weight (floored mean gain) of every row."""
    by_value(__name__)
    spark = docs.sparkSession
    small_batches(spark)
    table = np.zeros(BUCKETS)
    for r in gain.collect():  # BUCKETS rows
        table[r.bucket] = r.gain
    shared = spark.sparkContext.broadcast(table)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        table = shared.value
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for of, buckets in features([t or b"" for t in b.column("t").to_pylist()]):
                n += np.bincount(of, minlength=b.num_rows)
                total += np.bincount(of, table[buckets], minlength=b.num_rows).astype(np.int64)  # whole numbers below 2**53
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "text_key", "n_features", "weight"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_key long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of ``key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame) -> DataFrame:
    """With ``rank``: 1, 2, 3... by score downwards, then doc_id.

    Sorted ranges are stored with each row's place in its range; the sizes of
    the ranges, a row each, give the offsets.
    """
    n = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("_salt")]
    placed = stored(scored.withColumn("_salt", F.rand(0)).repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "rank", F.col("_before") + index + 1).drop("_part", "_before", "_at")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
         share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every row: doc_id, text_key, n_features, weight, score, rank (null if
    not drawn).  ``share`` per cent of the rows with ``min_words`` words are drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = stored(weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    long = F.col("n_features") >= 2 * min_words - 1  # words, and one pair less
    most = scored.filter(long).count() * share // 100
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    return ranked(scored.filter(long)).withColumn("rank", rank).unionByName(
        scored.filter(~long).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; copies of a drawn row
    with its id and text come along."""
    i, k = free_names(docs, "_llm_id", "_llm_key")
    drawn = draw(docs, target, id_col, text_col, **kw).filter(F.col("rank").isNotNull()).select(
        F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    return docs.join(drawn, [F.col(id_col).eqNullSafe(F.col(i)), F.xxhash64(F.col(text_col)) == F.col(k)], "left_semi")
