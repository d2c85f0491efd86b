"""Sharding by jump consistent hashing (DataFrame functions only).

``shard = jump(xxhash64(key), n)``: no ring table, and going from n to n + 1
shards moves rows only into the new shard.  The 64-bit linear congruential
step of the hash is done on two 32-bit halves, as Spark's multiplication does
not wrap.

Slots number the rows of each shard without gaps and without sorting a shard
in one task: rows are pre-aggregated by (key, size, crc), dealt into chunks by
the top bits of the hash of all three (so a key that holds many rows lies in many chunks), numbered
within a chunk, and shifted by the sizes of the chunks before it.  Copies are
unfolded in blocks of bounded size.

Defined cases: a null key is a key of its own; null text has size 1 and CRC 0;
repeated rows get consecutive slots; an empty table gives an empty result;
other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The hash's multiplier 2862933555777941757 in 16-bit limbs, highest first.
MULTIPLIER = 2862933555777941757
M3, M2, M1, M0 = ((MULTIPLIER >> s) & 0xFFFF for s in (48, 32, 16, 0))

#: Steps done at most.  A key needs ln(n) steps on average and n at most; for
#: more shards than this a key that is not done raises instead of going wrong.
MAX_STEPS = 256

#: Rows of one chunk in the numbering of slots, on average.
CHUNK_ROWS = 50_000

#: Copies of one row that are unfolded at once.
BLOCK_COPIES = 10_000


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 mod 2**64, halves of 32 bits in longs."""
    mask32, mask16 = _long(0xFFFFFFFF), _long(0xFFFF)
    t0, t1 = lo * M0, lo * M1
    low = t0 + F.shiftleft(t1.bitwiseAND(mask16), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
    cross = (hi * M0 + F.shiftleft((hi * M1).bitwiseAND(mask16), 16)
             + lo * M2 + F.shiftleft((lo * M3).bitwiseAND(mask16), 16))
    return (carry + cross).bitwiseAND(mask32), low.bitwiseAND(mask32)


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard in 0..n_shards-1 of a 64-bit key."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(0xFFFFFFFF)).alias("lo"),
        _long(0).alias("b"), _long(0).alias("j"))

    def step(s, _):
        hi, lo = _step(s["hi"], s["lo"])
        # The upper 31 bits of the state choose how far the key jumps.
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("bigint").alias("j"))
        return F.when(s["j"] < n_shards, moved).otherwise(s)

    steps = min(n_shards, MAX_STEPS)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    done = F.when(end["j"] >= n_shards, end["b"])
    if n_shards > MAX_STEPS:
        done = F.coalesce(done, F.raise_error(F.lit("jump hash: more steps needed")).cast("bigint"))
    return done.cast("int")


def with_shard(df: DataFrame, key_col: str, n_shards: int, shard_col: str = "shard") -> DataFrame:
    """``df`` with its shard in ``shard_col``; all columns stay."""
    return df.withColumn(shard_col, jump_hash(F.xxhash64(F.col(key_col)), n_shards))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    # Grouping identical (key, size, crc) first: a key that holds many rows
    # costs one row per task in the shuffles below.
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    h = F.xxhash64("doc_id")
    d = d.select("*", h.alias("h"), jump_hash(h, n_shards).alias("shard"), jump_hash(h, n_shards + 1).alias("grown_shard"))
    d = d.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32"))
    # A power of two of chunks in each shard, by the hash's top bits.
    per_shard = max(1, docs.count() // (n_shards * chunk_rows))
    bits = max(1, (per_shard - 1).bit_length())
    d = d.withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    sizes = d.groupBy("shard", "chunk").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("shard").alias("_s"), F.col("chunk").alias("_c"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = (Window.partitionBy("shard", "chunk").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("rank", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    start = F.col("offset") + F.col("rank")
    return (
        d.join(F.broadcast(offsets) if n_shards << bits <= 200_000 else offsets,
               [F.col("shard") == F.col("_s"), F.col("chunk") == F.col("_c")])
        .select("doc_id", "size", "text_crc32", "shard", "grown_shard", (start + F.col("copies") - 1).alias("last"),
                F.explode(F.sequence(start, start + F.col("copies") - 1, F.lit(BLOCK_COPIES).cast("bigint"))).alias("first"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                F.explode(F.sequence("first", F.least("last", F.col("first") + BLOCK_COPIES - 1))).alias("slot"), "grown_shard")
    )
