"""SimHash near-deduplication with a pigeonring filter.

Fingerprints: 64 bits; bit b is set if it is set in more than half of the
XXH64 hashes (seed 42) of the text's word shingles.

Search over *distinct* fingerprints for pairs at ``max_distance`` (t) bits or
fewer.  A fingerprint is a ring of m = 4t segments.  If two fingerprints
differ in at most t bits, then some start i exists from which every chain of l
consecutive segments holds at most l * t / m differences (the strong form of
the principle).  So from that start

* the first three segments are equal (budget below 1), and
* the first seven hold at most one difference, so of segments 4-5 and 6-7 at
  least one half is equal as well.

Both facts go into a first key (start, three segments, half, its bits; 40 bits
for t = 2): a fingerprint that shares none of its keys has no neighbour and is
dropped before any pair exists.  What shares one is keyed again, by what the whole
chain of budgets leaves free: t bits that may differ (one of the other half and
one of the last segment, or two of the last segment), all other bits equal.
Fingerprints under one such key differ in those t bits at most, so a group has
2**t members at most however crowded the first key was, every member passes the Hamming
check by construction, and linking the members to the smallest
keeps every component.

Links become components by repeated star contraction (join and aggregate),
cut by checkpoints.

Defined cases: texts without words (null, empty) have fingerprint zero and are
linked like any other; with fewer words than a shingle the whole sequence is
one shingle; null doc_ids rank after all numbers; repeated rows share their
component; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, free_names, maybe_broadcast, small_batches, stored

SHINGLE, MAX_DISTANCE, BITS = 3, 2, 64

#: Links that one partition contracts; more links take more partitions.
PART_LINKS = 200_000

#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes):
    """Lists of words, cut at white space about every ``BLOCK`` bytes."""
    at = 0
    while at < len(text):
        cut = WHITE.search(text, at + BLOCK)
        stop = cut.start() if cut else len(text)
        # bytes.lower changes A-Z only; bytes.split cuts at exactly WHITE.
        yield text[at:stop].lower().split()
        at = stop


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, in blocks of bounded memory."""
    import xxhash

    h64, counts, total, kept = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []

    def count(shingles):
        nonlocal counts, total
        h = np.array([h64(x, 42) for x in shingles], "<u8")
        if len(h):
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)

    for words in _word_blocks(text or b""):
        words = kept + words
        count(map(b" ".join, zip(*(words[j:] for j in range(n)))))
        kept = words[max(0, len(words) - n + 1):]
    if not total and kept:
        count([b" ".join(kept)])
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): fp as a signed long."""
    by_value(__name__)
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def _segments(t: int) -> tuple[list[tuple[int, int]], int, int]:
    """(lowest bit, width) of the ring's segments, number that must be equal,
    number that may hold one difference at most."""
    m = 4 * t
    cuts = [BITS * i // m for i in range(m + 1)]
    free = [t * x // m for x in range(1, m + 1)]  # budget of each chain length
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], free.count(0), sum(x <= 1 for x in free)


def _mask(segs) -> int:
    v = sum(((1 << w) - 1) << a for a, w in segs)
    return v - (1 << 64) if v >> 63 else v


def _parts(t: int) -> list[tuple[int, list[int]]]:
    """For each start and half: the mask of the bits that must be equal, and
    the masks of t bits that keep every chain budget from there."""
    segs, equal, one = _segments(t)
    m, out = len(segs), []
    for i in range(m):
        ring = [segs[(i + x) % m] for x in range(m)]
        rest = ring[equal:one]
        halves = [rest[: len(rest) // 2], rest[len(rest) // 2 :]] if len(rest) > 1 else [[]]
        for half in halves:
            free = [(n, 1 << b) for n, (a, w) in enumerate(ring) if n >= equal and (a, w) not in half for b in range(a, a + w)]
            fit = [c for c in itertools.combinations(free, t)
                   if all(sum(n < x for n, _ in c) <= t * x // m for x in range(1, m + 1))]
            out.append((_mask(ring[:equal] + half), [_signed(sum(v for _, v in c)) for c in fit]))
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def links(fps: DataFrame, t: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a > b: distinct fingerprints within ``t`` bits, enough of them to
    keep every component (a group's members are linked to its smallest)."""
    if t > 3:
        raise ValueError("max_distance may be 3 at most")
    if t < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    parts, fp = _parts(t), F.col("fp")
    keys = F.array(*[F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(mask)).alias("bits")) for k, (mask, _) in enumerate(parts)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.bits")
    shared = keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    near = stored(keyed.join(shared, ["part", "bits"], "left_semi").select("fp", "part"))
    free = fps.sparkSession.createDataFrame([(k, masks) for k, (_, masks) in enumerate(parts)], "part int, masks array<bigint>")
    again = near.join(F.broadcast(free), "part").select("fp", F.explode("masks").alias("mask"))
    group = again.groupBy("mask", fp.bitwiseAND(F.bitwise_not("mask")).alias("bits")).agg(F.collect_set("fp").alias("f"))  # 2**t at most
    return group.filter(F.size("f") > 1).select(F.explode("f").alias("a"), F.array_min("f").alias("b")).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node
    of its component.  Alternating star contraction until nothing changes.

    Links lie in as many partitions as their number asks for; a node's smallest
    neighbour is pre-aggregated and, up to a checked size, broadcast, so the links
    of a hub are never gathered."""
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    sized = lambda e, n: e.coalesce(max(1, -(-n // PART_LINKS)))
    e = stored(edges.select("a", "b").filter("a > b"))
    was, now = None, state(e)
    while was != now:
        e = sized(e, now[0])
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sized(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), now[0])
        # Large star: larger neighbours move to the smallest.
        big = stored(both.filter("b > a").join(maybe_broadcast(stored(low)), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: smaller neighbours and the node itself move to the smallest.
        low = sized(big.groupBy("a").agg(F.min("b").alias("m")), now[0])
        e = stored(big.join(maybe_broadcast(stored(low)), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(
            F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct())
        was, now = now, state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: doc_id, text_key, fingerprint (16 hex digits),
    component_id, kept (first row of its component), first (that row or one that repeats it)."""
    d = stored(fingerprints(docs, id_col, text_col, shingle).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("row").alias("r"))
    own = stored(d.groupBy("fp").agg(F.min(order).alias("first")))
    root = components(links(own.select("fp"), max_distance))
    # A component's rows are its fingerprints' first documents, not its documents.
    of = own.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    best = of.groupBy("root").agg(F.min("first").alias("best"))
    of = stored(of.join(best, "root").select("fp", "best"))
    return d.join(of, "fp").select(
        "doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.d").alias("component_id"), (F.col("row") == F.col("best.r")).alias("kept"),
        (F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("text_key") == F.col("best.k"))).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component (with the
    repeated rows of its own), with all their columns."""
    key, i, k = free_names(docs, "_llm_text_key", "_llm_id", "_llm_key")
    gone = stored(near_duplicates(docs, id_col, text_col, shingle, max_distance).filter(~F.col("first")).select(
        F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct())
    return docs.withColumn(key, F.xxhash64(F.col(text_col))).join(
        maybe_broadcast(gone), [F.col(id_col).eqNullSafe(F.col(i)), F.col(key) == F.col(k)], "left_anti").drop(key)
