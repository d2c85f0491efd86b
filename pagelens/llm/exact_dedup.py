"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after every run of white space became one
space.  One pass computes digests; everything after works on the narrow digest
table.

1. *Misra-Gries*: ``DataFrame.freqItems`` keeps at most ``1/support`` counters
   per task and merges them, so it names every digest with more than
   ``support`` of the rows (and possibly some others).
2. *Verification*: a second pass counts those candidates exactly and finds the
   row that stays.  Candidates that are not that frequent return to the rest.
3. The verified winners (at most ``1/support`` rows) are broadcast, so rows of
   a heavy group are decided where they are read and never meet in a task.
4. The remaining digests are shuffled as usual; no group among them holds
   more than ``support`` of all rows.

Defined cases: null text counts as empty; null doc_id ranks after every
number; of repeated rows (same doc_id, equal text) exactly one stays; an empty
table gives an empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, maybe_broadcast, stored

#: Share of all rows from which a digest may be heavy; 1/SUPPORT counters.
SUPPORT = 1 / 2000

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, text_key, row): ``row`` tells repeated rows apart once
    the table is stored; ``text_key`` identifies the raw text of a doc_id."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    )


def heavy_winners(d: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the verified heavy digests."""
    n = d.count()
    found = d.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    return (
        d.join(F.broadcast(found), "digest", "left_semi")  # at most 1/support rows
        .groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") > support * n)
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, digest, text_key, keep_id, group_size, kept."""
    d = stored(digests(docs, id_col, text_col))
    win = stored(heavy_winners(d, support))
    heavy = d.join(F.broadcast(win), "digest").select(
        "doc_id", "digest", "text_key", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    w = Window.partitionBy("digest")
    o = w.orderBy(F.col("doc_id").asc_nulls_last(), "row")
    rest = d.join(F.broadcast(win), "digest", "left_anti").select(
        "doc_id", "digest", "text_key", F.first("doc_id").over(o).alias("keep_id"),
        F.count("*").over(w).alias("group_size"), (F.row_number().over(o) == 1).alias("kept"))
    return heavy.unionByName(rest)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are removed by (doc_id, hash of the raw text), so a doc_id that
    occurs with several texts is handled; repeated rows keep one copy.
    """
    key, i, k = free_names(docs, "_llm_text_key", "_llm_id", "_llm_key")
    marks = stored(mark_duplicates(docs, id_col, text_col, support).groupBy("doc_id", "text_key").agg(
        F.max("kept").alias("kept"), F.count("*").alias("copies")))
    same = [F.col(id_col).eqNullSafe(F.col(i)), F.col(key) == F.col(k)]
    names = [F.col("doc_id").alias(i), F.col("text_key").alias(k)]
    gone = marks.filter(~F.col("kept")).select(*names)
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    rows = keyed.join(maybe_broadcast(gone), same, "left_anti")
    again = marks.filter(F.col("kept") & (F.col("copies") > 1)).select(*names)
    if again.take(1):
        again = maybe_broadcast(again)
        once = rows.join(again, same, "left_semi").dropDuplicates([id_col, key])
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.drop(key)
