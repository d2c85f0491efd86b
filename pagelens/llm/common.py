"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table

#: Rows of two longs that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000

#: Rows and bytes of one Arrow batch: bounded memory in a Python worker even
#: when single texts are very long.
ARROW_ROWS, ARROW_BYTES = "256", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` narrow rows;
    otherwise the planner's shuffled join with skew splitting is used."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bounded_sample(df: DataFrame, key: str, per_key: int, sizes: dict, *order: Column) -> DataFrame:
    """Of each value of ``key`` the ``per_key`` rows with the smallest hash of
    ``order``; ``sizes`` maps the (few) values to their numbers of rows.

    Rows are let through by a hash threshold where they are read, so that about
    twice ``per_key`` of each value are shuffled however many rows there are.
    """
    h = F.xxhash64(*order)
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(key) == value, min(1.0, 2 * (per_key + 20) / max(1, n))).otherwise(share)
    few = df.withColumn("_h", h).filter(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    w = Window.partitionBy(key).orderBy(F.pmod("_h", F.lit(1 << 30)), "_h")
    return few.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_key).drop("_h", "_rank")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_value(*modules: str) -> None:
    """Let functions of these modules travel to executors with their code, so
    executors need no installed copy of the package."""
    from pyspark import cloudpickle

    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])
