"""A corpus pipeline over ``documents``, stage by stage.

Each stage reads the rows that its predecessor kept (written as Parquet and
read again) and its decisions take effect in what it returns.  All but the
last return the columns of ``documents``.

1. language identification: documents whose language is rejected go;
2. exact deduplication: the row with the smallest doc_id of equal texts stays;
3. SimHash near-deduplication: one document of each group stays;
4. benchmark decontamination: documents that hold a benchmark window go;
5. BPE encoding and decoding: token counts and digests of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import bpe, decontam, exact_dedup, langid, queries, simhash
from pagelens.llm.common import table
from pagelens.session import ensure_checkpoint_dir

#: Language ID and near-deduplication have no SQL form.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs, ~langid.held_out(F.col("doc_id"))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=simhash.SHINGLE, max_distance=simhash.MAX_DISTANCE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, queries.vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", near),
          ("decontamination", decontamination), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them, tables in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    top = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # its rows are in the new table now
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
