"""Session settings and small planning helpers shared by every operator."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on.  They can be changed at any
# time on a live session, so operators apply them to whatever session they
# are handed.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Node tables are hash-partitioned by page_id once; joins on
    # (page_id, x) then reuse that partitioning instead of re-shuffling.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # Pages are large rows: keep Arrow batches small for the parser.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

# Largest table (rows) we allow to be broadcast.  Rule and task tables are
# tiny; anything larger takes the shuffle path.
BROADCAST_MAX_ROWS = 200_000


def build_session(master: str | None = None, partitions: int = 8, app: str = "pagelens") -> SparkSession:
    """Session for tests, the bench and local runs."""
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings: keep the session's value
            pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it (a shared file system).  Only a local
    session, as in tests, gets a folder of its own; on a cluster an executor
    could not read what another wrote to a local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="pagelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; :func:`release` removes it."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made(spark).append((None, path))
    return path


#: While a bucketed table is written: a task holds the rows of one bucket (or of a few), so they
#: need no sort by bucket, and a bucketed source is read with a task for each bucket.
WRITE_CONF = {
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to partitions by ``key`` as :func:`bucketed` deals to buckets;
    a table that is bucketed so already is not shuffled."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, bucketed by
    ``key``, and read back: later scans read only the columns and row groups
    that they need, and joins and aggregates on ``key`` need no exchange.
    A row is expected to lie in the partition that its key hashes to."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    name = "pagelens_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, WRITE_CONF):
        df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    _made(spark)[-1] = (name, path)
    return spark.table(name)


#: While a step of one page's rows is computed: its tables lie in the buckets of their pages, so
#: they meet without exchange or broadcast, and no table is read only to filter another.
STEP_CONF = WRITE_CONF | {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
}


def kept(df: DataFrame, key: str = "page_id") -> DataFrame:
    """The rows of a step, written once to the buckets of ``key`` beside the node table.
    (A checkpoint forgets how its rows are dealt: everything that meets it, the
    node table too, would be shuffled again.)"""
    with settings(df.sparkSession, STEP_CONF):
        return bucketed(dealt(df, key), key)


def local_rows(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A few rows of Python values as a table that plans hold themselves.  (Rows of an RDD are
    unpickled by Python workers wherever a plan reads them.)"""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def any_row(df: DataFrame) -> bool:
    with settings(df.sparkSession, STEP_CONF):
        return bool(df.take(1))


def _made(spark: SparkSession) -> list:
    if not hasattr(spark, "_pagelens_made"):
        spark._pagelens_made = []
    return spark._pagelens_made


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Remove the tables and folders that this session's operators have written
    to the shared folder, once no result that reads them is needed any more.
    Returns how many there were."""
    made = _made(spark)
    n = len(made)
    while made:
        name, path = made.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
    return n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
