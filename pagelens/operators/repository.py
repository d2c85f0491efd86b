"""The rule table.

    sequence_id, domain, extraction_task, actions ARRAY<STRUCT<…step…>>,
    success_rate, robustness_score, created_at, updated_at,
    metadata MAP<STRING,STRING>

The store keeps rules in hash buckets of the domain (the domain itself stays a
column, so empty and null domains come back as they were).  A version is a
manifest: which folder holds each bucket.  A commit writes new folders for the
buckets that it touches only, and then creates the next manifest atomically; a
writer that finds that number taken looks at the newest version again, and writes
anew only if the other commit touched one of its buckets.  So readers see whole versions,
no commit is lost, and a writer that dies leaves nothing but files that
:func:`clean_up` removes.  Batch lookups for many pages are joins plus a top-k
window; upsert and delete are unions and anti-joins.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..session import local_rows
from . import select as S

RULE_DDL = (
    "sequence_id string, domain string, extraction_task string, "
    f"actions array<struct<step_index:int,action_type:string,attribute:string,xpath:string,"
    f"branches:array<{S.BRANCH_DDL}>,post:array<{S.OP_DDL}>>>, "
    "success_rate double, robustness_score double, created_at timestamp, updated_at timestamp, "
    "metadata map<string,string>"
)


def rule_id(domain: Column, task: Column, stamp: Column) -> Column:
    """``seq_`` + first 12 hex digits of md5(domain:task:timestamp)."""
    return F.concat(
        F.lit(fixed.RULE_ID_PREFIX),
        F.substring(F.md5(F.concat_ws(":", domain, task, stamp)), 1, fixed.RULE_ID_HEX),
    )


def empty(spark: SparkSession) -> DataFrame:
    return local_rows(spark, [], RULE_DDL)


def upsert(current: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """By sequence_id; an update keeps created_at and sets updated_at.  Of
    incoming rows with one id the last wins."""
    now = now if now is not None else F.current_timestamp()
    cols = current.columns
    row = F.max_by(F.struct(*cols), F.col("_at"))
    incoming = incoming.withColumn("_at", F.monotonically_increasing_id()).groupBy("sequence_id").agg(row.alias("r")).select("r.*")
    old = current.select("sequence_id", F.col("created_at").alias("old_created"))
    inc = incoming.join(old, "sequence_id", "left").select(
        *[c for c in cols if c not in ("created_at", "updated_at")],
        F.coalesce(F.col("old_created"), F.col("created_at")).alias("created_at"),
        F.when(F.col("old_created").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    kept = current.join(incoming.select("sequence_id"), "sequence_id", "left_anti")
    return kept.unionByName(inc.select(*cols))


def delete(current: DataFrame, sequence_ids: DataFrame) -> DataFrame:
    """Remove the given ids (anti-join)."""
    return current.join(sequence_ids.select("sequence_id"), "sequence_id", "left_anti")


def fetch(rules: DataFrame, sequence_id: str) -> DataFrame:
    """Point lookup (0 or 1 row)."""
    return rules.filter(F.col("sequence_id") == sequence_id)


def _by_robustness(df: DataFrame) -> list[Column]:
    # rounded so float noise from a different summation order cannot reorder
    return [F.desc(F.round("robustness_score", 12)), F.asc("sequence_id")]


def fetch_by_domain(rules: DataFrame, domain: str, limit: int = fixed.FETCH_BY_DOMAIN_LIMIT) -> DataFrame:
    """One domain, best robustness first."""
    return rules.filter(F.col("domain") == domain).orderBy(*_by_robustness(rules)).limit(limit)


def fetch_by_task(rules: DataFrame, task: str, limit: int = fixed.FETCH_BY_TASK_LIMIT) -> DataFrame:
    """I4: one task, best robustness first."""
    return rules.filter(F.col("extraction_task") == task).orderBy(*_by_robustness(rules)).limit(limit)


def fetch_by_domain_and_task(rules: DataFrame, domain: str, task: str,
                             limit: int = fixed.FETCH_BY_DOMAIN_TASK_LIMIT) -> DataFrame:
    """One (domain, task), best robustness first."""
    return (rules.filter((F.col("domain") == domain) & (F.col("extraction_task") == task))
            .orderBy(*_by_robustness(rules)).limit(limit))


def top_per(rules: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Batch form of I3/I4/I5: top ``limit`` rules per key, ranked."""
    w = Window.partitionBy(*keys).orderBy(*_by_robustness(rules))
    return rules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rules_for_pages(pages: DataFrame, rules: DataFrame, tasks: DataFrame,
                    limit: int = fixed.SCRAPE_RULE_LIMIT) -> DataFrame:
    """I5 for many pages at once: (page_id, domain, task) ⨝ top rules of
    (domain, task).  Rules are ranked once per (domain, task), then
    equi-joined to pages — no per-page lookups."""
    from ..functions import urls

    top = top_per(rules, ["domain", "extraction_task"], limit)
    p = pages.select("page_id", urls.domain(F.col("url")).alias("domain"))
    t = tasks.select(F.col("task").alias("extraction_task"))
    top = top.join(F.broadcast(t), "extraction_task", "left_semi")  # the caller's few tasks
    return p.join(S.small(top, top.count()), "domain")


def list_all(rules: DataFrame, limit: int = fixed.LIST_ALL_LIMIT, order_by: str = "robustness_score") -> DataFrame:
    """Best first by one of the allowed fields (others fall back)."""
    field = order_by if order_by in fixed.LIST_ORDER_FIELDS else "robustness_score"
    key = F.round(field, 12) if field in ("robustness_score", "success_rate") else F.col(field)
    return rules.orderBy(key.desc(), F.asc("sequence_id")).limit(limit)


def statistics(rules: DataFrame) -> DataFrame:
    """I8 as a long (metric, value) table: total, distinct domains / tasks,
    mean robustness rounded to 3 places (0.0 when empty), and the top 5
    domains by rule count (``top_domain_<rank>`` = ``domain=count``)."""
    tot = rules.agg(
        F.count("*").cast("string").alias("total_sequences"),
        F.count_distinct("domain").cast("string").alias("unique_domains"),
        F.count_distinct("extraction_task").cast("string").alias("unique_tasks"),
        F.coalesce(F.round(F.avg("robustness_score"), 3), F.lit(0.0)).cast("string").alias("average_robustness"),
    )
    longt = tot.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in tot.columns]), F.array(*[F.col(c) for c in tot.columns])
    )).alias("metric", "value"))
    per = rules.groupBy("domain").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), F.asc("domain")).limit(fixed.STATS_TOP_DOMAINS)
    w = Window.orderBy(F.desc("n"), F.asc("domain"))  # over at most 5 rows
    top = top.withColumn("r", F.row_number().over(w)).select(
        F.concat(F.lit("top_domain_"), F.col("r").cast("string")).alias("metric"),
        F.concat(F.col("domain"), F.lit("="), F.col("n").cast("string")).alias("value"),
    )
    return longt.unionByName(top)


BUCKETS = 64
RETRIES = 50


def _bucket(domain: Column) -> Column:
    return F.pmod(F.xxhash64(domain), F.lit(BUCKETS)).cast("int")


class _Files:
    """The few file operations that manifests need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm, self.gateway, self.top = spark._jvm, spark.sparkContext._gateway, top.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file under a name that is still free, or return False.

        The text goes to a name of its own first; moving it is atomic and does not overwrite."""
        tmp, to = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        out = self.fs.create(tmp)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":  # its rename looks first and moves then; a link does not
                os.link(tmp.toUri().getPath(), to.toUri().getPath())
            else:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.fs.getConf()).rename(tmp, to, self._no_options())
            return True
        except FileExistsError:
            return False
        except Exception as e:  # a Java exception by its name
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(tmp, False)

    def _no_options(self):
        return self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the store's versions, oldest first."""
    return [int(n[1:9]) for n in _Files(spark, path).names("versions") if n.endswith(".json")]


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 if there is none."""
    return max(versions(spark, path), default=0)


def pinned(spark: SparkSession, path: str, note: str) -> int:
    """The newest version, written down as ``note``; if that is there already,
    the version that it names."""
    folder, name = note.rsplit("/", 1)
    files = _Files(spark, folder)
    files.fs.mkdirs(files.path(""))
    n = latest(spark, path)
    return n if files.create(name, str(n)) else int(files.read(name))


def _manifest(files: _Files, version: int) -> dict[str, str]:
    return json.loads(files.read(f"versions/v{version:08d}.json")) if version else {}


def _commit(spark: SparkSession, path: str, change) -> int:
    """``change(buckets)`` gives (touched buckets, their new rows) for the
    manifest that it is handed; returns the new version's number."""
    files, wrote, base = _Files(spark, path), None, None
    files.fs.mkdirs(files.path("versions"))
    for _ in range(RETRIES):
        n = latest(spark, path)
        now = _manifest(files, n)
        if wrote is None or any(now.get(b) != base.get(b) for b in touched):
            if wrote:
                files.remove(f"data/{wrote}")
            base, wrote = now, f"write={uuid.uuid4().hex}"
            touched, rows = change(base)
            rows.withColumn("bucket", _bucket(F.col("domain"))).write.partitionBy("bucket").parquet(f"{path}/data/{wrote}")
            filled = {x.removeprefix("bucket=") for x in files.names(f"data/{wrote}") if x.startswith("bucket=")}
        new = {b: f for b, f in now.items() if b not in touched} | {b: wrote for b in filled}
        if files.create(f"versions/v{n + 1:08d}.json", json.dumps(new, sort_keys=True)):
            return n + 1
    raise RuntimeError(f"{path}: other writers were faster {RETRIES} times")


def save(rules: DataFrame, path: str) -> int:
    """A5: a new version that holds ``rules`` and nothing else; returns its number."""
    every = {str(b) for b in range(BUCKETS)}
    return _commit(rules.sparkSession, path, lambda now: (every, rules))


def apply(spark: SparkSession, path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, now: Column | None = None) -> int:
    """I1/I7 on the store: a new version with ``upserts`` (rules) and without
    ``deletes`` (sequence_id).  Only buckets that hold such a rule, before or
    after, are rewritten; commits made meanwhile by others are kept."""
    ids = [d.select("sequence_id") for d in (upserts, deletes) if d is not None]
    ids = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])

    def change(manifest):
        current = _read(spark, path, manifest)
        at = current.join(ids.distinct(), "sequence_id", "left_semi").select("domain")
        if upserts is not None:
            at = at.unionByName(upserts.select("domain"))
        touched = {str(r.b) for r in at.select(_bucket(F.col("domain")).alias("b")).distinct().collect()}  # BUCKETS at most
        part = _read(spark, path, {b: f for b, f in manifest.items() if b in touched})
        part = part if upserts is None else upsert(part, upserts, now)
        return touched, part if deletes is None else delete(part, deletes)

    return _commit(spark, path, change)


def _read(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame:
    if not manifest:
        return empty(spark)
    top = f"{path.rstrip('/')}/data"
    return spark.read.schema(RULE_DDL + ", write string, bucket int").option("basePath", top).parquet(
        *[f"{top}/{f}/bucket={b}" for b, f in sorted(manifest.items())]).drop("write", "bucket")


def load(spark: SparkSession, path: str, domain: str | None = None, version: int | None = None) -> DataFrame:
    """The newest version (or ``version``); with ``domain`` only its bucket is
    read."""
    manifest = _manifest(_Files(spark, path), latest(spark, path) if version is None else version)
    if domain is None:
        return _read(spark, path, manifest)
    b = str(spark.range(1).select(_bucket(F.lit(domain)).alias("b")).first().b)
    return _read(spark, path, {k: f for k, f in manifest.items() if k == b}).filter(F.col("domain") == domain)


def clean_up(spark: SparkSession, path: str, keep: int = 2, age_seconds: float = 86_400) -> int:
    """Remove all versions but the newest ``keep`` and the folders that only they
    name; a folder that no version names goes once it is ``age_seconds`` old (its
    writer may still be at work).  Returns the number of folders removed."""
    files, found = _Files(spark, path), versions(spark, path)
    gone, kept = found[: max(0, len(found) - max(1, keep))], found[-max(1, keep):]
    needed = {f for n in kept for f in _manifest(files, n).values()}
    named = {f for n in gone for f in _manifest(files, n).values()}
    old = time.time() - age_seconds
    folders = [f for f in files.names("data") if f not in needed and (
        f in named or files.fs.getFileStatus(files.path(f"data/{f}")).getModificationTime() / 1000 < old)]
    for n in gone:
        files.remove(f"versions/v{n:08d}.json")
    for f in folders:
        files.remove(f"data/{f}")
    return len(folders)
