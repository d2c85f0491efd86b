"""A1: captured pages from files, as rows (page_id, url, html).

* :func:`html_files`: whole files, one page each.  A page's encoding is found from its
  byte order mark, else from the charset that its head names, else it is
  UTF-8, and bytes that are none are replaced.  An empty file is no page.  A file's address is its url, unless the page
  names a canonical one.
* :func:`json_lines`: a page in each line, with its url and html.

``page_id`` is taken from the file where there is one, else it is a hash of
the url (so a page that is captured again keeps its id).
"""

from __future__ import annotations

import codecs
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dom import ship
from ..session import remove, settings, shared_path

#: Bytes of a page in which its charset is looked for.
HEAD = 4096

MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
         (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
CHARSET = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""


def decode(content: bytes) -> str:
    """The text of a captured page."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark):].decode(name, "replace")
    found = CHARSET.search(content[:HEAD])
    name = found[1].decode() if found else "utf-8"
    try:
        name = codecs.lookup(name).name
    except LookupError:
        name = "utf-8"
    # pages that say so mean its superset
    return content.decode("cp1252" if name in ("iso8859-1", "ascii") else name, "replace")


#: Folders over which the page files of a round are spread.
FOLDERS = 256
#: Files that are written or listed in one round: the driver holds what it knows of a file only as long.
FILES_AT_ONCE = 1 << 13
#: While files are listed: what is found is not cached beyond its round.
LIST_CONF = {"spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def write_files(pages: DataFrame, path: str) -> None:
    """The html of each page as a text file, in a folder with the page's id, which
    lies in one of the ``FOLDERS`` of its round.  A task writes whole folders, so that committing
    and listing handle folders, not pages, one by one; a round has about ``FILES_AT_ONCE`` pages,
    whose rows are dealt to the rounds once."""
    spark, stage = pages.sparkSession, None
    rounds = max(1, -(-pages.count() // FILES_AT_ONCE))
    no = F.pmod(F.xxhash64("page_id", F.lit("round")), F.lit(rounds)).cast("int").alias("round")
    part = F.pmod(F.xxhash64("page_id"), F.lit(FOLDERS)).alias("part")
    rows = pages.select(no, part, "page_id", "html")
    if rounds > 1:
        stage = shared_path(spark, "rounds")
        rows.repartition(rounds, "round").write.partitionBy("round").parquet(stage)
        rows = spark.read.parquet(stage)
    for k in range(rounds):
        some = rows.filter(F.col("round") == k).drop("round")
        some.repartition(FOLDERS, "part").write.partitionBy("part", "page_id").option("lineSep", "\n").text(f"{path}/round={k}")
    if stage:
        remove(spark, stage)


def _rounds(spark: SparkSession, path: str) -> list[list[str]]:
    """What lies below ``path`` as lists of folders and files that hold ``FILES_AT_ONCE`` files
    at most; an empty list where there are no more in all.  Folders are counted, and only the
    larger ones are looked into."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def below(folder):
        found, out = fs.listStatusIterator(folder), []
        while found.hasNext():
            one = found.next()
            name = one.getPath().getName()
            # as Spark lists them
            if not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
                out.append((one.getPath(), one.isDirectory()))
        return out

    def count(one):
        return fs.getContentSummary(one[0]).getFileCount() if one[1] else 1

    todo = [x for top in fs.globStatus(jvm.Path(path)) or [] for x in (below(top.getPath()) if top.isDirectory() else [(top.getPath(), False)])]
    rounds, n, total = [[]], 0, 0
    with ThreadPoolExecutor(8) as pool:
        while todo:
            deeper = []
            for one, files in zip(todo, pool.map(count, todo)):
                if files > FILES_AT_ONCE:
                    deeper += below(one[0])
                    continue
                if n + files > FILES_AT_ONCE:
                    rounds.append([])
                    n = 0
                rounds[-1].append(re.sub(r"([\\\[\]{}*?])", r"\\\1", one[0].toString()))  # a path, not a pattern
                n, total = n + files, total + files
            todo = deeper
    return [x for x in rounds if x] if total > FILES_AT_ONCE else []


def html_files(spark: SparkSession, path: str, glob: str = "*.html", page_id: str | None = None) -> DataFrame:
    """Pages of the files below ``path`` whose names match ``glob``.

    ``page_id``: a pattern whose first group, found in the file's path, is the id.  More than
    ``FILES_AT_ONCE`` files are read round by round into one table of pages in the shared folder, as
    the driver lists what a plan reads."""
    rounds = _rounds(spark, path)
    if not rounds:
        return _files(spark, [path], glob, page_id)
    table = shared_path(spark, "pages")
    for some in rounds:
        _files(spark, some, glob, page_id).write.mode("append").parquet(table)
    return spark.read.schema("page_id bigint, url string, html string").parquet(table)


def _files(spark: SparkSession, paths: list[str], glob: str, page_id: str | None) -> DataFrame:
    import pyarrow as pa

    ship(__name__)
    with settings(spark, LIST_CONF):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    # small files are planned as many tasks of a few files: a few tasks a core do
    files = files.select("path", "content").coalesce(spark.sparkContext.defaultParallelism * 4)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([decode(c or b"") for c in b.column("content").to_pylist()], pa.string())],
                                             ["path", "html"])

    pages = files.mapInArrow(run, "path string, html string")
    link = F.regexp_extract("html", CANONICAL, 0)
    named = F.regexp_extract(link, r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1)
    url = F.when(named != "", named).otherwise(F.col("path"))
    number = F.regexp_extract("path", page_id, 1).cast("bigint") if page_id else F.xxhash64(url)
    return pages.select(number.alias("page_id"), url.alias("url"), "html")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON lines with ``url`` and ``html``, and perhaps ``page_id``."""
    rows = spark.read.schema("page_id bigint, url string, html string").json(path)
    return rows.select(F.coalesce("page_id", F.xxhash64("url")).alias("page_id"), "url", "html")
