"""Headline benchmark: prints one JSON line.

tables, and forces full evaluation with the no-op sink (no collect):

  parse_nodes      D1   pages -> node table
  clean_html       C1   cleaned page column
  extract_10_rules E9   ten rules over every page (rule x page pairs)
  cross_validate   H    rules x pages per domain -> robustness ranking
  learn_tasks      G10  bounded rule learning, every task, every page
  content_patterns D11  content patterns over the documents text
  scrape_known     J1   stored rules (published by H) applied per page

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagelens.operators import dom, execute, learn, profile, validate  # noqa: E402
from pagelens.plans import catalog, scrape  # noqa: E402
from pagelens.session import build_session, cut_lineage, read_table  # noqa: E402

STAMP = "2026-01-01T00:00:00"


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", partitions=max(cpus, 8), app="pagelens-bench")
    pages = read_table(spark, sf, "pages")
    n_pages = pages.count()
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    # warm the JVM / Python workers once (not timed)
    _run(dom.parse_nodes(scrape.clean_pages(pages.limit(8))))

    timed("parse_nodes", lambda: _run(dom.parse_nodes(scrape.clean_pages(pages))))
    timed("clean_html", lambda: _run(profile.with_clean(pages).select("page_id", F.md5("html_clean"))))

    def extract():
        pc = scrape.clean_pages(pages)
        run = execute.execute(pc, catalog.bench_steps(spark))
        _run(run.data)
        _run(run.summary)

    timed("extract_10_rules", extract)

    def cross():
        pc = scrape.clean_pages(pages)
        ranked, summary, _ = validate.cross_validate(pc, catalog.validated_steps(spark), catalog.validation_rules(spark))
        _run(ranked)

    timed("cross_validate", cross)

    def learn_all():
        learned, trace, _ = learn.learn(pages, catalog.LEARN_TASKS, route_on="task")
        _run(learned)

    timed("learn_tasks", learn_all)

    def patterns():
        docs = read_table(spark, sf, "documents")
        _run(profile.content_patterns(docs, "doc_id", "text"))

    timed("content_patterns", patterns)

    def known():
        rules, _, _ = scrape.validate_and_publish(
            pages, catalog.validated_steps(spark), catalog.validation_rules(spark), catalog.VALIDATION_TASK, STAMP)
        rules = cut_lineage(rules)
        res, _ = scrape.scrape_known(pages, rules, catalog.VALIDATION_TASK)
        _run(res)

    timed("scrape_known", known)

    n_docs = read_table(spark, sf, "documents").count()
    rates = {
        "parse_pages_per_s": round(n_pages / max(times["parse_nodes"], 1e-9), 1),
        "clean_pages_per_s": round(n_pages / max(times["clean_html"], 1e-9), 1),
        "rule_page_pairs_per_s": round(10 * n_pages / max(times["extract_10_rules"], 1e-9), 1),
        "pattern_docs_per_s": round(n_docs / max(times["content_patterns"], 1e-9), 1),
    }
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "pages": n_pages,
        "rates": rates,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
