"""Rule suggestions for a task, optimisation advice and issue
diagnosis — conditional arrays over execution metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from . import dom, execute
from . import select as S
from .select import Branch, Step

SUGGESTION_RULES = {
    "price": Step([Branch(class_any=["price"], text_any=["$", "Rs."], output="desc_text", nonblank=True)]),
    "title": Step([Branch(tags=["h1"], output="desc_text"), Branch(tags=["h2"], output="desc_text"),
                   Branch(tags=["h3"], output="desc_text"), Branch(class_any=["title"], output="desc_text")]),
    "product": Step([Branch(class_any=["product", "item"], output="desc_text", nonblank=True)]),
}


def suggestions(tasks: DataFrame) -> DataFrame:
    """(task, suggestion, confidence, reasoning, xpath) — 0 to 3 per
    task, additive."""
    low = F.lower(F.col("task"))
    arr = F.array(*[
        F.when(T.contains_any(low, words),
               F.struct(F.lit(name).alias("suggestion"), F.lit(conf).alias("confidence"), F.lit(why).alias("reasoning"),
                        F.lit(SUGGESTION_RULES[name].display()).alias("xpath")))
        for name, words, conf, why in fixed.SUGGESTIONS
    ])
    return tasks.select("task", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("s")).select("task", "s.*")


def suggestions_probe(pages: DataFrame, tasks: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """G11 + E11 over a page table: each task's suggestions, probed on every
    page (result count = matched nodes)."""
    spark = pages.sparkSession
    if nodes is None:
        nodes = dom.dom_nodes(pages)
    sug = suggestions(spark.createDataFrame([(t,) for t in tasks], "task string"))
    steps = S.steps_frame(spark, {f"sug:{k}": [v] for k, v in SUGGESTION_RULES.items()})
    grid = pages.select("page_id", F.explode(F.array(*[F.lit(f"sug:{k}") for k in SUGGESTION_RULES])).alias("sequence_id"))
    _, st = execute.run_steps(nodes, steps, pages, pairs=grid)
    st = st.select("page_id", F.regexp_replace("sequence_id", "^sug:", "").alias("suggestion"),
                   F.col("element_count").alias("result_count"), "data_count")
    return st.join(F.broadcast(sug), "suggestion").select(
        "page_id", "task", "suggestion", "confidence", "result_count", "data_count")


def advice(step_status: DataFrame, summary: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """G12 per (page, rule step) and G13 per (page, rule), joined.

    ``times`` (page_id, seconds), as of the run log: a page that took long has the
    slow advice; without it no time is known."""
    n = F.col("element_count")
    if times is not None:
        step_status = step_status.join(times.select("page_id", (F.col("seconds") * 1000).alias("execution_ms")), "page_id", "left")
    else:
        step_status = step_status.withColumn("execution_ms", F.lit(None).cast("double"))
    imp = F.filter(F.array(
        F.when(F.col("execution_ms") > fixed.ADVICE_SLOW_MS, F.lit(fixed.ADVICE_SLOW)),
        F.when(n > fixed.ADVICE_MANY, F.lit(fixed.ADVICE_LIMIT)),
        F.when(n == 0, F.lit(fixed.ADVICE_BROADEN)),
    ), lambda x: x.isNotNull())
    g12 = step_status.select("page_id", "sequence_id", "step_index", F.array_join(imp, "; ").alias("improvements"),
                             F.size(imp).cast("bigint").alias("n_improvements"),
                             F.lit(fixed.ADVICE_CONFIDENCE).alias("advice_confidence"))
    d = F.col("data_count")
    iss = F.filter(F.array(
        F.when(~F.col("success"), F.lit(fixed.DIAG_FAILED[0])),
        F.when(d == 0, F.lit(fixed.DIAG_EMPTY[0])),
        F.when(d == 1, F.lit(fixed.DIAG_SINGLE[0])),
    ), lambda x: x.isNotNull())
    sug = F.filter(F.array(
        F.when(~F.col("success"), F.lit(fixed.DIAG_FAILED[1])),
        F.when(d == 0, F.lit(fixed.DIAG_EMPTY[1])),
        F.when(d == 1, F.lit(fixed.DIAG_SINGLE[1])),
    ), lambda x: x.isNotNull())
    g13 = summary.select("page_id", "sequence_id", F.array_join(iss, "; ").alias("issues"),
                         F.array_join(sug, "; ").alias("suggestions"),
                         F.when(F.size(iss) > 0, F.lit("medium")).otherwise(F.lit("low")).alias("severity"))
    # Rows of pages meet in their buckets, however small their files are.
    return g12.join(g13.hint("merge"), ["page_id", "sequence_id"]).select(
        "page_id", "sequence_id", "step_index", "improvements", "n_improvements", "issues", "suggestions", "severity")
