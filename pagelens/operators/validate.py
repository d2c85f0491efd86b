"""Cross-page validation of rules and selection of the best one.

Plan: the rule × page grid (rules scoped to a group, by default the page's
domain) is executed once by the selector engine, then scored by a
two-level aggregation — per (rule, page) quality, then per (group, rule)
robustness — and ranked with one window per group.  Every aggregate is
algebraic (count, sum, var_samp, count distinct), so a hot group (one
domain holding a third of the pages) is combined map-side; nothing
collects a group's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import text as T
from ..functions import urls
from ..session import cut_lineage
from . import dom, execute, select

UNICODE_WS = r"[ \t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def char_pattern(v: Column, width: int = 20) -> Column:
    """D/L/S/P code of the first ``width`` characters."""
    head = F.substring(v, 1, width)
    out = F.regexp_replace(head, r"\p{L}", "L")
    out = F.regexp_replace(out, r"\p{Nd}", "D")
    out = F.regexp_replace(out, UNICODE_WS, "S")
    return F.regexp_replace(out, r"[^LDS]", "P")


def relevance(value: Column, task: Column) -> Column:
    """H5 per-value relevance by task kind."""
    t = F.lower(task)
    low = F.lower(value)
    n = F.length(value)
    return (
        F.when(T.contains_any(t, fixed.RELEVANCE_PRICE_WORDS),
               F.when(T.contains_any(value, fixed.RELEVANCE_CURRENCY) | F.contains(low, F.lit("price")), 1.0).otherwise(0.3))
        .when(T.contains_any(t, fixed.RELEVANCE_TITLE_WORDS),
              F.when((n >= 5) & (n <= 100) & ~T.contains_any(value, ["@", "http"]), 0.8).otherwise(0.4))
        .when(T.contains_any(t, fixed.RELEVANCE_LINK_WORDS),
              F.when(F.contains(low, F.lit("http")) | F.startswith(value, F.lit("/")), 1.0).otherwise(0.2))
        .when(F.contains(t, F.lit("email")),
              F.when(F.contains(value, F.lit("@")) & F.contains(value, F.lit(".")), 1.0).otherwise(0.1))
        .otherwise(F.when((n >= 3) & (n <= 500), 0.6).otherwise(0.3))
    )


def page_values(nodes: DataFrame, pages: DataFrame, steps: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """H2: run every rule on every page (or each page's rules, if ``pairs`` are
    given) the validation way.

    Every action is a text extraction, values are stripped (not squeezed),
    de-duplicated within the action, and the *last* successful action's
    values are the page's data.  Returns (data, page_status):
      data (page_id, sequence_id, idx, value)
      page_status (page_id, sequence_id, success, error_count)
    """
    as_text = select.with_action(steps, fixed.ACTION_TEXT)
    sets = select.select_nodes(nodes, as_text, pairs)
    vals = select.node_values(nodes, pages, as_text, sets, normalize_whitespace=False, max_results=1 << 30)
    per_rule = steps.groupBy("sequence_id").agg(F.count("*").alias("n_steps"))
    grid = execute.rule_pages(pages, steps, pairs)
    step_counts = grid.join(select.small(per_rule, select.rule_meta(steps)["n_steps"]), "sequence_id")
    # Values and statuses are read by several branches below: computed once.
    first = vals.groupBy("page_id", "sequence_id", "step_index", "value").agg(F.min("ord").alias("ord"))
    first = cut_lineage(first.withColumn("pattern", char_pattern(F.col("value"))))
    ok = first.groupBy("page_id", "sequence_id", "step_index").agg(F.count("*").alias("n"))
    last_ok = ok.groupBy("page_id", "sequence_id").agg(F.max("step_index").alias("last_step"))
    data = first.join(last_ok, ["page_id", "sequence_id"]).filter(F.col("step_index") == F.col("last_step"))
    w = Window.partitionBy("page_id", "sequence_id").orderBy("ord")
    data = data.withColumn("idx", F.row_number().over(w)).select("page_id", "sequence_id", "idx", "value", "pattern")
    status = (
        step_counts.join(ok.groupBy("page_id", "sequence_id").agg(F.count("*").alias("n_ok")), ["page_id", "sequence_id"], "left")
        .fillna(0, ["n_ok"])
        .select("page_id", "sequence_id", (F.col("n_ok") > 0).alias("success"),
                (F.col("n_steps") - F.col("n_ok")).cast("bigint").alias("error_count"))
    )
    return data, status


def _few(rules: DataFrame) -> DataFrame:
    return select.small(rules, rules.count())


def page_quality(data: DataFrame, status: DataFrame, rule_tasks: DataFrame) -> DataFrame:
    """H3/H4/H5 per (page, rule): quality_score, data_consistency,
    content_relevance, meaningfulness, uniqueness_ratio, data_count,
    mean_len."""
    d = data.join(_few(rule_tasks.select("sequence_id", "task")), "sequence_id")
    n = F.count("*")
    agg = d.groupBy("page_id", "sequence_id").agg(
        n.alias("data_count"),
        F.avg(((F.length(F.trim("value")) >= fixed.MEANINGFUL_MIN_LEN)
               & (F.length(F.trim("value")) <= fixed.MEANINGFUL_MAX_LEN)).cast("double")).alias("meaningfulness"),
        F.coalesce(F.var_samp(F.length("value")), F.lit(0.0)).alias("len_var"),
        F.count_distinct("pattern").alias("n_patterns"),
        F.avg(relevance(F.col("value"), F.col("task"))).alias("content_relevance"),
        F.lit(1.0).alias("uniqueness_ratio"),  # a rule's values are distinct on a page
        F.avg(F.length("value")).alias("mean_len"),
    )
    cons = F.when(
        F.col("data_count") <= 1, F.lit(1.0)
    ).otherwise(
        (F.greatest(F.lit(0.0), 1.0 - F.col("len_var") / fixed.LENGTH_VAR_NORM) + 1.0 / F.col("n_patterns")) / 2.0
    )
    q = agg.select(
        "page_id", "sequence_id", "data_count", "meaningfulness", "content_relevance", "uniqueness_ratio", "mean_len",
        cons.alias("data_consistency"),
    ).withColumn(
        "quality_score",
        (F.col("meaningfulness") + F.col("data_consistency") + F.col("content_relevance")
         + F.least(F.col("uniqueness_ratio") * fixed.UNIQUE_BONUS, F.lit(1.0))) / 4.0,
    )
    out = status.join(q, ["page_id", "sequence_id"], "left")
    zero = ["data_count", "meaningfulness", "content_relevance", "uniqueness_ratio", "data_consistency", "quality_score"]
    return out.fillna(0, zero)


def rule_performance(quality: DataFrame, data: DataFrame, groups: DataFrame,
                     min_success: float = fixed.MIN_SUCCESS_THRESHOLD,
                     consistency_weight: float = fixed.CONSISTENCY_WEIGHT,
                     coverage_weight: float = fixed.COVERAGE_WEIGHT,
                     quality_weight: float = fixed.QUALITY_WEIGHT) -> DataFrame:
    """H6-H9 per (group, rule).

    ``groups`` maps page_id -> grp.  Output: grp, sequence_id, pages_tested,
    successful_pages, success_rate, consistency_score, coverage_score,
    quality_score, robustness_score.
    """
    q = quality.join(groups, "page_id")
    okp = F.col("success") & (F.col("data_count") > 0)
    per = q.groupBy("grp", "sequence_id").agg(
        F.count("*").alias("pages_tested"),
        F.sum(F.col("success").cast("int")).alias("successful_pages"),
        F.avg("quality_score").alias("quality_score"),
        F.sum(okp.cast("int")).alias("k_ok"),
        F.var_samp(F.when(okp, F.col("data_count"))).alias("count_var"),
        F.var_samp(F.when(okp, F.col("mean_len"))).alias("mean_len_var"),
        F.avg(F.when(F.col("success"), F.col("data_count"))).alias("mean_count_ok"),
    )
    # pooled item pattern consistency over successful non-empty pages
    okpages = quality.filter(okp).select("page_id", "sequence_id")
    pooled = data.join(okpages, ["page_id", "sequence_id"], "left_semi").join(groups, "page_id").groupBy(
        "grp", "sequence_id"
    ).agg(
        F.count("*").alias("n_items"),
        F.coalesce(F.var_samp(F.length("value")), F.lit(0.0)).alias("item_len_var"),
        F.count_distinct("pattern").alias("item_patterns"),
    )
    j = per.join(pooled, ["grp", "sequence_id"], "left")
    pattern_cons = F.when(F.coalesce(F.col("n_items"), F.lit(0)) <= 1, F.lit(1.0)).otherwise(
        (F.greatest(F.lit(0.0), 1.0 - F.col("item_len_var") / fixed.LENGTH_VAR_NORM) + 1.0 / F.col("item_patterns")) / 2.0
    )
    count_cons = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.col("count_var"), F.lit(0.0)) / fixed.COUNT_VAR_NORM)
    len_cons = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.col("mean_len_var"), F.lit(0.0)) / fixed.MEAN_LENGTH_VAR_NORM)
    consistency = (
        F.when(F.col("k_ok") == 0, F.lit(0.0))
        .when(F.col("k_ok") == 1, F.lit(1.0))
        .otherwise((count_cons + pattern_cons + len_cons) / 3.0)
    )
    coverage = F.when(F.col("successful_pages") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("mean_count_ok") / fixed.COVERAGE_NORM, F.lit(1.0))
    )
    sr = F.col("successful_pages") / F.col("pages_tested")
    out = j.select(
        "grp", "sequence_id", F.col("pages_tested").cast("bigint").alias("pages_tested"),
        F.col("successful_pages").cast("bigint").alias("successful_pages"),
        sr.alias("success_rate"), consistency.alias("consistency_score"), coverage.alias("coverage_score"),
        "quality_score",
    )
    weighted = (
        F.col("success_rate") * fixed.SUCCESS_WEIGHT + F.col("consistency_score") * consistency_weight
        + F.col("coverage_score") * coverage_weight + F.col("quality_score") * quality_weight
    )
    weighted = F.when(F.col("success_rate") < min_success, weighted * (F.col("success_rate") / min_success)).otherwise(weighted)
    return out.withColumn("robustness_score", F.least(weighted, F.lit(1.0)))


def rank_rules(perf: DataFrame, rule_order: DataFrame, min_success: float = fixed.MIN_SUCCESS_THRESHOLD) -> DataFrame:
    """Rank by robustness (stable on input order) and select the
    first rule meeting the success and quality floors, else rank 1."""
    p = perf.join(_few(rule_order.select("sequence_id", "rule_ord")), "sequence_id")
    w = Window.partitionBy("grp").orderBy(F.desc(F.round("robustness_score", 12)), F.asc("rule_ord"))
    p = p.withColumn("rank", F.row_number().over(w).cast("bigint"))
    eligible = (F.col("success_rate") >= min_success) & (F.col("quality_score") >= fixed.SELECT_MIN_QUALITY)
    # first eligible rank, else rank 1: min over (not eligible, rank) packed in a bigint
    key = F.when(eligible, F.lit(0)).otherwise(F.lit(1)).cast("bigint") * F.lit(1 << 32) + F.col("rank")
    pick = p.groupBy("grp").agg(F.min(key).alias("pick"))
    return p.join(pick, "grp").withColumn("is_selected", F.col("rank") == F.col("pick") % F.lit(1 << 32)).drop("pick")


def validation_summary(ranked: DataFrame, quality: DataFrame, groups: DataFrame) -> DataFrame:
    """H12 per group: totals, robustness mean / max / sample variance, the
    selected rule's page outcomes and a rationale line."""
    pages_per = groups.groupBy("grp").agg(F.count("*").alias("total_pages_tested"))
    rob = ranked.groupBy("grp").agg(
        F.count("*").alias("total_sequences_evaluated"),
        F.avg("robustness_score").alias("average_robustness_score"),
        F.max("robustness_score").alias("best_robustness_score"),
        F.coalesce(F.var_samp("robustness_score"), F.lit(0.0)).alias("robustness_score_variance"),
    )
    sel = ranked.filter("is_selected").select(
        "grp", F.col("sequence_id").alias("selected_sequence_id"), "robustness_score", "success_rate",
        "quality_score", "consistency_score",
    )
    qsel = quality.join(groups, "page_id").join(
        sel.select("grp", F.col("selected_sequence_id").alias("sequence_id")), ["grp", "sequence_id"]
    ).groupBy("grp").agg(
        F.sum(F.col("success").cast("int")).alias("pages_successful"),
        F.sum((~F.col("success")).cast("int")).alias("pages_failed"),
        F.avg("data_count").alias("average_data_count"),
    )
    out = rob.join(pages_per, "grp").join(sel, "grp").join(qsel, "grp", "left")
    rationale = F.format_string(
        fixed.MSG_SELECTED,
        F.col("selected_sequence_id"), F.col("robustness_score"), F.col("success_rate") * 100,
        F.col("quality_score"), F.col("consistency_score"), F.col("pages_successful"), F.col("total_pages_tested"),
    )
    return out.select(
        "grp", F.col("total_sequences_evaluated").cast("bigint").alias("total_sequences_evaluated"),
        F.col("total_pages_tested").cast("bigint").alias("total_pages_tested"),
        "average_robustness_score", "best_robustness_score", "robustness_score_variance",
        "selected_sequence_id", F.col("robustness_score").alias("selected_robustness_score"),
        F.col("pages_successful").cast("bigint").alias("pages_successful"),
        F.col("pages_failed").cast("bigint").alias("pages_failed"), "average_data_count",
        rationale.alias("selection_rationale"),
    )


def page_groups(pages: DataFrame, by: str | None = "domain") -> DataFrame:
    """page_id -> grp (the page's domain, or one group for all pages)."""
    if by == "domain":
        return pages.select("page_id", F.coalesce(urls.domain(F.col("url")), F.lit("")).alias("grp"))
    return pages.select("page_id", F.lit("all").alias("grp"))


def cross_validate(pages: DataFrame, steps: DataFrame, rule_tasks: DataFrame, by: str | None = "domain",
                   nodes: DataFrame | None = None, pairs: DataFrame | None = None, **weights):
    """Full H1-H12 run.  Returns (ranked performance, summary, page quality).

    ``rule_tasks``: (sequence_id, task, rule_ord).  Every rule is tried on
    every page of each group; with ``by='domain'`` a rule is judged per
    domain, so each domain gets its own ranking and selection.  ``pairs``
    (page_id, sequence_id) limits each page to its own rules.
    """
    if nodes is None:
        nodes = dom.dom_nodes(pages)
    data, status = page_values(nodes, pages, steps, pairs)
    quality = page_quality(data, status, rule_tasks)
    groups = page_groups(pages, by)
    min_success = weights.pop("min_success", fixed.MIN_SUCCESS_THRESHOLD)
    perf = rule_performance(quality, data, groups, min_success=min_success, **weights)
    ranked = rank_rules(perf, rule_tasks, min_success)
    summary = validation_summary(ranked, quality, groups)
    return ranked, summary, quality
