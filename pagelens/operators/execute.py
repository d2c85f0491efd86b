"""Step status, sequence execution, single-rule run, rule probe.

Everything is keyed by (page_id, sequence_id[, step_index]); groups are one
page's results for one rule, bounded by the page and by the per-step cap.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..session import BROADCAST_MAX_ROWS, bucketed, dealt, kept
from . import dom, select, structure

KEY = select.KEY


def rule_grid(pages: DataFrame, steps: DataFrame) -> DataFrame:
    """(page_id, sequence_id, step_index, xpath, has_branches) for every
    page × step in scope.

    A step table with a ``domain`` column applies each rule to its domain's
    pages (equi-join); without it every rule applies to every page, which is
    meant for a rule set of bounded size: beyond the bound the caller has to
    say which rules belong to which pages (``pairs`` or ``domain``).
    """
    n = select.rule_meta(steps)["n_steps"]
    cols = [*KEY, "xpath", (F.size("branches") > 0).alias("has_branches")]
    if "domain" in steps.columns:
        from ..functions import urls

        p = pages.select("page_id", F.explode(F.array(urls.domain(F.col("url")), F.lit("*"))).alias("scope"))
        r = steps.select(F.coalesce(F.col("domain"), F.lit("*")).alias("scope"), *cols)
    else:
        if n > BROADCAST_MAX_ROWS:
            raise ValueError(f"more than {BROADCAST_MAX_ROWS} rule steps for every page: give the pairs of pages and rules")
        p = pages.select("page_id", F.lit("*").alias("scope"))
        r = steps.select(F.lit("*").alias("scope"), *cols)
    return p.join(select.small(r, n), "scope").drop("scope")


def rule_pages(pages: DataFrame, steps: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(page_id, sequence_id): which rules each page runs."""
    grid = pairs if pairs is not None else rule_grid(pages, steps)
    return grid.select("page_id", "sequence_id").distinct()


def run_steps(nodes: DataFrame, steps: DataFrame, pages: DataFrame | None = None,
              normalize_whitespace: bool = True, resolve_relative: bool = False,
              max_results: int = fixed.MAX_RESULTS_PER_STEP, pairs: DataFrame | None = None,
              keep_empty_text: bool = False, stored: bool = False):
    """Returns (values, step_status).  With ``stored`` the node sets, the values
    and the status are written once each and built on each other, so the nodes
    are selected and their texts read once.

    values: (page_id, sequence_id, step_index, ord, node, value)
    step_status: (page_id, sequence_id, step_index, xpath, status, element_count,
                  data_count, error_message, page_failed, has_branches); a page that
                  cannot be parsed fails every step with its parse error
    """
    keep = kept if stored else lambda df: df
    sets = keep(select.select_nodes(nodes, steps, pairs))
    vals = select.node_values(nodes, pages, steps, sets, normalize_whitespace=normalize_whitespace,
                              max_results=max_results + 1, keep_empty_text=keep_empty_text)
    if resolve_relative and pages is not None:
        from ..functions import urls

        pu = pages.select(F.col("page_id").alias("u_page"), F.col("url").alias("u_url"))
        vals = vals.join(pu, vals.page_id == pu.u_page, "left").withColumn(
            "value",
            F.when(F.startswith("value", F.lit("/")) | F.startswith("value", F.lit("./")),
                   F.coalesce(urls.join(F.col("u_url"), F.col("value")), F.col("value"))).otherwise(F.col("value")),
        ).drop("u_page", "u_url")
    vals = keep(vals.select("page_id", *KEY, "ord", "node", "value"))
    counts_e = sets.groupBy("page_id", *KEY).agg(F.count("*").alias("element_count"))
    counts_v = vals.groupBy("page_id", *KEY).agg(F.max("ord").alias("n_all"))
    if pairs is not None:
        grid = pairs.select("page_id", "sequence_id").distinct().join(
            select.rule_rows(steps, steps.select(*select.keys_of(steps, KEY), "xpath", (F.size("branches") > 0).alias("has_branches")),
                             select.rule_meta(steps)["n_steps"]), select.keys_of(steps, ["sequence_id"]))
    else:
        grid = rule_grid(pages if pages is not None else nodes.select("page_id").distinct(), steps)
    st = (
        grid.join(counts_e, ["page_id", *KEY], "left")
        .join(counts_v, ["page_id", *KEY], "left")
        .join(dom.node_errors(nodes).withColumnRenamed("error_message", "page_error"), "page_id", "left")
        .fillna(0, ["element_count", "n_all"])
    )
    status = (
        F.when(F.col("page_error").isNotNull() | ~F.col("has_branches"), F.lit("failed"))
        .when(F.col("n_all") == 0, F.lit("failed"))
        .when(F.col("n_all") > max_results, F.lit("partial"))
        .otherwise(F.lit("success"))
    )
    msg = (
        F.when(F.col("page_error").isNotNull(), F.col("page_error"))
        .when(~F.col("has_branches") & (F.coalesce(F.col("xpath"), F.lit("")) == ""), F.lit(fixed.MSG_NO_XPATH))
        .when(~F.col("has_branches"), F.lit(fixed.MSG_BAD_XPATH))
        .when(F.col("n_all") == 0, F.lit(fixed.MSG_NO_DATA))
        .when(F.col("n_all") > max_results, F.lit(fixed.MSG_TRUNCATED.format(n=max_results)))
    )
    st = st.select(
        "page_id", *KEY, "xpath", status.alias("status"),
        F.when(F.col("has_branches"), F.col("element_count")).otherwise(F.lit(0)).cast("bigint").alias("element_count"),
        F.least(F.col("n_all"), F.lit(max_results)).cast("bigint").alias("data_count"),
        msg.alias("error_message"), F.col("page_error").isNotNull().alias("page_failed"), "has_branches",
    )
    return vals.filter(F.col("ord") <= max_results), keep(st)


def sequence_results(values: DataFrame, step_status: DataFrame, steps: DataFrame, pages: DataFrame | None = None,
                     nodes: DataFrame | None = None, compat: bool = False, by_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per (page, rule) concatenation of step values in step order,
    de-duplicated keeping the first occurrence, then grouped into records
    (F11) if ``nodes`` is given.  Counts are those of the final data: records
    where there are some, else values.

    Returns (extracted, summary, data):
      extracted (page_id, sequence_id, idx, step_index, node, value)
      data      (page_id, sequence_id, idx, value, record, strategy)
      summary   (page_id, sequence_id, success, total_steps, successful_steps,
                 failed_steps, data_count, error_summary, html_length,
                 unique_xpaths, success_rate, data_extraction_rate)
    """
    ok = step_status.filter(F.col("status").isin("success", "partial")).select("page_id", *KEY)
    v = values.join(ok, ["page_id", *KEY], "left_semi")
    # first occurrence by (step, ord) packed into one bigint: a hash
    # aggregate with fixed-width buffers instead of a sort aggregate
    key = F.col("step_index").cast("bigint") * F.lit(1 << 32) + F.col("ord")
    first = v.groupBy("page_id", "sequence_id", "value").agg(
        F.min(key).alias("k"), F.min_by("node", key).alias("node")
    )
    ranked = first.select(
        "page_id", "sequence_id", "value", (F.col("k") / F.lit(1 << 32)).cast("int").alias("step_index"),
        (F.col("k") % F.lit(1 << 32)).cast("int").alias("ord"), "node",
    )
    from pyspark.sql.window import Window

    w = Window.partitionBy("page_id", "sequence_id").orderBy("step_index", "ord")
    extracted = ranked.withColumn("idx", F.row_number().over(w)).select(
        "page_id", "sequence_id", "idx", "step_index", "node", "value"
    )
    own = select.keys_of(steps, ["sequence_id"])
    per_rule = steps.groupBy(*own).agg(
        F.count("*").alias("total_steps"), F.count_distinct(F.coalesce("xpath", F.lit(""))).alias("unique_xpaths")
    )
    msg = F.when(
        F.col("status") == "failed",
        F.concat(F.lit("Step "), F.col("step_index").cast("string"), F.lit(": "), F.col("error_message")),
    ).when(
        (F.col("status") == "partial") & F.col("error_message").isNotNull(),
        F.concat(F.lit("Step "), F.col("step_index").cast("string"), F.lit(" (partial): "), F.col("error_message")),
    )
    agg = step_status.groupBy("page_id", "sequence_id").agg(
        F.sum(F.col("status").isin("success", "partial").cast("int")).alias("successful_steps"),
        F.sum((F.col("status") == "failed").cast("int")).alias("failed_steps"),
        F.when(F.bool_or("page_failed"), F.array(F.max("error_message"))).otherwise(F.transform(
            F.array_sort(F.collect_list(F.when(msg.isNotNull(), F.struct(F.col("step_index"), msg.alias("m"))))),
            lambda s: s["m"],
        )).alias("error_summary"),
    )
    if nodes is None:
        data = extracted.select("page_id", "sequence_id", "idx", "value", F.lit(None).cast("map<string,string>").alias("record"),
                                F.lit("flat").alias("strategy"))
    else:
        data = structure.structure(nodes, values, step_status, extracted, compat, by_text)
    counts = data.groupBy("page_id", "sequence_id").agg(F.count("*").alias("data_count"))
    summary = (
        agg.join(select.rule_rows(steps, per_rule, select.rule_meta(steps)["n_steps"]), own)
        .join(counts.hint("merge"), ["page_id", "sequence_id"], "left")
        .fillna(0, ["data_count"])
    )
    if pages is not None:
        summary = summary.join(pages.select("page_id", F.length("html").alias("html_length")), "page_id", "left")
    else:
        summary = summary.withColumn("html_length", F.lit(None).cast("int"))
    summary = summary.select(
        "page_id", "sequence_id",
        ((F.col("successful_steps") > 0) & (F.col("data_count") > 0)).alias("success"),
        F.col("total_steps").cast("bigint").alias("total_steps"),
        F.col("successful_steps").cast("bigint").alias("successful_steps"),
        F.col("failed_steps").cast("bigint").alias("failed_steps"),
        F.col("data_count").cast("bigint").alias("data_count"),
        "error_summary", "html_length", F.col("unique_xpaths").cast("bigint").alias("unique_xpaths"),
        (F.col("successful_steps") / F.col("total_steps")).alias("success_rate"),
        (F.col("data_count") / F.col("total_steps")).alias("data_extraction_rate"),
    )
    return extracted, summary, data


class Execution(NamedTuple):
    extracted: DataFrame  # values, one row each
    summary: DataFrame  # one row per page and rule
    steps: DataFrame  # one row per page and rule step
    data: DataFrame  # final data: records, or values where there are none


def execute(pages: DataFrame, steps: DataFrame, nodes: DataFrame | None = None, enable_structuring: bool = True,
            compat: bool = False, by_text: bool = False, **kw) -> Execution:
    """pages × rules -> :class:`Execution`; ``compat`` and ``by_text`` as of
    :mod:`structure`."""
    if select.rule_meta(steps)["html"]:  # pages are parsed and cut: cleaned once
        pages = bucketed(dealt(pages, "page_id"), "page_id")
    if nodes is None:
        nodes = dom.dom_nodes(pages)
    # both feed the per-rule results and the step report
    vals, st = run_steps(nodes, steps, pages, stored=True, **kw)
    extracted, summary, data = sequence_results(vals, st, steps, pages, nodes if enable_structuring else None, compat, by_text)
    return Execution(extracted, summary, st, data)


def execute_single(pages: DataFrame, steps: DataFrame, nodes: DataFrame | None = None, **kw):
    """One-step rules; step rows with their values array."""
    if nodes is None:
        nodes = dom.dom_nodes(pages)
    vals, st = run_steps(nodes, steps, pages, **kw)
    arr = vals.groupBy("page_id", *KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"]).alias("data")
    )
    return st.join(arr, ["page_id", *KEY], "left").withColumn("data", F.coalesce("data", F.array().cast("array<string>")))


def probe(pages: DataFrame, steps: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Whether each rule can run on each page, how many results of which
    kinds it has (``elem`` / ``text`` / ``attr``), and the first 3 values."""
    if nodes is None:
        nodes = dom.dom_nodes(pages)
    kinds = select.select_nodes(nodes, steps).groupBy("page_id", *KEY).agg(F.sort_array(F.collect_set("kind")).alias("result_types"))
    single = execute_single(pages, steps, nodes).join(kinds, ["page_id", *KEY], "left")
    return single.select(
        "page_id", *KEY, "xpath", (F.col("has_branches") & ~F.col("page_failed")).alias("valid"),
        F.col("element_count").alias("result_count"),
        F.coalesce("result_types", F.array().cast("array<string>")).alias("result_types"),
        F.slice("data", 1, 3).alias("sample_results"),
        F.when(F.col("page_failed") | ~F.col("has_branches"), F.col("error_message")).alias("error_message"))
