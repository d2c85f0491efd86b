"""Scrape with stored rules, learn where none exist, validate and
publish per domain, and the result envelope / run report.

Each flow is a handful of joins and aggregations over the page table; the
rule side is small and broadcast, the page side stays partitioned by
page_id, and per-domain work is aggregated (never collected per domain).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import urls
from ..operators import dom, execute, learn, profile, repository, validate
from ..operators import select as S
from ..session import cut_lineage, kept


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages with html replaced by its cleaned form (C1), plus domain."""
    pc = profile.with_clean(pages)
    return pc.select("page_id", "url", F.col("html_clean").alias("html"), urls.domain(F.col("url")).alias("domain"))


def rule_steps(rules: DataFrame) -> DataFrame:
    """Rule table -> step table (one row per action), with the page of each rule if
    the table has it."""
    own = S.keys_of(rules, ["sequence_id"])
    return rules.select(*own, F.explode("actions").alias("a")).select(
        *own, F.col("a.step_index").alias("step_index"), F.col("a.action_type").alias("action_type"),
        F.col("a.attribute").alias("attribute"), F.col("a.xpath").alias("xpath"),
        F.col("a.branches").alias("branches"), F.col("a.post").alias("post"),
    )


def publish(ranked: DataFrame, steps: DataFrame, task: str, stamp: str, selected_only: bool = False) -> DataFrame:
    """J4 publish: evaluated (domain, rule) rows become stored rules with their
    validation scores, every one with its rank and whether it was selected, or
    the selected one of each domain only.

    ``stamp`` is the run timestamp (ISO text) — passed in so ids repeat.
    The id is I9 over (domain, task, stamp/source rule)."""
    acts = steps.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("step_index", "action_type", "attribute", "xpath", "branches", "post"))).alias("actions")
    )
    ts = F.to_timestamp(F.lit(stamp))
    ranked = ranked.filter("is_selected") if selected_only else ranked
    r = ranked.join(S.small(acts, S.rule_meta(steps)["n_steps"]), "sequence_id")
    return r.select(
        repository.rule_id(F.col("grp"), F.lit(task), F.concat(F.lit(stamp + "/"), F.col("sequence_id"))).alias("sequence_id"),
        F.col("grp").alias("domain"), F.lit(task).alias("extraction_task"), "actions",
        F.col("success_rate").cast("double").alias("success_rate"),
        F.col("robustness_score").cast("double").alias("robustness_score"),
        ts.alias("created_at"), ts.alias("updated_at"),
        F.create_map(
            F.lit("source_rule"), F.col("sequence_id"), F.lit("rank"), F.col("rank").cast("string"),
            F.lit("is_selected"), F.col("is_selected").cast("string"),
            F.lit("generation_method"), F.lit("cross_validation"),
        ).alias("metadata"),
    )


def validate_and_publish(pages: DataFrame, steps: DataFrame, rule_tasks: DataFrame, task: str, stamp: str,
                         nodes: DataFrame | None = None):
    """Cross-validate the rules on every domain, publish the ranked
    rules.  Returns (rules table, ranked, summary)."""
    pc = clean_pages(pages)
    if nodes is None:
        nodes = dom.dom_nodes(pc)
    ranked, summary, _ = validate.cross_validate(pc, steps, rule_tasks, by="domain", nodes=nodes)
    return publish(ranked, steps, task, stamp), ranked, summary


def final_values(data: DataFrame) -> DataFrame:
    """Final data as text: a record as JSON, a value as it is."""
    return data.select(*[c for c in data.columns if c not in ("value", "record", "strategy")],
                       F.coalesce("value", F.to_json("record")).alias("value"))


def scrape_known(pages: DataFrame, rules: DataFrame, task: str, nodes: DataFrame | None = None,
                 limit: int = fixed.SCRAPE_RULE_LIMIT):
    """For each page, run the top ``limit`` stored rules of (domain,
    task), score = successful/total steps × items of the final data, strictly
    best > 0 wins, ties to the higher-ranked rule.

    Returns (results, values): results (page_id, domain, task, success,
    sequence_id, data_count, success_rate, robustness_score, error);
    values (page_id, idx, value) of the winning rule."""
    spark = pages.sparkSession
    pc = clean_pages(pages)
    if nodes is None:
        nodes = dom.dom_nodes(pc)
    tasks = spark.createDataFrame([(task,)], "task string")
    cand = cut_lineage(repository.rules_for_pages(pc, rules, tasks, limit))  # page_id, domain, sequence_id, rank, ...
    # only rules that some page runs, and each page only with its own
    steps = rule_steps(rules.join(cand.select("sequence_id").distinct(), "sequence_id", "left_semi"))
    pairs = cand.select("page_id", "sequence_id")
    vals, st = execute.run_steps(nodes, steps, pc, pairs=pairs, stored=True)
    _, summary, data = execute.sequence_results(vals, st, steps, pc, nodes)
    sc = summary.join(cand.select("page_id", "sequence_id", "rank", "robustness_score"), ["page_id", "sequence_id"])
    sc = sc.withColumn("score", F.col("successful_steps") / F.col("total_steps") * F.col("data_count"))
    ok = sc.filter(F.col("success") & (F.col("data_count") > 0) & (F.col("score") > 0))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), F.asc("rank"))
    best = ok.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") == 1)
    errors = dom.node_errors(nodes).withColumnRenamed("error_message", "page_error")
    res = pc.select("page_id", "domain").join(best, "page_id", "left").join(errors, "page_id", "left").select(
        "page_id", "domain", F.lit(task).alias("task"), F.col("sequence_id").isNotNull().alias("success"),
        "sequence_id", F.coalesce("data_count", F.lit(0)).cast("bigint").alias("data_count"),
        "success_rate", "robustness_score",
        F.when(F.col("sequence_id").isNull(), F.coalesce("page_error", F.lit(fixed.MSG_NO_RULE_RESULTS))).alias("error"),
    )
    values = final_values(data.join(best.select("page_id", "sequence_id"), ["page_id", "sequence_id"], "left_semi")).select(
        "page_id", "idx", "value")
    return res, values


def _millis():
    """The clock of the task that handles a row."""
    return F.expr("cast(reflect('java.lang.System', 'currentTimeMillis') as bigint)")


def clock(pages: DataFrame) -> DataFrame:
    """(page_id, url, started_ms): when each page was taken up, written down at once."""
    return cut_lineage(pages.select("page_id", "url").withColumn("started_ms", _millis()))


def run_log(results: DataFrame, started: DataFrame, task: str) -> DataFrame:
    """A line for each scrape, written down at once: (page_id, url, task, status, seconds,
    items, line).  ``seconds`` is the time from a page's ``started_ms`` to its result."""
    j = results.select("page_id", "success", F.when(F.col("success"), F.col("data_count")).otherwise(0).alias("items")).join(started, "page_id")
    j = j.withColumn("seconds", F.greatest(F.lit(0.0), (_millis() - F.col("started_ms")) / 1000.0))
    status = F.when(F.col("success"), fixed.LOG_SUCCESS).otherwise(fixed.LOG_FAILED)
    line = F.format_string(fixed.LOG_LINE, status, F.coalesce("url", F.lit("")), F.lit(task), F.col("seconds"))
    return cut_lineage(j.select("page_id", "url", F.lit(task).alias("task"), status.alias("status"), "seconds", "items",
                                F.when(F.col("items") > 0, F.concat(line, F.format_string(fixed.LOG_ITEMS, "items"))).otherwise(line).alias("line")))


def append_log(log: DataFrame, path: str) -> None:
    """The lines, appended to the text files below ``path``."""
    log.select("line").write.mode("append").text(path)


def envelope(results: DataFrame, values: DataFrame, is_new_rule: bool = False, stamp: str | None = None,
             log: DataFrame | None = None) -> DataFrame:
    """The result document per page (success, data, error, metadata);
    ``log`` (see :func:`run_log`) has the pages' execution times."""
    data = values.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("data")
    )
    ts = F.lit(stamp) if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    j = results.join(data, "page_id", "left")
    j = j.join(log.select("page_id", "seconds"), "page_id", "left") if log is not None else j.withColumn("seconds", F.lit(None).cast("double"))
    return j.select(
        "page_id", "success",
        F.when(F.col("success"), F.coalesce("data", F.array().cast("array<string>"))).alias("data"),
        "error",
        F.struct(
            F.col("task").alias("task"), F.col("domain").alias("domain"), F.col("sequence_id").alias("sequence_id"),
            F.lit(is_new_rule).alias("is_new_rule"), F.col("data_count").alias("data_count"),
            F.col("success_rate").alias("success_rate"), F.col("robustness_score").alias("robustness_score"),
            F.col("seconds").alias("execution_time_seconds"), ts.alias("timestamp"),
        ).alias("metadata"),
    )


def write_results(envelopes: DataFrame, path: str) -> None:
    """A4: result documents as JSON lines, a folder per hash of the page so that
    no site becomes a folder (or a file) of its own."""
    envelopes.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(16))).write.partitionBy("part").mode("errorifexists").json(path)


def run_report(results: DataFrame) -> DataFrame:
    """One line per scrape rolled up per (domain, task): sessions,
    successes, items (counted only for successful scrapes with items)."""
    return results.groupBy("domain", "task").agg(
        F.count("*").alias("sessions"),
        F.sum(F.col("success").cast("bigint")).alias("successes"),
        F.sum(F.when(F.col("success") & (F.col("data_count") > 0), F.col("data_count")).otherwise(0)).cast("bigint").alias("items"),
    )


def learn_and_publish(pages: DataFrame, task: str, stamp: str, max_iterations: int = fixed.MAX_ITERATIONS,
                      min_confidence: float = fixed.MIN_CONFIDENCE):
    """Learn on each domain's pages, validate the distinct rules of a domain
    on all its pages, publish the selected one.  Returns (rules, ranked, summary)."""
    pc = clean_pages(pages)
    nodes = dom.dom_nodes(pc)
    learned, _, book = learn.learn(pages, [task], max_iterations, min_confidence, route_on="task", nodes=nodes)
    group = pc.select("page_id", F.coalesce("domain", F.lit("")).alias("grp"))
    rules = learned.filter("success").join(group, "page_id").select("grp", "rule_id", "bound").distinct()
    rules = cut_lineage(rules.withColumn("sequence_id", S.bound_id(F.col("rule_id"), F.col("bound"))))
    # Only rules that some domain has learned (a part of the bounded rule book).
    used = {r.rule_id for r in rules.select("rule_id").distinct().collect()}
    steps = book.frame(pages.sparkSession, [i for i in sorted(book.rules) if i in used])
    if any(i.startswith("bound(") or "bound(" in i for i in used):
        steps = S.bind_steps(steps, rules.select(F.col("rule_id").alias("sequence_id"), "bound"))
    rules = rules.select("grp", "sequence_id")
    pairs = group.join(S.small(rules, rules.count()), "grp").select("page_id", "sequence_id")
    tasks = rules.select("sequence_id").distinct().withColumn("task", F.lit(task)).withColumn(
        "rule_ord", F.dense_rank().over(Window.partitionBy("task").orderBy("sequence_id")))  # learned rules, not pages
    ranked, summary, _ = validate.cross_validate(pc, steps, tasks, by="domain", nodes=nodes, pairs=pairs)
    return publish(ranked, steps, task, stamp, selected_only=True), ranked, summary


def _trace_steps(trace: DataFrame, max_iterations: int) -> DataFrame:
    """(page_id, task, step_index, rule_id, bound) of the actions a learning run
    records: the initial rule, then for each iteration the tried rule and, if it
    was repaired, the step back.  A rule that is neither accepted nor repaired is
    tried again in every iteration that is left."""
    bound = F.col("bound") if "bound" in trace.columns else F.lit(None).cast("string")
    task = F.col("task") if "task" in trace.columns else F.lit(None).cast("string")
    t = trace.select("page_id", task.alias("task"), "iteration", "rule_id", bound.alias("bound"), "action")
    again = F.when(F.col("action") == "kept", F.lit(max_iterations) - F.col("iteration") + 1).otherwise(
        F.when(F.col("action") == "accepted", 1).otherwise(2))  # a repair records the rule twice
    n = F.when(F.col("iteration") == 1, again + 1).otherwise(again)
    t = t.select("page_id", "task", "iteration", "rule_id", "bound", F.posexplode(F.sequence(F.lit(1), n)).alias("k", "_"))
    w = Window.partitionBy("page_id", "task").orderBy("iteration", "k")
    return t.select("page_id", "task", (F.row_number().over(w) - 1).alias("step_index"), "rule_id", "bound")


def scrape_learn(pages: DataFrame, rules: DataFrame, tasks: str | list[str], stamp: str, keep_trace: bool = True,
                 max_iterations: int = fixed.MAX_ITERATIONS, min_confidence: float = fixed.MIN_CONFIDENCE):
    """Pages whose (domain, task) has no stored rule learn one; the
    learned rule (by default the whole trace of recorded actions, as stored by
    the original flow) is executed and stored when it yields data.  All tasks
    share one node table, one learning run and one execution.

    Returns (new rules, results), results with a row for each (page, task)
    that had no rule."""
    asked = [tasks] if isinstance(tasks, str) else list(dict.fromkeys(tasks))
    pc = clean_pages(pages)
    have = rules.filter(F.col("extraction_task").isin(asked)).select("domain", F.col("extraction_task").alias("task")).distinct()
    # Only ids and domains meet the rule table, not the pages themselves.
    ids = pc.select("page_id", "domain", F.explode(F.array(*[F.lit(t) for t in asked])).alias("task"))
    ids = kept(ids.join(S.small(have, have.count()), ["domain", "task"], "left_anti"))
    todo = pc.join(ids.select("page_id"), "page_id", "left_semi")
    nodes = dom.dom_nodes(todo)
    learned, trace, book = learn.learn(todo.select("page_id", "url", "html"), asked, max_iterations,
                                       min_confidence, route_on="task", nodes=nodes, pairs=ids.select("page_id", "task"))
    own = ["page_id", "task"]
    ok = learned.filter("success")
    tr = _trace_steps(trace, max_iterations) if keep_trace else ok.select(*own, F.lit(0).alias("step_index"), "rule_id", "bound")
    book_steps = book.frame(pages.sparkSession, sorted(book.rules)).select(
        F.col("sequence_id").alias("rule_id"), "action_type", "attribute", "xpath", "branches", "post")
    # The rule book is bounded by the catalogue and the iterations.
    acts = tr.join(ok.select(*own), own, "left_semi").join(F.broadcast(book_steps), "rule_id")
    filled = F.transform("post", lambda o: F.when(o["op"] == "bound", F.struct(o["op"].alias("op"), o["n"].alias("n"), F.col("bound").alias("s"))).otherwise(o))
    acts = acts.withColumn("post", filled)
    acts = acts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(
        "step_index", "action_type", "attribute", "xpath", "branches", "post"))).alias("actions"))
    meta = ok.join(todo.select("page_id", "url", "domain"), "page_id")
    new = meta.join(acts, own).select(
        "page_id",
        repository.rule_id(F.col("domain"), F.col("task"), F.concat(F.lit(stamp + "/"), F.col("page_id").cast("string"))).alias("sequence_id"),
        "domain", F.col("task").alias("extraction_task"), "actions",
        F.col("confidence").alias("success_rate"), F.col("confidence").alias("robustness_score"),
        F.to_timestamp(F.lit(stamp)).alias("created_at"), F.to_timestamp(F.lit(stamp)).alias("updated_at"),
        F.create_map(F.lit("source_url"), F.col("url"), F.lit("phase1_iterations"), F.col("total_iterations").cast("string"),
                     F.lit("initial_data_count"), F.col("data_count").cast("string"),
                     F.lit("generation_method"), F.lit("phase1_direct")).alias("metadata"),
    )
    new = kept(new)
    steps = rule_steps(new)
    pairs = new.select("page_id", "sequence_id")
    vals, st = execute.run_steps(nodes, steps, todo, pairs=pairs, stored=True)
    _, summary, _ = execute.sequence_results(vals, st, steps, todo, nodes)
    summary = kept(summary.select("page_id", "sequence_id", "success", "total_steps", "data_count"))
    stored = new.join(summary.filter(F.col("success") & (F.col("data_count") > 0)).select("page_id", "sequence_id"),
                      ["page_id", "sequence_id"], "left_semi").drop("page_id")
    errors = dom.node_errors(nodes).withColumnRenamed("error_message", "page_error")
    done = summary.join(new.select("page_id", "sequence_id", F.col("extraction_task").alias("task")), ["page_id", "sequence_id"])
    results = ids.select("page_id", "domain", "task").join(done, own, "left").join(errors, "page_id", "left").select(
        "page_id", "domain", "task", F.coalesce("success", F.lit(False)).alias("success"),
        "sequence_id", F.coalesce("total_steps", F.lit(0)).cast("bigint").alias("total_steps"),
        F.coalesce("data_count", F.lit(0)).cast("bigint").alias("data_count"),
        F.when(~F.coalesce("success", F.lit(False)), F.coalesce("page_error", F.lit(fixed.MSG_NO_RULE))).alias("error"),
    )
    return stored, results
