"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
operator, each reading the given tables whole.

Computed columns are aliased to the names the SQL checks use; doubles are
rounded to 6 places so a different summation order cannot flip a digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import urls
from ..operators import advise, dom, execute, learn, profile, repository, structure, validate
from ..operators import select as S
from ..session import cut_lineage, read_table, shared_path, tune
from ..sources import captures
from . import catalog, scrape

STAMP = "2026-01-01T00:00:00"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    return read_table(spark, sf, "pages")


def _clean(spark, sf) -> DataFrame:
    return profile.with_clean(_pages(spark, sf))


def _clean_pages(spark, sf) -> DataFrame:
    return scrape.clean_pages(_pages(spark, sf))


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# B: URLs
# ---------------------------------------------------------------------------


def url_validate(spark, sf):
    p = _pages(spark, sf)
    iss = urls.issues(F.col("url"))
    return p.select("page_id", "url", (F.size(iss) == 0).alias("valid"),
                    F.array_join(iss, "; ").alias("issues"), F.size(iss).cast("bigint").alias("n_issues"),
                    urls.loose_valid(F.col("url")).alias("loose_valid"))


def url_metadata(spark, sf):
    p = _pages(spark, sf)
    m = urls.metadata(F.col("url"))
    return p.filter(urls.is_valid(F.col("url"))).select(
        "page_id", m.scheme.alias("scheme"), m.domain.alias("domain"), m.path.alias("path"),
        m.has_query.alias("has_query"), m.has_fragment.alias("has_fragment"), m.is_secure.alias("is_secure"),
        m.port.cast("bigint").alias("port"), F.size(m.path_segments).cast("bigint").alias("n_segments"),
        F.array_join(m.path_segments, "/").alias("segments"), m.site_type.alias("site_type"),
    )


def url_normalize(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", urls.normalized(F.col("url")).alias("normalized"))


def domain_counts(spark, sf):
    p = _pages(spark, sf)
    return p.groupBy(urls.domain(F.col("url")).alias("domain")).agg(
        F.count("*").alias("n_pages"),
        F.sum((urls.scheme(F.col("url")) == "https").cast("bigint")).alias("n_secure"),
    )


def robots_urls(spark, sf):
    p = _pages(spark, sf)
    return p.select(urls.domain(F.col("url")).alias("domain"), urls.robots_url(F.col("url")).alias("robots_url")).distinct()


def page_links(spark, sf):
    """Every a[href] resolved against the page URL, internal flag."""
    pc = _clean(spark, sf)
    toks = profile.tag_tokens(pc, carry=("url",)).filter((F.col("tag") == "a") & F.col("has_href"))
    href = T.decode_entities(F.regexp_extract(F.col("attrs"), r"[ \t\n\r\f]href=\"([^\"]*)\"", 1))
    t = toks.select("page_id", "pos", "url", href.alias("href"))
    t = urls.resolve(t, "url", "href", "absolute")
    return t.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "absolute",
        F.coalesce(urls.domain(F.col("absolute")) == urls.domain(F.col("url")), F.lit(False)).alias("is_internal"),
    )


# ---------------------------------------------------------------------------
# C / D: cleaning and profiles
# ---------------------------------------------------------------------------


def clean_html(spark, sf):
    pc = _clean(spark, sf)
    return pc.select("page_id", F.length("html_clean").cast("bigint").alias("clean_len"),
                     F.md5("html_clean").alias("clean_md5"))


def page_text(spark, sf):
    pc = _clean(spark, sf)
    t = T.page_text(F.col("html_clean"))
    return pc.select("page_id", F.length(t).cast("bigint").alias("text_len"), F.md5(t).alias("text_md5"))


def structure_info(spark, sf):
    return profile.structure_info(_clean(spark, sf))


def basic_stats(spark, sf):
    return profile.basic_stats(_clean(spark, sf))


def tag_distribution(spark, sf):
    return profile.element_distribution(_clean(spark, sf))


def class_top10(spark, sf):
    return profile.class_patterns(_clean(spark, sf))


def _order_pages(spark, sf) -> DataFrame:
    """A listing page per order, made of its lines: pages with classes."""
    tune(spark)
    line = F.concat(
        F.lit('<li class="line-item '), F.lower("l_returnflag"), F.lit('"><span class="item-name label">Part '), F.col("l_partkey").cast("string"),
        F.lit('</span><b class="price">$'), F.col("l_quantity").cast("bigint").cast("string"), F.lit(".00</b></li>"))
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", line.alias("html")).alias("l"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["html"]), "")
    one = lines.groupBy("l_orderkey").agg(items.alias("items"))  # an order has a few lines
    return one.select(F.col("l_orderkey").cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"),
                      F.concat(F.lit('<html><body><ul class="order list">'), "items", F.lit("</ul></body></html>")).alias("html"))


def semantic_classes(spark, sf):
    return profile.semantic_classes(profile.with_clean(_order_pages(spark, sf)))


def price_patterns(spark, sf):
    return profile.price_patterns(_clean(spark, sf))


def repeated_classes(spark, sf):
    return profile.repeated_classes(profile.with_clean(_order_pages(spark, sf)))


def content_patterns_pages(spark, sf):
    return profile.content_patterns(_pages(spark, sf), "page_id", "html")


def content_patterns_docs(spark, sf):
    tune(spark)
    docs = read_table(spark, sf, "documents")
    return profile.content_patterns(docs, "doc_id", "text")


def dom_nodes(spark, sf):
    pc = _clean_pages(spark, sf)
    n = dom.parse_nodes(pc)
    return n.select("page_id", "pre", "last", "parent", "depth", "kind", "tag", "cls", "text", "text_len")


def dom_tags(spark, sf):
    """D1 by counts: elements of each tag, and text nodes (``#text``) with
    their characters."""
    n = dom.good_nodes(dom.parse_nodes(_clean_pages(spark, sf)))
    return n.groupBy("page_id", F.coalesce("tag", F.lit("#text")).alias("tag")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("n_chars"))


def dom_profile(spark, sf):
    """One nested report per page, lists as JSON."""
    pc = profile.stored_clean(_pages(spark, sf))
    nodes = dom.dom_nodes(pc.select("page_id", F.col("html_clean").alias("html")))
    full = profile.full_profile(pc, nodes)
    return full.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in full.dtypes])


def task_patterns(spark, sf):
    pc = _clean_pages(spark, sf)
    return profile.task_patterns(dom.dom_nodes(pc), catalog.LEARN_TASKS).select(
        "page_id", "task", F.array_join("patterns", ",").alias("patterns"))


def dynamic_pages(spark, sf):
    p = _pages(spark, sf)
    return profile.dynamic_pages(p, dom.dom_nodes(p)).withColumn("reasons", F.array_join("reasons", ","))


def page_routes(spark, sf):
    """A3: pages kept as they are, and pages to be rendered first."""
    p = _pages(spark, sf)
    keep, render = profile.route_pages(p, profile.dynamic_pages(p, dom.dom_nodes(p)))
    return keep.select("page_id", F.lit("static").alias("route")).unionByName(render.select("page_id", F.lit("render").alias("route")))


# ---------------------------------------------------------------------------
# E: rule execution
# ---------------------------------------------------------------------------


def _run(spark, sf, rules: dict, **kw):
    pc = _clean_pages(spark, sf)
    steps = S.steps_frame(spark, rules)
    return execute.execute(pc, steps, **kw)


def extract_titles(spark, sf):
    ex = _run(spark, sf, {"r_headings": [learn.CANDIDATES["title"]]}, enable_structuring=False).extracted
    return ex.select("page_id", F.col("idx").cast("bigint").alias("idx"), "value")


def extract_links(spark, sf):
    ex = _run(spark, sf, {catalog.LINKS_RULE[0]: [catalog.LINKS_RULE[1]]}, enable_structuring=False).extracted
    return ex.select("page_id", F.col("idx").cast("bigint").alias("idx"), "value")


def single_rule(spark, sf):
    """One rule on every page, with its values."""
    steps = S.steps_frame(spark, {catalog.FLAT_RULES[3][0]: [catalog.FLAT_RULES[3][2]]})
    one = execute.execute_single(_clean_pages(spark, sf), steps)
    return one.select("page_id", "sequence_id", "status", "element_count", "data_count", F.array_join("data", "|").alias("data"))


def step_status(spark, sf):
    rules = {rid: [st] for rid, _, st in catalog.FLAT_RULES}
    rules[catalog.LINKS_RULE[0]] = [catalog.LINKS_RULE[1]]
    st = _run(spark, sf, rules, enable_structuring=False).steps
    return st.select("page_id", "sequence_id", "status", "element_count", "data_count", "error_message")


def sequence_results(spark, sf):
    summ = _run(spark, sf, {catalog.MULTI_RULE[0]: catalog.MULTI_RULE[1]}).summary
    return summ.select("page_id", "sequence_id", "success", "total_steps", "successful_steps", "failed_steps",
                       "data_count", _r6(F.col("success_rate")).alias("success_rate"),
                       _r6(F.col("data_extraction_rate")).alias("data_extraction_rate"))


def rule_probe(spark, sf):
    pc = _clean_pages(spark, sf)
    rules = {rid: [st] for rid, _, st in catalog.FLAT_RULES} | {"r_broken": [S.Step([], xpath="//x[[")]}
    pr = execute.probe(pc, S.steps_frame(spark, rules))
    return pr.select("page_id", "sequence_id", "valid", "result_count", F.array_join("result_types", ",").alias("result_types"),
                     F.array_join("sample_results", " | ").alias("sample"))


def rule_programs(spark, sf):
    """Rules that walk on from their elements, of different lengths: next
    sibling, parent, texts below, position and length filters."""
    a = [S.Branch(tags=["a"])]
    rules = {
        "next_items": S.Step(a, post=[S.op("parent"), S.op("next_sibling"), S.op("desc_text")]),
        "first_two": S.Step(a, post=[S.op("position_max", 2), S.op("child_text")]),
        "middle_length": S.Step([S.Branch(tags=["a"], output="text")], post=[S.op("len_gt", 3), S.op("len_lt", 8)]),
        "grandparents_first": S.Step(a, post=[S.op("parent"), S.op("parent"), S.op("desc_text"), S.op("len_gt", 2), S.op("position_max", 3)])}
    ex = _run(spark, sf, {k: [v] for k, v in rules.items()}, enable_structuring=False).extracted
    return ex.select("page_id", "sequence_id", F.col("idx").cast("bigint").alias("idx"), "value")


def action_dispatch(spark, sf):
    """Unknown and missing actions, attributes of texts and elements,
    and at most three results of a step."""
    text, elem = [S.Branch(tags=["a"], output="text")], [S.Branch(tags=["a"])]
    rules = {"unknown": S.Step(text, action_type="xpath_guess"), "none": S.Step(text, action_type=None),
             "attribute_of_text": S.Step(text, action_type=fixed.ACTION_ATTRIBUTE, attribute="title"),
             "default_attribute": S.Step(elem, action_type=fixed.ACTION_ATTRIBUTE)}
    st = execute.execute_single(_clean_pages(spark, sf), S.steps_frame(spark, {k: [v] for k, v in rules.items()}), max_results=3)
    return st.select("page_id", "sequence_id", "status", "element_count", "data_count", "error_message", F.array_join("data", "|").alias("data"))


def extract_html(spark, sf):
    rule = {"r_ad_html": [S.Step([S.Branch(tags=["div"], class_any=["ad"])], action_type=fixed.ACTION_HTML)]}
    ex = _run(spark, sf, rule, enable_structuring=False).extracted
    return ex.select("page_id", F.col("idx").cast("bigint").alias("idx"), "value")


# ---------------------------------------------------------------------------
# F: structuring
# ---------------------------------------------------------------------------


def _field_rows(f):
    from pyspark.sql.window import Window

    w = Window.partitionBy("page_id", "tag").orderBy("pre")
    return f.select("page_id", "tag", F.row_number().over(w).cast("bigint").alias("idx"), "field")


def field_inference(spark, sf):
    """The part of :func:`field_inference_all` that its SQL can match: elements
    without element children that are not void."""
    f = structure.field_names(dom.dom_nodes(_clean_pages(spark, sf)))
    return _field_rows(f.filter((F.col("n_elem") == 0) & ~F.col("tag").isin(*fixed.VOID_TAGS)))


def field_inference_all(spark, sf):
    return _field_rows(structure.field_names(dom.dom_nodes(_clean_pages(spark, sf))))


def nav_filter(spark, sf):
    ex = _run(spark, sf, {"r_link_text": [catalog.FLAT_RULES[3][2]]}, enable_structuring=False).extracted
    return ex.select("page_id", F.col("idx").cast("bigint").alias("idx"), "value",
                     structure.is_navigation(F.col("value")).alias("is_nav"))


def structured_records(spark, sf):
    """how many records (or values) each rule gives on each page."""
    data = _run(spark, sf, catalog.VALIDATED).data
    return data.groupBy("page_id", "sequence_id").agg(F.count("*").alias("data_count"))


def product_records(spark, sf):
    """F11 on listing pages: the records of name and price of every order."""
    rule = {"r_items": [S.Step([S.Branch(tags=["span"], output="text")]), S.Step([S.Branch(tags=["b"], output="text")])]}
    run = execute.execute(_order_pages(spark, sf), S.steps_frame(spark, rule))
    return run.data.select("page_id", F.col("idx").cast("bigint").alias("idx"), "strategy", F.col("record")["price"].alias("price"),
                           F.col("record")["title"].alias("title"))


# ---------------------------------------------------------------------------
# G: learning and advice
# ---------------------------------------------------------------------------


def text_lookup(spark, sf):
    """for the head of every link's text, the first 5 elements whose
    first text holds it."""
    nodes = dom.dom_nodes(_clean_pages(spark, sf))
    a = dom.elements(nodes).filter("tag = 'a' AND first_text IS NOT NULL")
    needles = a.select("page_id", structure.head(F.col("first_text"), fixed.LOOKUP_CHARS).alias("needle"))
    hits = structure.text_lookup(nodes, needles, fixed.LOOKUP_ELEMENTS)
    e = dom.elements(nodes).select("page_id", "pre", "tag", F.md5("first_text").alias("text_md5"))
    return hits.join(e, ["page_id", "pre"]).select("page_id", "needle", F.col("r").cast("bigint").alias("rank"), "tag", "text_md5")


def task_routing(spark, sf):
    pc = _clean(spark, sf)
    pt = pc.select("page_id", "html_clean", F.explode(F.array(*[F.lit(t) for t in catalog.LEARN_TASKS])).alias("task"))
    hay = learn.prompt_haystack(pt)
    return hay.select("page_id", "task", learn.route(F.col("hay")).alias("branch"),
                      learn.route(F.lower(F.col("task"))).alias("task_branch"))


def rule_score(spark, sf):
    """Each task's routed candidate rule scored on every page."""
    pc = _clean_pages(spark, sf)
    nodes = dom.dom_nodes(pc)
    tasks = spark.createDataFrame([(t,) for t in catalog.LEARN_TASKS], "task string")
    routed = tasks.select("task", F.concat(F.lit("cand:"), learn.route(F.lower("task"))).alias("sequence_id"))
    book = learn.RuleBook()
    ids = sorted({f"cand:{k}" for k in learn.CANDIDATES})
    steps = book.frame(spark, ids)
    grid = pc.select("page_id", F.explode(F.array(*[F.lit(t) for t in catalog.LEARN_TASKS])).alias("task")).join(
        F.broadcast(routed), "task")
    vals, _ = execute.run_steps(nodes, steps, None, normalize_whitespace=False, max_results=1 << 30,
                                pairs=grid.select("page_id", "sequence_id").distinct(), keep_empty_text=True)
    first = vals.groupBy("page_id", "sequence_id", "value").agg(F.min("ord").alias("ord"))
    v = first.join(grid, ["page_id", "sequence_id"])
    sc = learn.with_empty_scores(grid, learn.score(v, ["page_id", "task", "sequence_id"]), ["page_id", "task", "sequence_id"])
    return sc.select("page_id", "task", "sequence_id", "n", "is_weak", "success",
                     _r6(F.col("task_score")).alias("task_score"), _r6(F.col("consistency")).alias("consistency"),
                     _r6(F.col("confidence")).alias("confidence"), F.array_join(learn.issues(), "; ").alias("issues"))


def learn_rules(spark, sf):
    p = _pages(spark, sf)
    learned, _, _ = learn.learn(p, catalog.LEARN_TASKS, route_on="task")
    return learned.select("page_id", "task", "success", "rule_id", "xpath", _r6(F.col("confidence")).alias("confidence"), "data_count", "total_iterations")


def learn_trace(spark, sf):
    p = _pages(spark, sf)
    _, trace, _ = learn.learn(p, catalog.LEARN_TASKS, route_on="prompt")
    return trace.select("page_id", "task", "iteration", "rule_id", "xpath", "success", _r6(F.col("confidence")).alias("confidence"), "data_count", "action")


def rule_suggestions(spark, sf):
    pc = _clean_pages(spark, sf)
    return advise.suggestions_probe(pc, catalog.LEARN_TASKS)


def advice(spark, sf):
    rules = {rid: [st] for rid, _, st in catalog.FLAT_RULES}
    rules[catalog.LINKS_RULE[0]] = [catalog.LINKS_RULE[1]]
    run = _run(spark, sf, rules)
    return advise.advice(run.steps, run.summary)


# ---------------------------------------------------------------------------
# H: cross-page validation
# ---------------------------------------------------------------------------


def _validate(spark, sf):
    pc = _clean_pages(spark, sf)
    return validate.cross_validate(pc, catalog.validated_steps(spark), catalog.validation_rules(spark), by="domain")


def cross_validate(spark, sf):
    ranked, _, _ = _validate(spark, sf)
    return ranked.select(
        "grp", "sequence_id", "pages_tested", "successful_pages",
        *[_r6(F.col(c)).alias(c) for c in
          ["success_rate", "consistency_score", "coverage_score", "quality_score", "robustness_score"]],
    )


def rank_rules(spark, sf):
    ranked, _, _ = _validate(spark, sf)
    return ranked.select("grp", "sequence_id", "rank", "is_selected")


def validation_summary(spark, sf):
    _, summary, _ = _validate(spark, sf)
    return summary.select(
        "grp", "total_sequences_evaluated", "total_pages_tested",
        _r6(F.col("average_robustness_score")).alias("average_robustness_score"),
        _r6(F.col("best_robustness_score")).alias("best_robustness_score"),
        _r6(F.col("robustness_score_variance")).alias("robustness_score_variance"),
        "selected_sequence_id", "pages_successful", "pages_failed",
        _r6(F.col("average_data_count")).alias("average_data_count"),
    )


# ---------------------------------------------------------------------------
# I / J: rule table and end-to-end flows
# ---------------------------------------------------------------------------


def _published(spark, sf, nodes=None):
    """The rule table published by cross-validation, materialised once
    (a reliable checkpoint in the shared checkpoint folder), as a stored
    rule table would be."""
    pages = _pages(spark, sf)
    rules, ranked, summary = scrape.validate_and_publish(
        pages, catalog.validated_steps(spark), catalog.validation_rules(spark), catalog.VALIDATION_TASK, STAMP, nodes)
    return cut_lineage(rules)


def _scraped(spark, sf):
    """Publishing and scraping of the same pages, cleaned and parsed once."""
    nodes = dom.dom_nodes(_clean_pages(spark, sf))
    return scrape.scrape_known(_pages(spark, sf), _published(spark, sf, nodes), catalog.VALIDATION_TASK, nodes)


def publish_rules(spark, sf):
    r = _published(spark, sf)
    return r.select("sequence_id", "domain", "extraction_task", _r6(F.col("robustness_score")).alias("robustness_score"),
                    F.col("metadata")["source_rule"].alias("source_rule"), F.col("metadata")["is_selected"].alias("is_selected"))


def rules_top_by_domain(spark, sf):
    r = repository.top_per(_published(spark, sf), ["domain"], fixed.FETCH_BY_DOMAIN_LIMIT)
    return r.select("domain", F.col("rank").cast("bigint").alias("rank"), "sequence_id",
                    _r6(F.col("robustness_score")).alias("robustness_score"))


def rules_by_domain_task(spark, sf):
    rules = _published(spark, sf)
    pc = _clean_pages(spark, sf)
    tasks = spark.createDataFrame([(catalog.VALIDATION_TASK,)], "task string")
    m = repository.rules_for_pages(pc, rules, tasks, fixed.SCRAPE_RULE_LIMIT)
    return m.select("page_id", F.col("rank").cast("bigint").alias("rank"), "sequence_id")


def rules_stats(spark, sf):
    return repository.statistics(_published(spark, sf))


def rules_list(spark, sf):
    r = repository.list_all(_published(spark, sf))
    return r.select("sequence_id", "domain", _r6(F.col("robustness_score")).alias("robustness_score"))


def scrape_known(spark, sf):
    res, _ = _scraped(spark, sf)
    return res.select("page_id", "domain", "task", "success", "sequence_id", "data_count", "error")


def run_report(spark, sf):
    res, _ = _scraped(spark, sf)
    return scrape.run_report(res)


def scrape_envelope(spark, sf):
    res, vals = _scraped(spark, sf)
    env = scrape.envelope(res, vals, stamp=STAMP)
    return env.select("page_id", "success", F.to_json(F.struct("success", "data", "error", "metadata")).alias("document"))


def scrape_learn(spark, sf):
    return scrape.scrape_learn(_pages(spark, sf), repository.empty(spark), catalog.LEARN_TASKS, STAMP)[1]


def learn_publish(spark, sf):
    """The learned and validated rule of each domain."""
    rules, _, _ = scrape.learn_and_publish(_pages(spark, sf), catalog.VALIDATION_TASK, STAMP)
    return rules.select("sequence_id", "domain", _r6(F.col("robustness_score")).alias("robustness_score"),
                        F.col("metadata")["source_rule"].alias("source_rule"))


def rule_store(spark, sf):
    """Published rules saved, some updated (two rows of an id: the
    last wins), some deleted, saved as the next version and read back."""
    path = shared_path(spark, "rules")
    repository.save(_published(spark, sf), path)
    now = repository.load(spark, path)
    some = now.filter(F.col("metadata")["source_rule"] == "r_h1")
    twice = some.withColumn("robustness_score", F.lit(0.1)).unionByName(some.withColumn("robustness_score", F.lit(0.25)))
    gone = now.filter(F.col("metadata")["source_rule"] == "r_ad").select("sequence_id")
    repository.save(repository.delete(repository.upsert(now, twice, F.to_timestamp(F.lit("2026-02-01T00:00:00"))), gone), path)
    return repository.load(spark, path).select("sequence_id", "domain", _r6(F.col("robustness_score")).alias("robustness_score"),
                                               (F.col("updated_at") > F.col("created_at")).alias("updated"))


def rule_commits(spark, sf):
    """A5: commits that touch some buckets only, on top of each other, and what
    each version holds of the rules of one source."""
    path = shared_path(spark, "rules")
    repository.save(_published(spark, sf), path)
    now = repository.load(spark, path)
    low = now.filter(F.col("metadata")["source_rule"] == "r_link_text").withColumn("robustness_score", F.lit(0.5))
    repository.apply(spark, path, upserts=low, now=F.to_timestamp(F.lit("2026-02-01T00:00:00")))
    repository.apply(spark, path, deletes=now.filter(F.col("metadata")["is_selected"] == "true"))
    out = None
    for v in repository.versions(spark, path):
        one = repository.load(spark, path, version=v).groupBy(F.col("metadata")["source_rule"].alias("source_rule")).agg(
            F.count("*").alias("n"), F.sum((F.col("robustness_score") == 0.5).cast("bigint")).alias("lowered")).withColumn("version", F.lit(v).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def stream_scrape(spark, sf):
    """The pages as a stream, scraped with the rules of a store."""
    from ..streaming import continuous

    path = shared_path(spark, "rules")
    repository.save(_published(spark, sf), path)
    out = continuous.run_stored(spark, f"{sf.rstrip('/')}/pages.parquet", path, catalog.VALIDATION_TASK)
    return out.select("page_id", "domain", "task", "success", "sequence_id", "data_count", "error", "rule_version")


def run_log(spark, sf):
    """A line for each scrape; its time is shown as whether there is one."""
    pages = _pages(spark, sf)
    started = scrape.clock(pages)
    res, _ = _scraped(spark, sf)
    log = scrape.run_log(res, started, catalog.VALIDATION_TASK)
    return log.select("page_id", "url", "task", "status", "items", (F.col("seconds") > 0).alias("timed"),
                      F.regexp_replace("line", r"Time: [0-9]+\.[0-9][0-9]s", "Time: ?").alias("line"))


def page_captures(spark, sf):
    """A1: the pages written as JSON lines and as HTML files, and read back."""
    pages = _pages(spark, sf)
    path = shared_path(spark, "captures")
    pages.select("page_id", "url", "html").write.json(f"{path}/lines")
    captures.write_files(pages, f"{path}/files")
    lines = captures.json_lines(spark, f"{path}/lines").withColumn("source", F.lit("lines"))
    files = captures.html_files(spark, f"{path}/files", "*.txt", page_id=r"page_id=([0-9]+)").withColumn("source", F.lit("files"))
    # a text file ends with a line feed of its own
    files = files.withColumn("html", F.regexp_replace("html", r"\n\z", "")).withColumn("url", F.lit(None).cast("string"))
    return lines.unionByName(files).select("source", "page_id", "url", F.md5("html").alias("html_md5"))


def rules_by_id(spark, sf):
    """I2 for every stored id: each is found once."""
    rules = _published(spark, sf)
    return rules.select("sequence_id").join(rules, "sequence_id").select("sequence_id", "domain", "extraction_task")


def rules_by_task(spark, sf):
    r = repository.fetch_by_task(_published(spark, sf), catalog.VALIDATION_TASK)
    return r.select("sequence_id", "domain", _r6(F.col("robustness_score")).alias("robustness_score"))


def result_files(spark, sf):
    """A4: result documents written as JSON and read back."""
    path = shared_path(spark, "results")
    res, vals = _scraped(spark, sf)
    env = scrape.envelope(res, vals, stamp=STAMP)
    scrape.write_results(env, path)
    back = spark.read.schema(env.schema).json(path)
    return back.select("page_id", "success", "error", "metadata.data_count", "metadata.domain",
                       F.coalesce(F.size("data"), F.lit(0)).cast("bigint").alias("n_items"))


def stream_extract(spark, sf):
    from ..streaming import continuous

    return continuous.run_available(spark, f"{sf.rstrip('/')}/pages.parquet", catalog.flat_steps(spark), enable_structuring=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "url_validate": url_validate,
    "url_metadata": url_metadata,
    "url_normalize": url_normalize,
    "domain_counts": domain_counts,
    "robots_urls": robots_urls,
    "page_links": page_links,
    "clean_html": clean_html,
    "page_text": page_text,
    "structure_info": structure_info,
    "basic_stats": basic_stats,
    "tag_distribution": tag_distribution,
    "class_top10": class_top10,
    "semantic_classes": semantic_classes,
    "price_patterns": price_patterns,
    "repeated_classes": repeated_classes,
    "content_patterns_pages": content_patterns_pages,
    "content_patterns_docs": content_patterns_docs,
    "dom_nodes": dom_nodes,
    "dom_tags": dom_tags,
    "dom_profile": dom_profile,
    "task_patterns": task_patterns,
    "dynamic_pages": dynamic_pages,
    "page_routes": page_routes,
    "extract_titles": extract_titles,
    "extract_links": extract_links,
    "single_rule": single_rule,
    "step_status": step_status,
    "sequence_results": sequence_results,
    "rule_probe": rule_probe,
    "extract_html": extract_html,
    "rule_programs": rule_programs,
    "action_dispatch": action_dispatch,
    "field_inference": field_inference,
    "field_inference_all": field_inference_all,
    "nav_filter": nav_filter,
    "structured_records": structured_records,
    "product_records": product_records,
    "text_lookup": text_lookup,
    "task_routing": task_routing,
    "rule_score": rule_score,
    "learn_rules": learn_rules,
    "learn_trace": learn_trace,
    "rule_suggestions": rule_suggestions,
    "advice": advice,
    "cross_validate": cross_validate,
    "rank_rules": rank_rules,
    "validation_summary": validation_summary,
    "publish_rules": publish_rules,
    "rules_top_by_domain": rules_top_by_domain,
    "rules_by_domain_task": rules_by_domain_task,
    "rules_stats": rules_stats,
    "rules_by_id": rules_by_id,
    "rules_by_task": rules_by_task,
    "rule_store": rule_store,
    "page_captures": page_captures,
    "run_log": run_log,
    "stream_scrape": stream_scrape,
    "rule_commits": rule_commits,
    "rules_list": rules_list,
    "scrape_known": scrape_known,
    "run_report": run_report,
    "scrape_envelope": scrape_envelope,
    "scrape_learn": scrape_learn,
    "learn_publish": learn_publish,
    "result_files": result_files,
    "stream_extract": stream_extract,
}
