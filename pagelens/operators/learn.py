"""Rule learning for a described task, by bounded refinement.

* G1 routes each (page, task) to a candidate rule by keywords (a CASE over
  the task text, or over the whole prompt text — task + tag names + the
  head of the cleaned page — with ``route_on='prompt'``).
* G2-G6 score what a rule extracts: algebraic aggregates per (page, task).
* G7/G8 repairs are functions from rule to rule.  Rules are a handful of
  rows of data; the repair of a rule is computed once per distinct
  (rule, repair kind, issue flags) combination — a set bounded by the rule
  catalogue and the iteration bound, never by the data.
* G9 runs at most ``max_iterations`` rounds.  Each round is one Spark pass
  over the still-active (page, task) rows: execute their current rules,
  score, accept / keep best / repair.  A round's rows are written once (to the
  buckets of their pages, see ``session.kept``); which repairs occur at all, a few
  words, is all that the driver learns of them, and their results join the rows as
  a transition table.
* The class/id repair needs a value of each page: its rule is a template, and the value
  (the class or id of the first element that the rule found there) stays with the
  page's row until it is bound (``select.bind_steps``).
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..session import kept, local_rows
from . import dom, execute
from . import select as S
from .select import Branch, Step

# ---------------------------------------------------------------------------
# Rule catalogue (first candidate of each routing branch; refine table)
# ---------------------------------------------------------------------------

NONBLANK = dict(nonblank=True)

CANDIDATES: dict[str, Step] = {
    "name_price": Step([Branch(
        tags=["div"], desc_text_any=["Rs.", "Balance"], output="desc_text", nonblank=True, min_len=4, max_len=200,
        value_none=["Add to cart", "Quick view"],
    )]),
    "price": Step([Branch(class_any=["price"], output="text")]),
    "quote": Step([Branch(tags=["div"], class_any=["quote"], output="desc_text", nonblank=True, min_len=10)]),
    "title": Step([Branch(tags=["h1"], output="text"), Branch(tags=["h2"], output="text"),
                   Branch(tags=["h3"], output="text")]),
    "link": Step([Branch(tags=["a"], output="attr", out_attr="href")]),
    "item": Step([Branch(class_any=["product", "item", "card", "shoe"], output="desc_text", nonblank=True,
                         min_len=3, max_len=200)]),
    "generic": Step([Branch(has_text=True, output="text", nonblank=True, min_len=5)]),
}

REFINE: dict[str, Step] = {
    "no_data": Step([Branch(tags=["div"], output="desc_text", nonblank=True, min_len=3)]),
    "too_many": Step([Branch(first_text_nonblank=True, elem_min_len=10, output="text")],
                     post=[S.op("position_max", 10)]),
    "single": Step([Branch(class_any=["item", "product", "card"], output="desc_text", nonblank=True)]),
    "very_short": Step([Branch(first_text_min_len=10, output="text")]),
    "content": Step([Branch(class_any=["content", "text", "description"], output="desc_text", nonblank=True)]),
}


def route(hay: Column) -> Column:
    """G1 branch for a lower-cased haystack, first match wins."""
    names, prices = fixed.ROUTE_NAME_PRICE
    out = F.when(T.contains_any(hay, names) & T.contains_any(hay, prices), F.lit("name_price"))
    for name, words in fixed.ROUTES:
        out = out.when(T.contains_any(hay, words), F.lit(name))
    return out.otherwise(F.lit(fixed.ROUTE_GENERIC))


def prompt_haystack(pages_clean: DataFrame, task_col: str = "task", sample_chars: int = fixed.PROMPT_SAMPLE_CHARS,
                    sample_tags: int = fixed.PROMPT_SAMPLE_TAGS) -> DataFrame:
    """Adds ``hay``: lower(task, first distinct tag names sorted, head of the
    cleaned page) — what the keyword router reads in prompt mode (the fixed
    prompt wording contains none of its keywords)."""
    from . import profile

    tags = profile.tag_tokens(pages_clean).groupBy("page_id").agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("tag")), 1, sample_tags), ", ").alias("tag_list")
    )
    j = pages_clean.join(tags, "page_id", "left")
    hay = F.lower(F.concat_ws(" ", F.col(task_col), F.coalesce(F.col("tag_list"), F.lit("")),
                              F.substring(F.col("html_clean"), 1, sample_chars)))
    return j.withColumn("hay", hay)


# ---------------------------------------------------------------------------
# Scoring (G2-G6)
# ---------------------------------------------------------------------------


def weak_task(task: Column) -> Column:
    """G3 task side: the task implies several items."""
    t = F.lower(task)
    plural_word = F.exists(
        F.split(F.trim(t), r"[ \t\n\r\f]+"),
        lambda w: (F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~w.isin(*fixed.PLURAL_EXCEPTIONS),
    )
    return T.contains_any(t, fixed.MULTI_ITEM_WORDS) | T.contains_any(t, fixed.PLURAL_PHRASES) | plural_word


def task_match(value: Column, task: Column) -> Column:
    """G4 per-value check by task kind."""
    t = F.lower(task)
    return (
        F.when(T.contains_any(t, fixed.TASK_PRICE_WORDS), F.regexp_like(value, F.lit(fixed.TASK_PRICE_RE)))
        .when(F.contains(t, F.lit("email")), F.regexp_like(value, F.lit(T.ascii_word_boundary(fixed.EMAIL_RE))))
        .when(T.contains_any(t, fixed.TASK_URL_WORDS), F.regexp_like(value, F.lit(fixed.TASK_URL_RE)))
        .otherwise(F.length(S.strip_ws(value)) > 3)
    )


def score(values: DataFrame, keys: list[str], task_col: str = "task") -> DataFrame:
    """G2-G6 per key group; ``values`` has keys + task + value, each value of a
    group once (extraction drops repeats, so there are no duplicate results).

    Returns keys + n, confidence, success, is_weak, has_meaningful,
    task_score, consistency, n_empty, n_short, n_long, n_dupes."""
    strip_len = F.length(S.strip_ws(F.col("value")))
    agg = values.groupBy(*keys).agg(
        F.first(task_col).alias("_task"),
        F.count("*").alias("n"),
        F.max((strip_len > 2).cast("int")).alias("_meaningful"),
        F.avg(task_match(F.col("value"), F.col(task_col)).cast("double")).alias("task_score"),
        F.max(F.length("value")).alias("_maxlen"),
        F.min(F.length("value")).alias("_minlen"),
        F.count_distinct(T.char_pattern_v1(F.col("value"))).alias("_patterns"),
        F.sum((strip_len == 0).cast("int")).alias("n_empty"),
        F.sum((strip_len < 3).cast("int")).alias("n_short"),
        F.sum((F.length("value") > 200).cast("int")).alias("n_long"),
    )
    weak = (F.col("n") == 1) & weak_task(F.col("_task"))
    q = F.when(weak, 0.6).when((F.col("n") >= 2) & (F.col("n") <= 20), 0.9).otherwise(0.7)
    c = F.when(F.col("_meaningful") == 1, 0.9).otherwise(0.3)
    k = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(
        (F.greatest(F.lit(0.0), 1.0 - (F.col("_maxlen") - F.col("_minlen")) / 100.0) + 1.0 / F.col("_patterns")) / 2.0
    )
    conf = (q + c + F.col("task_score") + k) / 4.0
    out = agg.select(
        *keys, F.col("n").cast("bigint").alias("n"), weak.alias("is_weak"),
        (F.col("_meaningful") == 1).alias("has_meaningful"), "task_score", k.alias("consistency"), conf.alias("confidence"),
        "n_empty", "n_short", "n_long", F.lit(0).cast("bigint").alias("n_dupes"),
    )
    success = F.col("has_meaningful") & (F.col("confidence") >= F.when(F.col("is_weak"), 0.6).otherwise(0.5))
    return out.withColumn("success", success)


def with_empty_scores(grid: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no values: n 0, confidence 0, not a success."""
    j = grid.join(scored, keys, "left")
    return j.select(
        *grid.columns,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("is_weak", F.lit(False)).alias("is_weak"),
        F.coalesce("has_meaningful", F.lit(False)).alias("has_meaningful"),
        F.coalesce("task_score", F.lit(0.0)).alias("task_score"),
        F.coalesce("consistency", F.lit(0.0)).alias("consistency"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("n_empty", F.lit(0)).alias("n_empty"), F.coalesce("n_short", F.lit(0)).alias("n_short"),
        F.coalesce("n_long", F.lit(0)).alias("n_long"), F.coalesce("n_dupes", F.lit(0)).alias("n_dupes"),
    )


def issues(col_prefix: str = "") -> Column:
    """G6 issue list (plus the weak-single message)."""
    n = F.col("n")
    lst = F.array(
        F.when(n == 0, F.lit(fixed.ISSUE_NO_DATA)),
        F.when((n > 0) & (F.col("n_empty") > 0), F.format_string("%d empty results", F.col("n_empty"))),
        F.when((n > 0) & (F.col("n_short") > n * 0.5), F.lit(fixed.ISSUE_SHORT)),
        F.when((n > 0) & (F.col("n_long") > 0), F.format_string("%d results are very long", F.col("n_long"))),
        F.when((n > 0) & (F.col("n_dupes") > 0), F.format_string("%d duplicate results", F.col("n_dupes"))),
        F.when(F.col("is_weak") & ~F.col("success"), F.lit(fixed.ISSUE_WEAK)),
    )
    return F.filter(lst, lambda x: x.isNotNull())


# ---------------------------------------------------------------------------
# Repairs (G7/G8) — rule -> rule, on rule rows (driver side, tiny)
# ---------------------------------------------------------------------------


def _ends_with_text(st: Step) -> bool:
    if st.post:
        return st.post[-1]["op"] == "child_text"
    b = st.branches[-1]
    plain = not (b.nonblank or b.min_len is not None or b.max_len is not None or b.value_none or b.value_any)
    return b.output == "text" and plain


def repair_parent(st: Step) -> Step:
    st = copy.deepcopy(st)
    if not st.post and _ends_with_text(st):
        st.branches[-1].output = "self"
    st.post.append(S.op("parent"))
    st.xpath = None
    return st


def repair_specific(st: Step) -> Step:
    st = copy.deepcopy(st)
    disp = st.display()
    if "[" not in disp:
        st.post.append(S.op("position_max", 10))
    elif "text()" in disp:
        for b in st.branches:
            if b.output in ("text", "desc_text"):
                b.min_len = max(b.min_len if b.min_len is not None else 2, 2)
                b.max_len = min(b.max_len if b.max_len is not None else 100, 100)
        if any(o["op"] in ("child_text", "desc_text") for o in st.post):
            st.post += [S.op("len_gt", 2), S.op("len_lt", 100)]
    st.xpath = None
    return st


def binds(st: Step) -> bool:
    """Whether the specificity repair takes a class or id from the page: the path
    has conditions but no text, and finds elements.  A rule binds once."""
    shown = st.display()
    elements = st.post[-1]["op"] in ("parent", "next_sibling") if st.post else all(b.output == "self" for b in st.branches)
    return "[" in shown and "text()" not in shown and elements


def repair_bound(st: Step) -> Step:
    st = copy.deepcopy(st)
    st.post.append(S.op("bound"))
    st.xpath = None
    return st


def bindings(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(page_id, sequence_id, bind): ``class=`` and the first class, or ``id=`` and
    the id, of the first element that each rule found on each page; null if it has neither."""
    first = sets.groupBy("page_id", "sequence_id").agg(F.min_by("kind", "node").alias("kind"), F.min("node").alias("pre"))
    e = dom.elements(nodes).select("page_id", "pre", "cls", "elem_id")
    words = F.filter(F.split("cls", r"\s+"), lambda w: w != "")
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    bind = F.when(some("cls"), F.concat(F.lit("class="), F.get(words, F.lit(0)))).when(some("elem_id"), F.concat(F.lit("id="), F.col("elem_id")))
    return first.filter("kind = 'elem'").join(e, ["page_id", "pre"]).select("page_id", "sequence_id", bind.alias("bind"))


def repair_alternative(st: Step) -> Step:
    st = copy.deepcopy(st)
    if not _ends_with_text(st):
        if not st.post and st.branches[-1].output == "self":
            st.branches[-1].output = "text"
        else:
            st.post.append(S.op("child_text"))
    else:
        for b in st.branches:
            if b.output == "text":
                b.output = "self"
        st.post += [S.op("next_sibling"), S.op("child_text")]
    st.xpath = None
    return st


def repair_fine(st: Step, empty: bool, short: bool, long_: bool) -> Step:
    """A condition on every text result of the rule, whether its own text or
    any text below; conditions add up."""
    shown = st.display()
    if "/text()" not in shown or not (empty or short or long_):
        return st
    st = copy.deepcopy(st)
    if empty:
        cond, post = "normalize-space()", S.op("nonblank")
    elif short:
        cond, post = "string-length(.) > 5", S.op("len_gt", 5)
    else:
        cond, post = "string-length(.) < 100", S.op("len_lt", 100)
    for b in st.branches:
        if b.output in ("text", "desc_text"):
            if empty:
                b.nonblank = True
            elif short:
                b.min_len = max(b.min_len or 0, 5)
            else:
                b.max_len = min(b.max_len or 100, 100)
    st.post = [x for o in st.post for x in ([o, post] if o["op"] in ("child_text", "desc_text") else [o])]
    # A condition that was there already still makes another rule text.
    st.xpath = shown.replace("/text()", f"/text()[{cond}]")
    return st


def refine_key(no_data: bool, too_many: bool, single: bool, very_short: bool) -> str:
    if no_data:
        return "no_data"
    if too_many:
        return "too_many"
    if single:
        return "single"
    if very_short:
        return "very_short"
    return "content"


# ---------------------------------------------------------------------------
# G9 / G10
# ---------------------------------------------------------------------------


class RuleBook:
    """Registry of rule variants met during learning (id -> Step)."""

    def __init__(self):
        self.rules: dict[str, Step] = {}
        for k, v in CANDIDATES.items():
            self.rules[f"cand:{k}"] = v
        for k, v in REFINE.items():
            self.rules[f"refine:{k}"] = v

    def add(self, rid: str, st: Step) -> str:
        # identical rules share one id
        disp = st.display()
        for k, v in self.rules.items():
            if v.display() == disp:
                return k
        self.rules[rid] = st
        return rid

    def frame(self, spark, ids) -> DataFrame:
        return S.steps_frame(spark, {i: [self.rules[i]] for i in ids})


def learn(pages: DataFrame, tasks: list[str], max_iterations: int = fixed.MAX_ITERATIONS,
          min_confidence: float = fixed.MIN_CONFIDENCE, route_on: str = "task",
          nodes: DataFrame | None = None, pairs: DataFrame | None = None):
    """G10 over pages × tasks, or over the (page_id, task) rows of ``pairs``.
    Returns (learned, trace, rulebook).

    learned: (page_id, task, success, rule_id, xpath, confidence, data_count,
              total_iterations)
    trace:   (page_id, task, iteration, rule_id, xpath, success, confidence,
              data_count, action)
    """
    from . import profile

    spark = pages.sparkSession
    pc = profile.with_clean(pages)
    if nodes is None:
        nodes = dom.dom_nodes(pc.select("page_id", F.col("html_clean").alias("html")))
    pt = pc.select("page_id", "html_clean", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    if pairs is not None:
        pt = pt.join(pairs, ["page_id", "task"], "left_semi")
    if route_on == "prompt":
        pt = prompt_haystack(pt)
    else:
        pt = pt.withColumn("hay", F.lower("task"))
    state = kept(pt.select(
        "page_id", "task", F.concat(F.lit("cand:"), route(F.col("hay"))).alias("rule_id"), F.lit(None).cast("string").alias("bound"),
        F.lit(-1.0).alias("best_conf"), F.lit(None).cast("string").alias("best_rule"), F.lit(None).cast("string").alias("best_bound"),
        F.lit(0).cast("bigint").alias("best_n"),
    ))
    book = RuleBook()
    ids = [f"cand:{k}" for k in CANDIDATES]
    traces, finished = [], []
    flags = {"f_no_data": fixed.ISSUE_NO_DATA.lower(), "f_too_many": "too many results", "f_single": "single element", "f_short": "very short",
             "f_empty": "empty results", "f_long": "very long"}
    keys = ["rule_id", "kind", "binds", *flags]
    for it in range(max_iterations):
        steps = book.frame(spark, ids)
        if any(o["op"] == "bound" for i in ids for o in book.rules[i].post):
            steps = S.bind_steps(steps, state.select(F.col("rule_id").alias("sequence_id"), "bound"))
        state = state.withColumn("sequence_id", S.bound_id(F.col("rule_id"), F.col("bound")))
        pairs = state.select("page_id", "sequence_id").distinct()
        # the values and the bindings both start from them
        sets = kept(S.select_nodes(nodes, steps, pairs))
        vals = S.node_values(nodes, None, steps, sets, normalize_whitespace=False, max_results=1 << 30, keep_empty_text=True)
        first = vals.groupBy("page_id", "sequence_id", "value").agg(F.min("ord").alias("ord"))
        own = ["page_id", "task", "sequence_id"]
        scored = with_empty_scores(state.select(*own), score(first.join(state.select(*own), ["page_id", "sequence_id"]), own), own)
        st = state.join(scored.drop("sequence_id"), ["page_id", "task"])
        open_to = [i for i in ids if binds(book.rules[i])]
        if open_to:
            st = st.join(bindings(nodes, sets.filter(F.col("sequence_id").isin(open_to))), ["page_id", "sequence_id"], "left")
        else:
            st = st.withColumn("bind", F.lit(None).cast("string"))
        kind = (
            F.when(F.col("n") == 0, F.lit("parent"))
            .when(F.col("n") > 20, F.lit("specific"))
            .when(F.col("confidence") < 0.4, F.lit("alternative"))
            .otherwise(F.lit("fine"))
        )
        st = st.withColumn("issues", issues()).select(
            "*", kind.alias("kind"), F.col("bind").isNotNull().alias("binds"),
            *[_says(words).alias(f) for f, words in flags.items()],
            (F.col("success") & (F.col("confidence") >= min_confidence)).alias("accept"),
            (F.col("confidence") > F.col("best_conf")).alias("better"),
            ((F.col("confidence") < 0.4) | (F.col("is_weak") & (F.col("confidence") < 0.7))).alias("needs_repair"))
        st = kept(st)
        traces.append(st.select("page_id", "task", F.lit(it + 1).alias("iteration"), "rule_id", "bound", "success",
                                "confidence", F.col("n").alias("data_count"),
                                F.when(F.col("accept"), F.lit("accepted"))
                                .when(F.col("needs_repair"), F.col("kind"))
                                .otherwise(F.lit("kept")).alias("action")))
        last_round = it == max_iterations - 1
        # repairs that occur: one row per distinct (rule, kind, flags), bounded by the rule book
        combos = [] if last_round else st.filter(~F.col("accept") & F.col("needs_repair")).select(*keys).distinct().collect()
        rep_rows = [(*[c[k] for k in keys], _next_rule(book, c)) for c in combos]
        kinds = ", ".join(f"{k} {'string' if k in ('rule_id', 'kind') else 'boolean'}" for k in keys)
        rep = local_rows(spark, rep_rows, f"{kinds}, next_rule string")
        st = st.join(F.broadcast(rep), keys, "left")
        best = F.col("accept") | F.col("better")
        new = st.select(
            "page_id", "task",
            F.when(F.col("needs_repair"), F.col("next_rule")).alias("rule_id"),
            F.when(F.col("next_rule").startswith("bound("), F.coalesce("bound", "bind"))
            .when(~F.col("next_rule").startswith("refine:"), F.col("bound")).alias("bound"),
            F.when(best, F.col("confidence")).otherwise(F.col("best_conf")).alias("best_conf"),
            F.when(best, F.col("rule_id")).otherwise(F.col("best_rule")).alias("best_rule"),
            F.when(best, F.col("bound")).otherwise(F.col("best_bound")).alias("best_bound"),
            F.when(best, F.col("n")).otherwise(F.col("best_n")).alias("best_n"),
            F.col("accept").alias("accepted"), F.lit(it + 1).alias("iterations"))
        over = F.col("accepted") | F.col("rule_id").isNull()
        finished.append(new.filter(over))
        state = new.filter(~over).drop("accepted", "iterations")
        ids = sorted({r[-1] for r in rep_rows if r[-1]})
        if not ids:
            break
    state = finished[0]
    for f in finished[1:]:
        state = state.unionByName(f)
    # final results
    disp = local_rows(spark, [(k, v.display()) for k, v in book.rules.items()], "rule_id string, xpath string")
    ok = F.col("accepted") | (F.col("best_conf") >= fixed.ACCEPT_BEST_MIN)
    learned = _shown(state.select(
        "page_id", "task", ok.alias("success"),
        F.when(ok, F.col("best_rule")).alias("rule_id"), F.when(ok, F.col("best_bound")).alias("bound"),
        F.when(ok, F.col("best_conf")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.col("best_n")).otherwise(F.lit(0)).cast("bigint").alias("data_count"),
        F.col("iterations").cast("bigint").alias("total_iterations"),
    ), disp)
    trace = traces[0]
    for t in traces[1:]:
        trace = trace.unionByName(t)
    return learned, _shown(trace, disp), book


def _says(words: str) -> Column:
    """Whether an issue has these words."""
    return F.exists("issues", lambda x: F.contains(F.lower(x), F.lit(words)))


def _shown(rows: DataFrame, disp: DataFrame) -> DataFrame:
    """With each rule's path, bound values in their place."""
    value = F.concat(F.lit("[@"), F.replace("bound", F.lit("="), F.lit("='")), F.lit("']"))
    return rows.join(F.broadcast(disp), "rule_id", "left").withColumn(
        "xpath", F.when(F.col("bound").isNull(), F.col("xpath")).otherwise(F.replace("xpath", F.lit(S.BOUND), value)))


def _next_rule(book: RuleBook, c) -> str | None:
    """The rule that a repair leads to, None if there is nothing left to try."""
    cur = book.rules[c["rule_id"]]
    if c["kind"] == "parent":
        nxt = repair_parent(cur)
    elif c["kind"] == "specific" and c["binds"] and not any(o["op"] == "bound" for o in cur.post):
        return book.add(f"bound({c['rule_id']})", repair_bound(cur))
    elif c["kind"] == "specific":
        nxt = repair_specific(cur)
    elif c["kind"] == "alternative":
        nxt = repair_alternative(cur)
    else:
        nxt = repair_fine(cur, c["f_empty"], c["f_short"], c["f_long"])
    if nxt.display() != cur.display():
        return book.add(f"{c['kind']}({c['rule_id']})", nxt)
    nid = "refine:" + refine_key(c["f_no_data"], c["f_too_many"], c["f_single"], c["f_short"])
    return None if book.rules[nid].display() == cur.display() else nid
