"""Rules (held as data) selecting nodes from ``dom_nodes``.

A rule step is a union of *branches* plus ordered *post ops* on the union.
A branch is: element test (tag list, OR-ed contains tests on class / first
text / first descendant text / href, AND-ed exact class / id / text
conditions) and an output (the element, an attribute, its text children, or
its descendant texts) with value filters on text outputs.  That covers
every path the rule learner and the rule catalogue produce, so matching is a
broadcast hash join of the (small, size-checked) branch table against the
element rows on a tag key — no XPath text is evaluated anywhere.

Two ways to match:

* every rule on every page: the branch table (size-checked, broadcast) meets
  the elements on the tag;
* ``pairs`` (page_id, sequence_id), when each page has its own rules: the
  pairs fetch their branches first, and these meet the elements on
  (page_id, tag), so a page never sees another page's rules.  A step table with
  a ``page_id`` column has rules of one page each, which meet only that page's rows.

Output axes are equi-joins on the node table, which is hash-partitioned by
``page_id``: child text (``parent = pre``), descendant text (the element's
range of text ordinals), parent, next sibling.  Node-set semantics: each node
once per (page, rule, step), document order = ``pre``.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..session import BROADCAST_MAX_ROWS, local_rows
from . import dom

OP_DDL = "struct<op:string,n:int,s:string>"
BRANCH_DDL = (
    "struct<tags:array<string>,class_any:array<string>,text_any:array<string>,"
    "desc_text_any:array<string>,href_any:array<string>,class_eq:string,id_eq:string,"
    "has_text:boolean,first_text_nonblank:boolean,first_text_min_len:int,elem_min_len:int,"
    "output:string,out_attr:string,nonblank:boolean,min_len:int,max_len:int,"
    "value_none:array<string>,value_any:array<string>,value_any_min_len:int>"
)
STEP_DDL = (
    "sequence_id string, step_index int, action_type string, attribute string, xpath string, "
    f"branches array<{BRANCH_DDL}>, post array<{OP_DDL}>"
)

XML_WS = r"[ \t\n\r]"


# ---------------------------------------------------------------------------
# Building rules (driver side: rules are a handful of rows of data)
# ---------------------------------------------------------------------------


@dataclass
class Branch:
    tags: list[str] = field(default_factory=list)  # empty = any element
    class_any: list[str] = field(default_factory=list)
    text_any: list[str] = field(default_factory=list)
    desc_text_any: list[str] = field(default_factory=list)
    href_any: list[str] = field(default_factory=list)
    class_eq: str | None = None
    id_eq: str | None = None
    has_text: bool = False
    first_text_nonblank: bool = False
    first_text_min_len: int | None = None  # string-length(normalize-space(text())) > n
    elem_min_len: int | None = None  # string-length(.) > n on the element
    output: str = "self"  # self | attr | text | desc_text
    out_attr: str | None = None
    nonblank: bool = False
    min_len: int | None = None  # string-length(.) > n  (text outputs)
    max_len: int | None = None  # string-length(.) < n
    value_none: list[str] = field(default_factory=list)
    value_any: list[str] = field(default_factory=list)  # contains(., s) or ...
    value_any_min_len: int | None = None  # ... or string-length(.) > n

    def row(self) -> dict:
        return dict(self.__dict__)

    def xpath(self) -> str:
        """Display form (what the rule means, in path syntax)."""
        tag = "*" if not self.tags else self.tags[0]
        ors = [f'contains(@class, "{c}")' for c in self.class_any]
        ors += [f'contains(text(), "{c}")' for c in self.text_any]
        ors += [f'contains(.//text(), "{c}")' for c in self.desc_text_any]
        ors += [f'contains(@href, "{c}")' for c in self.href_any]
        preds = []
        if ors:
            preds.append(" or ".join(ors))
        if self.class_eq is not None:
            preds.append(f'@class="{self.class_eq}"')
        if self.id_eq is not None:
            preds.append(f'@id="{self.id_eq}"')
        if self.has_text:
            preds.append("text()")
        if self.first_text_nonblank:
            preds.append("normalize-space(text())")
        if self.first_text_min_len is not None:
            preds.append(f"string-length(normalize-space(text())) > {self.first_text_min_len}")
        if self.elem_min_len is not None:
            preds.append(f"string-length(.) > {self.elem_min_len}")
        out = f"//{tag}" + "".join(f"[{p}]" for p in ([" and ".join(preds)] if preds else []))
        vf = []
        if self.nonblank:
            vf.append("normalize-space()")
        if self.min_len is not None:
            vf.append(f"string-length(.) > {self.min_len}")
        if self.max_len is not None:
            vf.append(f"string-length(.) < {self.max_len}")
        for s in self.value_none:
            vf.append(f'not(contains(., "{s}"))')
        if self.value_any or self.value_any_min_len is not None:
            alts = [f'contains(., "{s}")' for s in self.value_any]
            if self.value_any_min_len is not None:
                alts.append(f"string-length(.) > {self.value_any_min_len}")
            vf.append("(" + " or ".join(alts) + ")")
        vfs = f"[{' and '.join(vf)}]" if vf else ""
        if self.output == "text":
            out += "/text()" + vfs
        elif self.output == "desc_text":
            out += "//text()" + vfs
        elif self.output == "attr":
            out += f"/@{self.out_attr}"
        if len(self.tags) > 1:
            return " | ".join(out.replace(f"//{tag}", f"//{t}", 1) for t in self.tags)
        return out


#: Shown for a condition on class or id whose value a page gives.
BOUND = "[@?]"


def shown_bound(value: str) -> str:
    """``class=x`` as a path shows it."""
    name, _, x = value.partition("=")
    return f"[@{name}='{x}']"


def bind_steps(steps: DataFrame, bound: DataFrame) -> DataFrame:
    """Rules from templates: for each row of ``bound`` (sequence_id, bound) the
    template's steps with the value in its ``bound`` ops, under
    :func:`bound_id`; templates without a row of their own stay as they are."""
    filled = F.transform("post", lambda o: F.when(o["op"] == "bound", F.struct(o["op"].alias("op"), o["n"].alias("n"), F.col("bound").alias("s"))).otherwise(o))
    value = F.concat(F.lit("[@"), F.replace("bound", F.lit("="), F.lit("='")), F.lit("']"))
    own = steps.join(bound.filter("bound IS NOT NULL").distinct(), "sequence_id").select(
        bound_id(F.col("sequence_id"), F.col("bound")).alias("sequence_id"), "step_index", "action_type", "attribute",
        F.replace("xpath", F.lit(BOUND), value).alias("xpath"), "branches", filled.alias("post"))
    return steps.unionByName(own)


def bound_id(rule: Column, bound: Column) -> Column:
    return F.concat_ws("@", rule, bound)


def op(name: str, n: int | None = None, s: str | None = None) -> dict:
    return {"op": name, "n": n, "s": s}


@dataclass
class Step:
    branches: list[Branch]
    action_type: str = fixed.ACTION_TEXT
    attribute: str | None = None
    post: list[dict] = field(default_factory=list)
    xpath: str | None = None

    def display(self) -> str:
        if self.xpath is not None:
            return self.xpath
        s = " | ".join(b.xpath() for b in self.branches)
        for o in self.post:
            if o["op"] == "parent":
                s = f"({s})/.."
            elif o["op"] == "position_max":
                s = f"({s})[position() <= {o['n']}]"
            elif o["op"] == "child_text":
                s = f"{s}/text()"
            elif o["op"] == "desc_text":
                s = f"{s}//text()[normalize-space()]"
            elif o["op"] == "next_sibling":
                s = f"{s}/following-sibling::*[1]"
            elif o["op"] == "bound":
                s = f"{s}{BOUND if o['s'] is None else shown_bound(o['s'])}"
        return s


# Facts about a rule table that shape the plan: which output kinds, actions
# and post-ops occur and how many rows there are.  The facts are a few words
# and counts however many rules there are; they are known from the Python rules
# when the table was built here, else one small aggregation finds them.
_META: "weakref.WeakKeyDictionary[DataFrame, dict]" = weakref.WeakKeyDictionary()


def _meta_of_rows(rows: list[tuple]) -> dict:
    outputs, posts, html, desc, n_branch_rows, tags = set(), [], False, False, 0, set()
    for action, branches, ops in rows:
        html = html or action == fixed.ACTION_HTML
        for b in branches:
            outputs.add(b["output"])
            desc = desc or bool(b["desc_text_any"])
            n_branch_rows += max(len(b["tags"]), 1)
            tags.update(b["tags"] or ["*"])
        for k, o in enumerate(ops):
            while len(posts) <= k:
                posts.append(set())
            posts[k].add(o)
    return {"outputs": outputs, "posts": posts, "html": html, "desc": desc, "n_steps": len(rows), "n_branch_rows": n_branch_rows, "tags": _few_tags(tags)}


#: Tags that a scan of the node table is told to look for; with more it reads every element.
SCAN_TAGS = 64


def _few_tags(tags) -> list[str] | None:
    """The tags that rules name, None if a rule takes any tag or there are many."""
    return None if "*" in tags or len(tags) > SCAN_TAGS else sorted(tags)


def rule_meta(steps: DataFrame) -> dict:
    m = _META.get(steps)
    if m is None:
        ops = F.transform("post", lambda o, i: F.struct(i.alias("k"), o["op"].alias("op")))
        one = steps.agg(
            F.array_distinct(F.flatten(F.collect_set("branches.output"))).alias("outputs"),
            F.array_distinct(F.flatten(F.collect_set(ops))).alias("posts"),
            F.bool_or(F.col("action_type") == fixed.ACTION_HTML).alias("html"),
            F.bool_or(F.exists("branches", lambda b: F.size(b["desc_text_any"]) > 0)).alias("desc"),
            F.count("*").alias("n_steps"),
            F.slice(F.array_distinct(F.flatten(F.collect_set(F.flatten(F.transform(
                "branches", lambda b: F.when(F.size(b["tags"]) > 0, b["tags"]).otherwise(F.array(F.lit("*")))))))), 1, SCAN_TAGS + 1).alias("tags"),
            F.sum(F.aggregate("branches", F.lit(0), lambda n, b: n + F.greatest(F.size(b["tags"]), F.lit(1)))).alias("n_rows"),
        ).first()
        posts: list[set] = []
        for o in one.posts:
            while len(posts) <= o.k:
                posts.append(set())
            posts[o.k].add(o.op)
        m = {"outputs": {x for x in one.outputs if x}, "posts": posts, "html": bool(one.html), "desc": bool(one.desc),
             "n_steps": one.n_steps, "n_branch_rows": one.n_rows or 0, "tags": _few_tags({t for t in one.tags if t is not None})}
        _META[steps] = m
    return m


def small(rules: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast rule rows only when they are known to be few; beyond that the
    planner's shuffled join (with skew splitting) is used."""
    return F.broadcast(rules) if n_rows <= BROADCAST_MAX_ROWS else rules


def keys_of(steps: DataFrame, keys: list[str]) -> list[str]:
    """On what rule rows meet results.  Where each rule belongs to one page (a step
    table with ``page_id``) also the page, so that rules lie with its nodes."""
    return ["page_id", *keys] if "page_id" in steps.columns else keys


def rule_rows(steps: DataFrame, rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of ``steps`` as they meet results: with their page's, else see :func:`small`."""
    return rows if "page_id" in steps.columns else small(rows, n_rows)


def steps_frame(spark: SparkSession, rules: dict[str, list[Step]]) -> DataFrame:
    """{sequence_id: [Step, ...]} -> rule step table."""
    rows = []
    for sid, steps in rules.items():
        for i, st in enumerate(steps):
            rows.append((
                sid, i, st.action_type, st.attribute, st.display() if st.branches else (st.xpath or ""),
                [b.row() for b in st.branches], list(st.post),
            ))
    df = local_rows(spark, rows, STEP_DDL)
    _META[df] = _meta_of_rows([(r[2], r[5], [o["op"] for o in r[6]]) for r in rows])
    return df


def with_action(steps: DataFrame, action: str) -> DataFrame:
    """The same rules with every action replaced (metadata carried over)."""
    out = steps.withColumn("action_type", F.lit(action))
    m = _META.get(steps)
    if m is not None:
        _META[out] = dict(m, html=action == fixed.ACTION_HTML)
    return out


# ---------------------------------------------------------------------------
# Matching
# ---------------------------------------------------------------------------


def _any_contains(needles: Column, hay: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(F.coalesce(hay, F.lit("")), n))


def _norm_len(s: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), XML_WS + "+", " ")))


def element_predicate(b: str = "b") -> Column:
    """Branch element test over node columns (b = branch struct column)."""
    br = F.col(b)
    no_or = (
        (F.size(br.class_any) == 0) & (F.size(br.text_any) == 0)
        & (F.size(br.desc_text_any) == 0) & (F.size(br.href_any) == 0)
    )
    ors = (
        _any_contains(br.class_any, F.col("cls"))
        | _any_contains(br.text_any, F.col("first_text"))
        | _any_contains(br.desc_text_any, F.col("first_desc_text"))
        | _any_contains(br.href_any, F.col("href"))
    )
    return (
        (no_or | ors)
        & (br.class_eq.isNull() | (F.col("cls") == br.class_eq))
        & (br.id_eq.isNull() | (F.col("elem_id") == br.id_eq))
        & (~F.coalesce(br.has_text, F.lit(False)) | (F.col("n_text") > 0))
        & (~F.coalesce(br.first_text_nonblank, F.lit(False)) | (_norm_len(F.col("first_text")) > 0))
        & (br.first_text_min_len.isNull() | (_norm_len(F.col("first_text")) > br.first_text_min_len))
        & (br.elem_min_len.isNull() | (F.col("text_len") > br.elem_min_len))
    )


def value_predicate(v: Column, b: str = "b") -> Column:
    br = F.col(b)
    anyv = F.exists(br.value_any, lambda s: F.contains(v, s)) | (
        br.value_any_min_len.isNotNull() & (F.length(v) > br.value_any_min_len)
    )
    return (
        (~F.coalesce(br.nonblank, F.lit(False)) | (_norm_len(v) > 0))
        & (br.min_len.isNull() | (F.length(v) > br.min_len))
        & (br.max_len.isNull() | (F.length(v) < br.max_len))
        & ~F.exists(br.value_none, lambda s: F.contains(v, s))
        & (((F.size(br.value_any) == 0) & br.value_any_min_len.isNull()) | anyv)
    )


KEY = ["sequence_id", "step_index"]


def _branches(steps: DataFrame) -> DataFrame:
    """One row per (step, branch, tag key)."""
    b = steps.select(*keys_of(steps, KEY), F.posexplode("branches").alias("branch_idx", "b"))
    return b.withColumn(
        "tkey", F.explode(F.when(F.size("b.tags") == 0, F.array(F.lit("*"))).otherwise(F.col("b.tags")))
    )


def select_nodes(nodes: DataFrame, steps: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Node sets: (page_id, sequence_id, step_index, node, attr, kind).

    ``node`` is a node number; ``attr`` is set for attribute results.
    ``element_count`` of a step is the size of this set.
    """
    meta = rule_meta(steps)
    # Where every branch names its tags, no other element (nor its texts) is read.
    of_tags = (lambda df, tag: df) if meta["tags"] is None else (lambda df, tag: df.filter(F.col(tag).isin(*meta["tags"])))
    attrs = F.col("attrs") if "attr" in meta["outputs"] else F.lit(None).cast("map<string,string>")
    elems = of_tags(dom.elements(nodes), "tag").select(
        "page_id", "pre", "tag", "cls", "elem_id", "href", "first_text", "n_text", "text_len", "t_from", "t_count", attrs.alias("attrs"))
    elems = dom.first_descendant_text(nodes, elems) if meta["desc"] else elems.withColumn("first_desc_text", F.lit(None).cast("string"))
    br = _branches(steps)
    named, star = F.col("tkey") != "*", F.col("tkey") == "*"
    if pairs is None:
        if meta["n_branch_rows"] > BROADCAST_MAX_ROWS:
            raise ValueError(f"more than {BROADCAST_MAX_ROWS} rule branches for every page: give the pairs of pages and rules")
        keyed = elems.withColumn("tkey", F.explode(F.array(F.col("tag"), F.lit("*"))))
        m = keyed.join(F.broadcast(br), "tkey")
    else:  # the rules of a page first, then the elements they name
        own = pairs.select("page_id", "sequence_id").distinct().join(
            rule_rows(steps, br, meta["n_branch_rows"]), keys_of(steps, ["sequence_id"]))
        m = elems.join(own.filter(named).withColumnRenamed("tkey", "tag"), ["page_id", "tag"])
        m = m.unionByName(elems.join(own.filter(star).drop("tkey"), "page_id"))
    m = m.filter(element_predicate("b")).select("page_id", *KEY, "pre", "attrs", "t_from", "t_count", "b")

    # only the output kinds this rule set uses (read from the tiny rule table)
    used = meta["outputs"]
    null_attr = F.lit(None).cast("string").alias("attr")
    parts = []
    if "self" in used:
        parts.append(m.filter(F.col("b.output") == "self").select(
            "page_id", *KEY, F.col("pre").alias("node"), null_attr, F.lit("elem").alias("kind")))
    if "attr" in used:
        parts.append(m.filter(
            (F.col("b.output") == "attr") & F.col("attrs")[F.col("b.out_attr")].isNotNull()
        ).select("page_id", *KEY, F.col("pre").alias("node"), F.col("b.out_attr").alias("attr"),
                 F.lit("attr").alias("kind")))
    if "text" in used:
        texts = of_tags(dom.text_nodes(nodes), "ptag").select(F.col("page_id").alias("t_page"), F.col("parent").alias("tparent"),
                                                              F.col("pre").alias("tpre"), F.col("text").alias("ttext"))
        mt = m.filter(F.col("b.output") == "text")
        parts.append(mt.join(texts, (F.col("page_id") == F.col("t_page")) & (F.col("pre") == F.col("tparent"))).filter(
            value_predicate(F.col("ttext"))
        ).select("page_id", *KEY, F.col("tpre").alias("node"), null_attr, F.lit("text").alias("kind")))
    if "desc_text" in used:
        md = dom.texts_below(nodes, m.filter(F.col("b.output") == "desc_text").drop("attrs"))
        parts.append(md.filter(value_predicate(F.col("ttext"))).select(
            "page_id", *KEY, F.col("tpre").alias("node"), null_attr, F.lit("text").alias("kind")))
    if not parts:
        parts.append(m.limit(0).select("page_id", *KEY, F.col("pre").alias("node"), null_attr, F.lit("elem").alias("kind")))
    sets = parts[0]
    for p in parts[1:]:
        sets = sets.unionByName(p)
    # node-set semantics: each (node, attribute) once per step
    sets = sets.distinct()
    return apply_post_ops(nodes, steps, sets)


#: Ops that look a node up in the node table, and ops that fetch texts.
_LOOKS = {"parent", "next_sibling", "desc_text", "len_gt", "len_lt", "nonblank", "bound"}
_TEXTS = {"child_text", "desc_text"}
_MOVES = {"parent", "next_sibling"}


def _text_ends(nodes: DataFrame, present: set) -> DataFrame:
    """Text nodes under the keys by which ops fetch them: ``c`` and the parent,
    ``d`` and the text's ordinal."""
    at = []
    if "child_text" in present:
        at.append(F.struct(F.lit("c").alias("how"), F.col("parent").alias("at")))
    if "desc_text" in present:
        at.append(F.struct(F.lit("d").alias("how"), F.col("t_from").alias("at")))
    return dom.text_nodes(nodes).select(F.col("page_id").alias("t_page"), F.explode(F.array(*at)).alias("k"), F.col("pre").alias("tpre"),
                                        F.col("text").alias("ttext")).select("t_page", F.col("k.how").alias("t_how"), F.col("k.at").alias("t_at"), "tpre", "ttext")


def apply_post_ops(nodes: DataFrame, steps: DataFrame, sets: DataFrame) -> DataFrame:
    """Run each step's ordered post ops as a program over its node set.

    The op is data: round k gives every node its step's k-th op and moves, keeps
    or drops it by one expression over one look-up in the node table, and ops that fetch
    texts meet them in one more join.  A round adds at most two joins to the node table
    whatever ops and however many rules there are, so plans grow linearly with
    the longest program; a node whose program has ended passes through.
    """
    meta = rule_meta(steps)
    own = keys_of(steps, KEY)
    ops = steps.select(*own, F.posexplode("post").alias("k", "o")).select(*own, "k", F.col("o.op").alias("op"), F.col("o.n").alias("op_n"), F.col("o.s").alias("op_s"))
    # ops used in each round (a few words of the rule table): plan only those
    for k, present in enumerate(meta["posts"]):
        cur = sets.join(rule_rows(steps, ops.filter(F.col("k") == k).drop("k"), meta["n_steps"]), own, "left")
        op_, elem = F.coalesce(F.col("op"), F.lit("")), F.col("kind") == "elem"
        if present & _LOOKS:
            info = nodes.filter(F.col("kind") != "error").select(
                F.col("page_id").alias("i_page"), F.col("pre").alias("i_pre"), F.col("parent").alias("i_parent"), F.col("next_sib").alias("i_next"),
                F.col("text").alias("i_text"), F.col("t_from").alias("i_from"), F.col("t_count").alias("i_count"), F.col("cls").alias("i_cls"), F.col("elem_id").alias("i_id"))
            cur = cur.join(info, (F.col("page_id") == F.col("i_page")) & (F.col("node") == F.col("i_pre")), "left")
            length = F.length("i_text")
            fits = (F.when(op_ == "len_gt", length > F.col("op_n")).when(op_ == "len_lt", length < F.col("op_n"))
                    .otherwise(_norm_len(F.col("i_text")) > 0))
            # attribute results: the parent is their element
            to = (F.when(op_ == "parent", F.when(F.col("kind") == "attr", F.col("node")).otherwise(F.col("i_parent")))
                  .when(op_ == "next_sibling", F.when(elem, F.col("i_next")).otherwise(-1)).otherwise(F.col("node")))
            cur = cur.withColumn("node", to).filter((F.col("node") >= 0) & (~op_.isin("len_gt", "len_lt", "nonblank") | ((F.col("kind") == "text") & fits)))
            if "bound" in present:
                name, value = F.substring_index("op_s", "=", 1), F.expr("substring(op_s, instr(op_s, '=') + 1)")
                has = F.coalesce(F.when(name == "class", F.col("i_cls")).otherwise(F.col("i_id")) == value, F.lit(False))
                cur = cur.filter((op_ != "bound") | (elem & has))
        moved = op_.isin(*_MOVES)
        attr, kind = F.when(~moved, F.col("attr")), F.when(moved, F.lit("elem")).otherwise(F.col("kind"))
        if present & _TEXTS:
            none = F.array().cast("array<int>")
            at = F.when(~op_.isin(*_TEXTS), F.array(F.lit(-1))).when(~elem, none).when(op_ == "child_text", F.array("node"))
            if "desc_text" in present:
                at = at.when(F.col("i_count") > 0, F.sequence("i_from", F.col("i_from") + F.col("i_count") - 1))
            cur = cur.withColumn("at", F.explode(at.otherwise(none)))
            how = F.when(op_ == "child_text", F.lit("c")).when(op_ == "desc_text", F.lit("d"))
            cur = cur.withColumn("how", how).join(
                _text_ends(nodes, present), (F.col("page_id") == F.col("t_page")) & (F.col("how") == F.col("t_how")) & (F.col("at") == F.col("t_at")), "left")
            fetched = F.col("how").isNotNull()
            cur = cur.filter(~fetched | (F.col("tpre").isNotNull() & ((F.col("how") == "c") | (_norm_len(F.col("ttext")) > 0))))
            cur = cur.withColumn("node", F.coalesce("tpre", "node"))
            attr, kind = F.when(~fetched, attr), F.when(fetched, F.lit("text")).otherwise(kind)
        if "position_max" in present:  # by place in the document-ordered node set
            place = F.row_number().over(Window.partitionBy("page_id", *KEY).orderBy("node", "attr"))
            cur = cur.withColumn("place", place).filter((op_ != "position_max") | (F.col("place") <= F.col("op_n")))
        sets = cur.select("page_id", *KEY, "node", attr.alias("attr"), kind.alias("kind"))
        if present & (_MOVES | _TEXTS):  # node sets: what several nodes led to counts once
            sets = sets.distinct()
    return sets


# ---------------------------------------------------------------------------
# Values (E2-E7)
# ---------------------------------------------------------------------------


def strip_ws(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def one_blank(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\s+", " ")


def squeeze_ws(v: Column) -> Column:
    return one_blank(strip_ws(v))


def node_values(nodes: DataFrame, pages: DataFrame | None, steps: DataFrame, sets: DataFrame,
                normalize_whitespace: bool = True, base_url: Column | None = None,
                max_results: int = fixed.MAX_RESULTS_PER_STEP, keep_empty_text: bool = False) -> DataFrame:
    """(page_id, sequence_id, step_index, node, attr, ord, value, truncated).

    Text nodes give their text, attribute results their value, elements
    their full text / an attribute / their source HTML per action type.
    Empty values are dropped; ``ord`` is the document-order rank; steps
    over ``max_results`` keep the first ``max_results`` values.
    """
    meta = rule_meta(steps)
    own = keys_of(steps, KEY)
    s = sets.join(rule_rows(steps, steps.select(*own, "action_type", "attribute"), meta["n_steps"]), own)
    # Results of rules that fetch texts only, or elements and attributes only, meet no other nodes.
    outputs = meta["outputs"]
    posts = set().union(*meta["posts"]) if meta["posts"] else set()
    texts, elems = outputs & {"text", "desc_text"} or posts & _TEXTS, outputs & {"self", "attr"} or posts & _MOVES or not outputs
    info = nodes.filter(F.col("kind") != "error") if texts and elems else dom.text_nodes(nodes) if texts else dom.elements(nodes)
    if texts and not elems and not posts and meta["tags"] is not None and "desc_text" not in outputs:
        info = info.filter(F.col("ptag").isin(*meta["tags"]))
    info = info.select(
        "page_id", F.col("pre").alias("i_pre"), F.col("text").alias("i_text"), (F.col("attrs") if elems else F.lit(None).cast("map<string,string>")).alias("i_attrs"),
        F.col("src_start").alias("i_start"), F.col("tail_end").alias("i_end"),
    )
    info = info.withColumnRenamed("page_id", "i_page")
    j = s.join(info, (F.col("page_id") == F.col("i_page")) & (F.col("node") == F.col("i_pre"))).drop("i_page")
    action = F.coalesce(F.col("action_type"), F.lit(fixed.ACTION_TEXT))
    attr_name = F.coalesce(F.col("attribute"), F.lit(fixed.DEFAULT_ATTRIBUTE))
    is_elem = F.col("kind") == "elem"
    # element text content only where needed
    if "self" in outputs or posts & {"parent", "next_sibling"}:
        need_tc = j.filter(is_elem & ~action.isin(fixed.ACTION_ATTRIBUTE, fixed.ACTION_HTML))
        tc = dom.element_text(nodes, need_tc.select("page_id", F.col("node").alias("pre")).distinct(), [])
        tc = tc.select(F.col("page_id").alias("c_page"), F.col("pre").alias("c_pre"), "text_content")
        j = j.join(tc, (F.col("page_id") == F.col("c_page")) & (F.col("node") == F.col("c_pre")), "left").drop(
            "c_page", "c_pre")
    else:
        j = j.withColumn("text_content", F.lit(None).cast("string"))
    if pages is not None and meta["html"]:
        # The spans of a page are cut in one pass over its row, not from a copy
        # of the page on every match.
        of = j.filter(is_elem & (action == fixed.ACTION_HTML)).groupBy("page_id").agg(
            F.collect_set(F.struct("i_start", "i_end")).alias("spans"))
        cut = of.join(pages.select("page_id", "html"), "page_id").select(
            F.col("page_id").alias("h_page"), F.explode(F.transform("spans", lambda x: F.struct(
                x["i_start"].alias("a"), x["i_end"].alias("b"),
                F.substring(F.col("html"), x["i_start"] + 1, x["i_end"] - x["i_start"]).alias("html")))).alias("h"))
        j = j.join(cut, (F.col("page_id") == F.col("h_page")) & (F.col("i_start") == F.col("h.a")) & (F.col("i_end") == F.col("h.b")), "left").drop("h_page")
        html_val = F.col("h.html")
    else:
        html_val = F.lit(None).cast("string")
    raw = (
        F.when(F.col("kind") == "text", F.col("i_text"))
        .when(F.col("kind") == "attr", F.col("i_attrs")[F.col("attr")])
        .when(action == fixed.ACTION_ATTRIBUTE, F.col("i_attrs")[attr_name])
        .when(action == fixed.ACTION_HTML, html_val)
        .otherwise(F.col("text_content"))
    )
    # attribute action on non-element results extracts nothing
    raw = F.when((action == fixed.ACTION_ATTRIBUTE) & ~is_elem, F.lit(None)).otherwise(raw)
    # html action on non-element results extracts nothing
    raw = F.when((action == fixed.ACTION_HTML) & ~is_elem, F.lit(None)).otherwise(raw)
    v = strip_ws(raw)
    if normalize_whitespace:
        v = squeeze_ws(v)
    if base_url is not None:
        from ..functions import urls

        v = F.when(F.startswith(v, F.lit("/")) | F.startswith(v, F.lit("./")), urls.join(base_url, v)).otherwise(v)
    out = j.select("page_id", *KEY, "node", "attr", "kind", v.alias("value"))
    keep = F.col("value").isNotNull() & (F.col("value") != "")
    if keep_empty_text:  # direct text results keep empty strings (learner semantics)
        keep = keep | ((F.col("kind") != "elem") & F.col("value").isNotNull())
    out = out.filter(keep).drop("kind")
    w = Window.partitionBy("page_id", *KEY).orderBy("node", "attr")
    out = out.withColumn("ord", F.row_number().over(w))
    return out.filter(F.col("ord") <= max_results)
