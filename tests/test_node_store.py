"""The node store, linear text facts, and rule programs against plain loops."""
import random

from pyspark.sql import functions as F

from pagelens.operators import dom, structure
from pagelens.operators import select as S

PIECES = ["Pri", "ce", "p", "r", "i", "c", "e", "New", " ", "Balance", "New Bal", "ance", "Rs", ".", "Rs.5", "sho", "es", "Nik", "e ", "\n  ", "word " * 6,
          "a longer run of words ", "$", "run", "ning", " ", "x", "İ", "PRICE", "boot"]
TAGS = ["div", "span", "b", "p", "a", "li", "time", "h2", "em"]


def _tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(PIECES)
    tag = rng.choice(TAGS)
    cls = rng.choice(["", "", ' class="title"', ' class="x"', ' href="/y"'])
    inner = "".join(_tree(rng, depth - 1) if rng.random() < 0.7 else rng.choice(PIECES) for _ in range(rng.randint(0, 4)))
    return f"<{tag}{cls}>{inner}</{tag}>" + rng.choice(["", "<img>", "<br>"])


def test_field_names_equal_those_of_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, "<html><body>" + "".join(_tree(rng, 5) for _ in range(6)) + "</body></html>") for i in range(60)]
    nodes = dom.dom_nodes(spark.createDataFrame(rows + [(90, ""), (91, "<p></p>")], "page_id bigint, html string"))
    e = dom.elements(nodes).select("page_id", "pre", "tag", "cls", "href")
    txt = S.strip_ws(F.col("text_content"))
    want = e.join(dom.element_text(nodes, e, []), ["page_id", "pre"]).select(
        "page_id", "pre", F.length(txt).alias("n_chars"), structure.field_name(txt, F.col("cls"), F.col("tag"), F.col("href").isNotNull()).alias("field"))
    want = {tuple(r) for r in want.collect()}
    got = {tuple(r) for r in structure.field_names(nodes).select("page_id", "pre", "n_chars", "field").collect()}
    assert len(want) > 1000 and got == want


def test_deep_nesting_is_linear(spark):
    import time

    n = 100_000
    html = "<div>t " * n
    start = time.time()
    f = structure.field_names(dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string")))
    assert f.count() >= n
    assert time.time() - start < 60


def _plain(doc, ops):
    """The ops of one step on one page's node rows, in a loop."""
    by = {r.pre: r for r in doc}
    out = {(r.pre, "elem") for r in doc if r.tag == "b"}
    for o in ops:
        now = set()
        for place, (n, kind) in enumerate(sorted(out)):
            r = by[n]
            if o["op"] == "parent" and r.parent >= 0:
                now.add((r.parent, "elem"))
            elif o["op"] == "next_sibling" and kind == "elem" and r.next_sib >= 0:
                now.add((r.next_sib, "elem"))
            elif o["op"] in ("child_text", "desc_text") and kind == "elem":
                now |= {(x.pre, "text") for x in doc if x.kind == "text" and (
                    x.parent == n if o["op"] == "child_text" else n < x.pre <= r.last and x.text.strip(" \t\n\r"))}
            elif o["op"] == "position_max" and place < o["n"]:
                now.add((n, kind))
            elif o["op"] in ("len_gt", "len_lt", "nonblank") and kind == "text":
                size = len(r.text)
                if {"len_gt": size > (o["n"] or 0), "len_lt": size < (o["n"] or 0), "nonblank": bool(r.text.strip(" \t\n\r"))}[o["op"]]:
                    now.add((n, kind))
        out = now
    return out


def test_programs_equal_a_loop_and_plans_grow_linearly(spark):
    rng = random.Random(5)
    rows = [(i, "<html><body>" + "".join(_tree(rng, 4) for _ in range(8)) + "</body></html>") for i in range(12)]
    nodes = dom.dom_nodes(spark.createDataFrame(rows, "page_id bigint, html string"))
    kinds = [("parent", None), ("next_sibling", None), ("child_text", None), ("desc_text", None), ("position_max", 3), ("len_gt", 2), ("len_lt", 6), ("nonblank", None)]
    programs = {f"r{i}": [S.op(*rng.choice(kinds)) for _ in range(rng.randint(0, 4))] for i in range(30)}
    programs |= {"t": [S.op("parent"), S.op("desc_text"), S.op("len_gt", 2), S.op("position_max", 2)], "c": [S.op("child_text"), S.op("parent"), S.op("parent")]}
    steps = S.steps_frame(spark, {k: [S.Step([S.Branch(tags=["b"])], post=v)] for k, v in programs.items()})
    got = {}
    for r in S.select_nodes(nodes, steps).collect():
        got.setdefault((r.page_id, r.sequence_id), set()).add((r.node, r.kind))
    docs = {}
    for r in nodes.collect():
        docs.setdefault(r.page_id, []).append(r)
    for page, doc in docs.items():
        for k, ops in programs.items():
            assert got.get((page, k), set()) == _plain(doc, ops), (page, k, ops)
    joins = []
    for n in (1, 2, 3, 4):
        post = [S.op("parent"), S.op("desc_text"), S.op("parent"), S.op("child_text")][:n]
        rules = {f"{k}": [S.Step([S.Branch(tags=["b"])], post=[S.op(k)] + post[1:])] for k in ("parent", "next_sibling", "child_text", "desc_text")}
        plan = S.select_nodes(nodes, S.steps_frame(spark, rules))._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join "))
    assert max(b - a for a, b in zip(joins, joins[1:])) <= 3


def test_store_reads_only_its_columns_and_is_released(spark):
    from pagelens import session

    session.release(spark)
    nodes = dom.dom_nodes(spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id bigint, html string"))
    plan = dom.elements(nodes).groupBy("page_id").agg(F.count("tag"))
    text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Exchange" not in text and "ReadSchema: struct<page_id:bigint,kind:string,tag:string>" in text and "EqualTo(kind,elem)" in text
    assert plan.count() == 2
    assert session.release(spark) == 1 and session.release(spark) == 0
