"""Rows of a step lie with their pages: what meets them needs no exchange and no Python worker."""
from fixtures import SEED_PAGE
from pagelens.operators import dom, execute, structure
from pagelens.operators import select as S
from pagelens.session import kept, local_rows

PAGES = [(1, "https://a.test/1", SEED_PAGE), (2, "https://b.test/2", "<h1>x</h1><p>one</p><p>two</p>"), (2, "https://b.test/2", "<h1>x</h1>"), (None, None, None)]
PAGE_DDL = "page_id bigint, url string, html string"


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_meet_the_nodes_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = dom.dom_nodes(spark.createDataFrame(PAGES, PAGE_DDL))
        steps = S.steps_frame(spark, {"p": [S.Step([S.Branch(tags=["p"], output="text")])]})
        sets = kept(S.select_nodes(nodes, steps))
        assert [r.page_id for r in sets.filter("page_id = 2").collect()] == [2, 2]
        plan = _physical(S.node_values(nodes, None, steps, sets).groupBy("page_id", "sequence_id").count())
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rule_tables_need_no_python_worker(spark):
    steps = S.steps_frame(spark, {"p": [S.Step([S.Branch(tags=["p", "b"], output="text")], post=[S.op("position_max", 3)])], "none": [S.Step([])]})
    assert "LocalTableScan" in _physical(steps) and "ExistingRDD" not in _physical(steps)
    rows = {r.sequence_id: r for r in steps.collect()}
    assert rows["p"].branches[0].tags == ["p", "b"] and rows["p"].branches[0].min_len is None and rows["p"].post[0].n == 3 and rows["none"].branches == []
    assert local_rows(spark, [], "a string, b array<int>").collect() == []


def test_rules_of_one_page_meet_its_rows_only(spark):
    """A step table with the page of each rule gives what pairs give, without a broadcast of the rules."""
    pages = spark.createDataFrame(PAGES[:2], PAGE_DDL)
    nodes = dom.dom_nodes(pages)
    steps = S.steps_frame(spark, {"a": [S.Step([S.Branch(tags=["h1"], output="text")]), S.Step([S.Branch(output="self")], post=[S.op("position_max", 2)])],
                                  "b": [S.Step([S.Branch(tags=["p"], output="text")], post=[S.op("parent")])]})
    pairs = spark.createDataFrame([(1, "a"), (2, "b")], "page_id bigint, sequence_id string")
    own = pairs.join(steps, "sequence_id")

    def run(rules):
        vals, st = execute.run_steps(nodes, rules, pages, pairs=pairs)
        _, summary, _ = execute.sequence_results(vals, st, rules, pages)
        return (sorted(map(str, vals.collect())), sorted(map(str, st.collect())), sorted(map(str, summary.collect())), S.select_nodes(nodes, rules, pairs))

    by_pairs, by_page = run(steps), run(own)
    assert by_pairs[:3] == by_page[:3] and len(by_page[2]) == 2 and by_page[0]
    assert "ResolvedHint" not in S.rule_rows(own, own, 3)._jdf.queryExecution().analyzed().toString()


def test_field_names_and_navigation_of_odd_texts(spark):
    rows = [("Menu", None, "a", False), ("Rs. 12", "X", "DIV", False), ("Nothing PRICE", None, "p", False), ("x", "product-Title", "span", False), (None, None, "a", True),
            ("SHOES", None, "li", False), ("abc", None, "img", False)]
    df = spark.createDataFrame(rows, "text string, cls string, tag string, h boolean")
    c = structure.F.col
    got = df.select(structure.field_name(c("text"), c("cls"), c("tag"), c("h")).alias("f"), structure.is_navigation(c("text")).alias("n")).collect()
    assert [r.f for r in got[1:3]] == ["price", "price"] and got[4].f == "link" and got[6].f == "image"
    assert got[0].n is True and got[1].n is False and got[4].n is None
