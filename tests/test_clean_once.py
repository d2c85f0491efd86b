"""Pages are cleaned and cut into tokens once, whatever reads them."""
from fixtures import SEED_PAGE
from pagelens import fixed
from pagelens.operators import dom, execute, profile
from pagelens.operators import select as S
from pagelens.plans import queries as Q
from pagelens.plans import scrape

#: Cleaning in a plan shows itself by what it drops.
CLEANING = "noscript"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _pages(spark):
    return spark.createDataFrame([(1, "https://a.test/1", SEED_PAGE), (2, None, "<div id=a class='b  c'> <a href=x>1</a></div><!-- n -->")],
                                 "page_id bigint, url string, html string")


def test_a_profile_cleans_and_tokenises_once(spark, tmp_path, monkeypatch):
    _pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    calls, tokens = [], profile.tag_tokens
    monkeypatch.setattr(profile, "tag_tokens", lambda *a, **kw: (calls.append(a), tokens(*a, **kw))[1])
    full = Q.dom_profile(spark, str(tmp_path))
    assert len(calls) == 1 and CLEANING not in _plan(full)
    two = {r.page_id: r for r in full.collect()}[2]
    assert (two.total_elements, two.elements_with_classes, two.elements_with_ids, two.links, two.images, two.text_nodes) == (2, 1, 1, 1, 0, 1)


def test_counts_of_odd_tags(spark):
    html = "<A HREF='x' Class=y><img><IMG src=1><imgx><abbr href=1><p a=1 id =2>\x85 <b>&nbsp;</b> x  <i>"
    r = profile.basic_stats(spark.createDataFrame([(1, html)], "page_id bigint, html_clean string")).first()
    assert (r.total_elements, r.elements_with_classes, r.elements_with_ids, r.links, r.images, r.text_nodes) == (8, 1, 1, 1, 2, 2)


def test_pages_whose_spans_are_cut_are_cleaned_once(spark, monkeypatch):
    parsed, parse = [], dom.dom_nodes
    monkeypatch.setattr(dom, "dom_nodes", lambda pages: (parsed.append(pages), parse(pages))[1])
    rule = {"r": [S.Step([S.Branch(tags=["div"])], action_type=fixed.ACTION_HTML)], "t": [S.Step([S.Branch(tags=["a"], output="text")])]}
    run = execute.execute(scrape.clean_pages(_pages(spark)), S.steps_frame(spark, rule), enable_structuring=False)
    assert len(parsed) == 1 and CLEANING not in _plan(parsed[0])
    got = {(r.page_id, r.sequence_id): r.value for r in run.extracted.filter("page_id = 2").collect()}
    assert got == {(2, "r"): "<div id=a class='b c'><a href=x>1</a></div>", (2, "t"): "1"}


def test_selection_reads_the_tags_that_rules_name(spark):
    nodes = dom.dom_nodes(_pages(spark))
    rules = {"t": [S.Step([S.Branch(tags=["a"], output="text")])], "h": [S.Step([S.Branch(tags=["a"], output="attr", out_attr="href")])]}
    steps = S.steps_frame(spark, rules)
    stored = spark.createDataFrame(steps.collect(), steps.schema)  # rules whose facts are looked up
    assert S.rule_meta(steps)["tags"] == S.rule_meta(stored)["tags"] == ["a"]
    for s in (steps, stored):
        sets = S.select_nodes(nodes, s)
        assert "'a'" in _plan(sets).replace("= a)", "= 'a')") and sets.filter("page_id = 2").count() == 2
    star = S.steps_frame(spark, {"s": [S.Step([S.Branch(class_any=["b"], output="desc_text"), S.Branch(tags=["a"], output="text")])]})
    assert S.rule_meta(star)["tags"] is None and S.rule_meta(spark.createDataFrame(star.collect(), star.schema))["tags"] is None
    assert S.select_nodes(nodes, star).filter("page_id = 2").count() == 2  # the blank before the link, and its text
