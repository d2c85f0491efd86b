import html

from pyspark.sql import functions as F

from fixtures import NOTES_PAGE
from pagelens.functions import text as T
from pagelens.operators import dom, profile


def _page(spark, h):
    return spark.createDataFrame([(1, h)], "page_id bigint, html string")


def test_clean_keeps_and_drops(spark):
    h = profile.with_clean(_page(spark, NOTES_PAGE)).first()["html_clean"]
    for gone in ["<script", "<style", "<meta", "<!--", "<noscript", "run()"]:
        assert gone not in h
    assert "<title>Field notes</title>" in h and '<h1 class="head">Birds seen</h1>' in h
    # direct text of pre and textarea as it is, text of an element in it squeezed
    assert '<pre class="table  wide">\n wren   2\n <b>robin 1</b>  owl\n</pre><textarea>  as   typed </textarea>' in h
    assert '<p title="two  blanks">By the<i>river</i>at noon &amp; later</p>' in h
    again = _page(spark, h).select(T.clean_html(F.col("html")).alias("h")).first()["h"]
    assert again == h


def test_every_reference_is_decoded(spark):
    texts = ["&hearts;&eacute;&#233;&#xE9;&NotEqualTilde;", "&amp;lt; &copy 1 &notit; &nosuch; &#0; &#x110000;", "plain", "& alone &;", "&Aacute&aacute;"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in d.select("i", T.decode_entities(F.col("t")).alias("d")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(texts)}


def test_text_and_tokens(spark):
    pc = profile.with_clean(_page(spark, NOTES_PAGE))
    t = pc.select(T.page_text(F.col("html_clean"))).first()[0]
    assert t == "Field notes Birds seen wren 2 robin 1 owl as typed By the river at noon & later"
    dist = {r["tag"]: r["n"] for r in profile.element_distribution(pc).collect()}
    assert dist["b"] == 1 and dist["pre"] == 1 and dist["title"] == 1
    info = profile.structure_info(pc).first()
    assert info["class_count"] == 2 and info["has_classes"]
    top = profile.class_patterns(pc).orderBy("rank").collect()
    assert [r["class_name"] for r in top] == ["head", "table", "wide"] and top[0]["total_classes"] == 3


def test_full_profile_keeps_pages_that_fail(spark):
    d = spark.createDataFrame([(1, NOTES_PAGE), (2, ""), (3, None)], "page_id bigint, html string")
    pc = profile.with_clean(d)
    nodes = dom.dom_nodes(pc.select("page_id", F.col("html_clean").alias("html")))
    got = {r.page_id: r for r in profile.full_profile(pc, nodes).collect()}
    assert set(got) == {1, 2, 3} and got[2].text_nodes == 0 and got[3].max_depth == 0
    assert got[1].max_depth == 3 and got[1].top_classes[0].class_name == "head"


def test_dynamic_reasons_and_routes(spark):
    body = "<p>A paragraph of some length, for a start.</p>" * 3
    pages = [(1, f"<html><body>{body}</body></html>"), (2, f'<html><body ng-app="x">{body}<p>please wait</p></body></html>'), (3, "<p>x"),
             (4, f"<html><body>{body}<script>{'f();' * 400}</script></body></html>")]
    d = spark.createDataFrame(pages, "page_id bigint, html string")
    dyn = profile.dynamic_pages(d, dom.dom_nodes(d))
    got = {r.page_id: r for r in dyn.collect()}
    assert not got[1].is_dynamic and got[1].reasons == [] and got[1].reason is None
    assert got[2].reasons == ["framework_marker", "loading_marker"] and got[2].reason == "framework_marker"
    assert got[3].reasons == ["short_html", "no_body", "little_body_text", "few_content_elements"]
    assert got[4].reasons == ["script_heavy"]
    keep, render = profile.route_pages(d, dyn)
    assert [r.page_id for r in keep.collect()] == [1] and {r.page_id for r in render.collect()} == {2, 3, 4}


def test_content_patterns(spark):
    txt = "Seen 3/9/2021, write to bird.watch@fen.example or see https://fen.example/log?day=3 ; seeds $ 1.20 and Rs.40"
    df = spark.createDataFrame([(1, txt)], "doc_id bigint, text string")
    got = {(r["kind"], r["value"]) for r in profile.content_patterns(df, "doc_id", "text").collect()}
    assert {("emails", "bird.watch@fen.example"), ("dates", "3/9/2021"), ("urls", "https://fen.example/log?day=3"), ("prices", "$ 1.20")} <= got


def _columns(html_text):
    cols = {k: [] for k in dom._NAMES}
    dom._page_rows(1, html_text, cols)
    return cols


def test_deep_and_long_pages_are_linear():
    deep = _columns("<b>" * 100_000 + "x<p>y</p>" * 50)
    assert len(deep["pre"]) == 1 + 100_000 + 150 and max(map(len, deep["up"])) == dom.NEAR
    assert deep["t_count"][:2] == [100, 100] and deep["text_len"][0] == 100
    long = _columns("<html><body><p>" + "word " * 1_300_000 + "</p></body></html>")
    assert long["kind"].count("error") == 0 and long["text_len"][0] == 6_500_000


def test_node_ranges():
    c = _columns("<div><p>a<b>c</b>d<p>e<ul><li>1<li>2</ul>f</div>g")
    at = {(t, i): k for k, (t, i) in enumerate(zip(c["tag"], c["pre"])) if t}
    below = lambda k: [c["text"][j] for j in range(len(c["pre"])) if c["kind"][j] == "text" and c["t_from"][k] <= c["t_from"][j] < c["t_from"][k] + c["t_count"][k]]
    assert below(0) == ["a", "c", "d", "e", "1", "2", "f", "g"] and below(at["ul", 9]) == ["1", "2"] and below(at["p", 2]) == ["a", "c", "d"]
    assert c["up"][at["b", 4]] == [2, 1, 0]


def test_node_table_invariants(spark):
    from pagelens.session import read_table

    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    nodes = dom.good_nodes(dom.parse_nodes(profile.with_clean(pages).select("page_id", F.col("html_clean").alias("html"))))
    bad = nodes.filter(
        (F.col("parent") >= F.col("pre")) | (F.col("last") < F.col("pre"))
        | (F.size("up") != F.least("depth", F.lit(dom.NEAR))) | ((F.col("kind") == "text") & (F.col("last") != F.col("pre")))
    ).count()
    assert bad == 0
    # every page has one root and its subtree covers the page
    roots = nodes.filter(F.col("parent") == -1).groupBy("page_id").agg(F.count("*").alias("n"), F.max("last").alias("l"))
    sizes = nodes.groupBy("page_id").agg((F.count("*") - 1).alias("m"))
    assert roots.join(sizes, "page_id").filter((F.col("n") != 1) | (F.col("l") != F.col("m"))).count() == 0
    assert dom.node_errors(dom.parse_nodes(spark.createDataFrame([(9, "  ")], "page_id bigint, html string"))).count() == 1


def test_blank_runs_take_linear_time(spark):
    n = 200_000
    rows = [(1, "<p>a" + " " * n + "b</p>"), (2, "<p>a" + "\n \t" * n + "<b>c</b>" + "\xa0" * n + "</p>"), (3, "<p class=\"x  y\">" + " " * n + "d </p> e")]
    d = spark.createDataFrame(rows, "page_id bigint, html string")
    got = {r.page_id: r.html_clean for r in profile.with_clean(d).collect()}
    assert got == {1: "<p>a b</p>", 2: "<p>a<b>c</b></p>", 3: '<p class="x  y">d</p>e'}
