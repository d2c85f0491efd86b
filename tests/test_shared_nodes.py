"""Publishing and scraping of the same pages parse them once."""
from pagelens.operators import dom
from pagelens.plans import queries as Q
from pagelens.plans import scrape


def test_published_rules_and_scraping_share_the_nodes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "https://a.test/1", "<h1>One title</h1>")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made, publish, used = [], scrape.validate_and_publish, []
    parse = dom.dom_nodes

    def nodes(*a, **kw):
        made.append(parse(*a, **kw))
        return made[-1]

    def scraped(pages, rules, task, nodes=None, **kw):
        used.append(nodes)
        return rules, rules

    monkeypatch.setattr(dom, "dom_nodes", nodes)
    monkeypatch.setattr(scrape, "validate_and_publish", lambda *a, **kw: (used.append(a[5] if len(a) > 5 else None), publish(*a, **kw))[1])
    monkeypatch.setattr(scrape, "scrape_known", scraped)
    rules, _ = Q._scraped(spark, str(tmp_path))
    assert len(made) == 1 and used == [made[0], made[0]] and rules.count() == 7


def test_source_spans_count_every_line_feed():
    html = "<!DOCTYPE html>\n<!-- a\nb -->\r\n<div\n class='x'>one\n<b>two\n</b> tail\r</div>\n<![CDATA[x\n]]><script>if (a<b)\n{}</script><br\n/>&amp\n<i>z"
    b = dom.parse_page(html)
    spans = {t: html[b.start[i]:b.end[i]] for i, t in enumerate(b.tag) if t}
    assert spans["b"] == "<b>two\n</b>" and spans["br"] == "<br\n/>" and spans["i"] == "<i>z"
    assert spans["div"] == "<div\n class='x'>one\n<b>two\n</b> tail\r</div>" and spans["script"] == "<script>if (a<b)\n{}</script>"
    cols = {k: [] for k in dom._NAMES}
    dom._page_rows(7, html, cols)
    assert {len(v) for v in cols.values()} == {len(b.kind)} and cols["up"][b.tag.index("b")] == [b.tag.index("div"), 0]
