from fixtures import SEED_PAGE
from pagelens.operators import dom, execute, structure
from pagelens.operators import select as S
from pyspark.sql import functions as F

B, St = S.Branch, S.Step
PAGES = "page_id bigint, url string, html string"


def _pages(spark):
    return spark.createDataFrame([(1, "https://garden.test/seeds", SEED_PAGE)], PAGES)


def _values(df):
    out = {}
    for r in df.orderBy("sequence_id", "idx").collect():
        out.setdefault(r["sequence_id"], []).append(r["value"])
    return out


def test_rule_kinds(spark):
    rules = {
        "sort": [St([B(tags=["h3"], class_eq="sort", output="text")])],
        "link": [St([B(tags=["a"])], action_type="xpath_attribute", attribute="href")],
        "three": [St([B(tags=["h3"], output="text")]), St([B(tags=["em"], output="text")]), St([B(tags=["p"], output="text")])],
        "broken": [St([], xpath="//x[[")],
        "ids": [St([B(tags=["section"], output="attr", out_attr="id")])],
        "html": [St([B(tags=["em"])], action_type="xpath_html")],
        "odd": [St([B(tags=["title"], output="text")], action_type="no such action")],
    }
    run = execute.execute(_pages(spark), S.steps_frame(spark, rules), resolve_relative=True)
    v = _values(run.extracted)
    assert v["sort"] == ["Purple carrot seeds", "Curly kale seeds", "Yellow beetroot seeds"]
    assert v["link"] == ["https://garden.test/roots", "https://garden.test/leaves"]
    assert len(v["three"]) == 9 and v["ids"] == ["s1", "s2", "s3"] and v["odd"] == ["Seeds"]
    assert v["html"][0] == '<em class="cost">€2.40</em>'
    s = {r["sequence_id"]: r for r in run.summary.collect()}
    assert s["three"]["successful_steps"] == 3 and s["three"]["success"]
    assert not s["broken"]["success"] and s["broken"]["error_summary"] == ["Step 0: XPath execution failed: Invalid expression"]


def test_union_dedup_truncation_and_elements(spark):
    rules = {
        "u": [St([B(tags=["title", "h3"], output="text")])],
        "dup": [St([B(tags=["h3"], output="text")]), St([B(class_eq="sort", output="text")])],
        "el": [St([B(tags=["section"])])],
        "cap": [St([B(output="desc_text", nonblank=True)])],
    }
    run = execute.execute(_pages(spark), S.steps_frame(spark, rules), max_results=4, enable_structuring=False)
    by = _values(run.extracted)
    assert by["u"] == ["Seeds", "Purple carrot seeds", "Curly kale seeds", "Yellow beetroot seeds"]
    assert len(by["dup"]) == 3 and by["el"][0].startswith("Purple carrot seeds")
    stat = {(r["sequence_id"], r["step_index"]): r for r in run.steps.collect()}
    assert stat[("cap", 0)]["status"] == "partial" and stat[("cap", 0)]["error_message"] == "Results truncated to 4 items"


def test_post_ops(spark):
    rules = {
        "par": [St([B(tags=["em"], output="text")], post=[S.op("parent"), S.op("parent"), S.op("desc_text"), S.op("len_gt", 40)])],
        "pos": [St([B(tags=["h3"], output="text")], post=[S.op("position_max", 2)])],
        "sib": [St([B(tags=["h3"])], post=[S.op("next_sibling"), S.op("child_text")])],
    }
    got = _values(execute.execute(_pages(spark), S.steps_frame(spark, rules), enable_structuring=False).extracted)
    assert len(got["par"]) == 3 and got["par"][0].startswith("Sow outdoors")
    assert got["pos"] == ["Purple carrot seeds", "Curly kale seeds"] and got["sib"] == ["€2.40", "€3.10", "€2.75"]


def test_pages_that_fail_are_reported(spark):
    pages = spark.createDataFrame([(1, "u", SEED_PAGE), (2, "u", " "), (3, "u", None)], PAGES)
    steps = S.steps_frame(spark, {"r": [St([B(tags=["h3"], output="text")]), St([], xpath="//x[[")]})
    run = execute.execute(pages, steps)
    st = {(r.page_id, r.step_index): r for r in run.steps.collect()}
    assert st[2, 0].status == "failed" and st[2, 0].error_message.startswith("HTML parsing failed") and len(st) == 6
    s = {r.page_id: r for r in run.summary.collect()}
    assert s[1].success and not s[2].success and s[3].failed_steps == 2 and s[3].error_summary == [st[3, 0].error_message]
    p = {(r.page_id, r.step_index): r for r in execute.probe(pages, steps).collect()}
    assert p[1, 0].valid and not p[1, 1].valid and not p[2, 0].valid
    assert list(p[1, 0].result_types) == ["text"] and p[1, 0].result_count == 3 and list(p[1, 0].sample_results)[0] == "Purple carrot seeds"


def test_a_page_meets_its_own_rules_only(spark):
    """With pairs, elements are joined with the branches of their page's rules."""
    pages = spark.createDataFrame([(i, "u", SEED_PAGE) for i in range(20)], PAGES)
    rules = {f"r{i}": [St([B(tags=["h3"], output="text")])] for i in range(20)}
    pairs = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "page_id bigint, sequence_id string")
    nodes = dom.dom_nodes(pages)
    sets = S.select_nodes(nodes, S.steps_frame(spark, rules), pairs)
    assert sets.count() == 60 and sets.filter(F.concat(F.lit("r"), "page_id") != F.col("sequence_id")).count() == 0
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "tkey" in plan and "LeftSemi" not in plan  # not: all rules first, own rules after


def _records(run):
    return [(r.strategy, dict(r.record) if r.record else r.value) for r in run.data.orderBy("idx").collect()]


def _run(spark, html, *tags):
    pages = spark.createDataFrame([(1, "u", html)], PAGES)
    return execute.execute(pages, S.steps_frame(spark, {"r": [St([B(tags=[t], output="text")]) for t in tags]}))


def test_records_of_containers(spark):
    run = _run(spark, SEED_PAGE, "h3", "em")
    first = {"title": "Purple carrot seeds", "price": "€2.40"}
    got = _records(run)
    # the first entry, then what encloses it: later entries lie in a container found earlier
    assert got[0] == ("container", first) and len(got) == 4  # section, main, body, html
    assert {g[0] for g in got} == {"container"} and all(g[1]["price"] == "€2.40" for g in got)
    assert got[1][1]["title"] == "Yellow beetroot seeds"  # the longest name of the list
    s = run.summary.first()
    assert s.data_count == 4 and s.data_extraction_rate == 2.0


def test_compat_containers_keep_one_of_a_kind(spark):
    pages = _pages(spark)
    nodes = dom.dom_nodes(pages)
    steps = S.steps_frame(spark, {"r": [St([B(tags=["h3"], output="text")]), St([B(tags=["em"], output="text")])]})
    vals, st = execute.run_steps(nodes, steps, pages)
    src = structure.sources(nodes, vals, st)
    both = [{r.container for r in structure.containers(nodes, src, compat).collect()} for compat in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_product_elements_and_pairs(spark):
    one = "<html><body><div class='card'><b>Walnut dresser with drawers</b><i>$80</i></div></body></html>"
    assert _records(_run(spark, one, "b")) == [("product", {"title": "Walnut dresser with drawers"})]
    # link texts are no items, so the long ones become records of their own
    links = "<html><body><ul><li><a href='/1'>A very long chapter name</a></li><li><a href='/2'>Chapter two of it all</a></li></ul></body></html>"
    assert _records(_run(spark, links, "a")) == [("pair", {"title": "A very long chapter name"}), ("pair", {"title": "Chapter two of it all"})]


def test_parents_and_flat(spark):
    assert _records(_run(spark, "<html><body><h1>Lone heading</h1></body></html>", "h1")) == [("parent", {"title": "Lone heading"})]
    short = "<html><body><i>ab</i><i>cd</i></body></html>"  # navigation-like texts stay values
    assert _records(_run(spark, short, "i")) == [("flat", "ab"), ("flat", "cd")]


def test_pairing_is_greedy_in_order():
    prices = [("$1", [3, 1]), ("$2", [5, 1]), ("$3", [9])]
    titles = [("far", [8]), ("near one", [4, 1]), ("near two", [5, 1])]
    assert structure.pair_up(prices, titles) == [
        {"title": "near one", "price": "$1"}, {"title": "near two", "price": "$2"}, {"price": "$3"}, {"title": "far"}]


def test_navigation_and_fields(spark):
    df = spark.createDataFrame([("Home",), ("Nike",), ("SALE",), ("Comfortable running shoe",), ("shoes",)], "t string")
    assert [r[0] for r in df.select(structure.is_navigation(F.col("t"))).collect()] == [True, False, True, False, True]
    f = df.select(structure.field_name(F.col("t"), F.lit(None), F.lit("span"), F.lit(False))).collect()
    assert [r[0] for r in f] == ["text", "title", "text", "title", "title"]


NESTED = """<html><body><div class="x"><p>A <b>bold</b> claim that is <i>long</i> enough</p><ul><li><a href="/r">Roots <span>and leaves</span></a></li>
<li><a>No <b>way</b></a></li></ul><a href="/i"><img src="a.png"/></a><img class="star" src="b.png"/><div><span>Cost</span> <em>€2.40</em></div><time><b>May</b></time>
<section><h2>Walk<b>ing</b> far</h2><div class="body-x"><u>kale</u></div><p>One<br/>two</p><p><s></s></p></section></div><footer><small>All <b>rights</b></small></footer></body></html>"""


def _field(e):
    """F4 as the appendix of the survey states it."""
    text, cls = "".join(e.itertext()).strip(), e.get("class", "").lower()
    has = lambda s, *words: any(w in s for w in words)
    if has(text, "Rs.", "$", "€", "£", "₹") or "price" in text.lower():
        return "price"
    if has(text, "New Balance", "Nike", "Adidas", "Puma", "Reebok") or has(text.lower(), "shoe", "sneaker", "boot", "sandal", "trainer", "running", "walking"):
        return "title"
    for name, words in (("title", "title heading name"), ("brand", "author by writer brand"), ("description", "text content body desc"), ("price", "price cost amount money"),
                        ("date", "date time when"), ("category", "tag category label"), ("rating", "rating star review")):
        if has(cls, *words.split()):
            return name
    if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "title"
    if e.tag == "a":
        return "link" if e.get("href") else "title"
    if e.tag in ("p", "div", "span"):
        return "description" if len(text) > 100 else "title" if len(text) > 20 else "text"
    return {"time": "date", "img": "image"}.get(e.tag) or ("description" if len(text) > 100 else "title" if len(text) > 10 else "code")


def test_every_element_has_a_field(spark, tmp_path):
    """With its full text: elements with element children, and void ones."""
    from xml.etree import ElementTree

    from pagelens.plans import queries

    nodes = dom.dom_nodes(spark.createDataFrame([(1, "u", NESTED)], PAGES))
    got = [(r.tag, r.text, r.field) for r in structure.field_names(nodes, with_text=True).orderBy("pre").collect()]
    every = list(ElementTree.fromstring(NESTED).iter())
    assert got == [(e.tag, "".join(e.itertext()).strip(), _field(e)) for e in every]
    assert {f for t, _, f in got if t == "img"} == {"image", "rating"}
    spark.createDataFrame([(1, "u", NESTED)], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.QUERIES["field_inference_all"](spark, str(tmp_path)).collect()
    assert len(rows) == len(every) and ("img", 1, "image") in {(r.tag, r.idx, r.field) for r in rows}


def test_partition_independence(spark):
    from pagelens.plans import catalog, scrape
    from pagelens.session import read_table

    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    out = []
    for n in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        run = execute.execute(scrape.clean_pages(pages), catalog.bench_steps(spark), enable_structuring=False)
        out.append(sorted(tuple(r) for r in run.extracted.select("page_id", "sequence_id", "idx", "value").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] and len(out[0]) > 0
