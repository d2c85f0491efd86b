"""Sources found by text, and rules whose class or id a page gives, against plain loops."""
import random
import time

from pyspark.sql import functions as F

from fixtures import SEED_PAGE
from pagelens.operators import dom, execute, learn, structure
from pagelens.operators import select as S

PAGES = "page_id bigint, url string, html string"


def test_lookup_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(structure, "LOOKUP_BLOCK", 7)
    rng = random.Random(2)
    word = lambda: rng.choice(["red", "green", " blue", "it's", "Ünï", "a  b", "\n", "x" * 40, "0"])
    rows = [(i, "u", "<div>" + "".join(f"<{t}>{word()} {word()}<b>{word()}</b>{word()}</{t}>" for t in rng.choices(["p", "span", "i"], k=15)) + "</div>") for i in range(12)]
    nodes = dom.dom_nodes(spark.createDataFrame(rows, PAGES))
    texts = [(r.page_id, r.first_text) for r in dom.elements(nodes).filter("first_text is not null").collect()]
    some = spark.createDataFrame([(p, t[k : k + n]) for p, t in texts for k, n in ((0, 30), (1, 4), (2, 1))] + [(3, "nowhere"), (4, None), (99, "red")], "page_id bigint, t string")
    needles = some.select("page_id", structure.head(F.col("t"), 30).alias("needle"))
    docs = {}
    for r in dom.elements(nodes).orderBy("page_id", "pre").collect():
        docs.setdefault(r.page_id, []).append((r.pre, r.first_text))
    asked = {(p, t.replace("'", "\\'")[:30]) for p, t in some.collect() if t}
    for limit, normal in ((5, False), (3, True), (None, False)):
        want = set()
        for p, n in asked:
            if n and "'" not in n:
                hits = [e for e, t in docs.get(p, []) if t is not None and n in (" ".join(t.split(" ")).replace("\n", " ").strip(" ") and " ".join(x for x in t.replace("\n", " ").split(" ") if x) if normal else t)]
                want |= {(p, n, e, k + 1) for k, e in enumerate(hits[:limit])}
        got = {(r.page_id, r.needle, r.pre, r.r) for r in structure.text_lookup(nodes, needles, limit, normal).collect()}
        assert got == want, (limit, normal, sorted(got ^ want)[:5])


def test_both_ways_to_look_up_equal_a_loop(monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab\n é") for _ in range(rng.randint(0, n)))
    monkeypatch.setattr(structure, "LOOKUP_BLOCK", 3)
    for _ in range(300):
        texts = [word(12) for _ in range(rng.randint(1, 9))]
        pres = sorted(rng.choices(range(12), k=len(texts)))  # a page id may come twice
        needles = list({word(4) for _ in range(6)} | {texts[0], "a\n", ""})
        for limit in (None, 1, 2):
            want = {n: sorted({p for p, t in zip(pres, texts) if n in t})[:limit] for n in needles}
            for most in (0, 1 << 30):
                monkeypatch.setattr(structure, "LOOKUP_SEARCH", most)
                assert structure.holders(pres, texts, needles, limit) == want


def test_lookup_makes_no_rows_of_windows(spark):
    """Long texts and heads of many lengths; pages without a page id and such that come twice."""
    link = "".join(f"<a href='/'>{'w' * k}x{k}.</a>" for k in range(1, 25))
    rows = [(i, f"<div>{link}<p>{('some words of page %s ' % i) * 600}</p></div>") for i in [*range(50), None, 3]]
    nodes = dom.dom_nodes(spark.createDataFrame(rows, "page_id bigint, html string"))
    a = dom.elements(nodes).filter("tag = 'a'").select("page_id", structure.head(F.col("first_text"), 30).alias("needle"))
    start = time.time()
    found = structure.text_lookup(nodes, a, 5)
    assert "explode" not in found._jdf.queryExecution().toString().lower()
    assert found.count() == 50 * 24 and found.filter("r > 1").count() == 0 and time.time() - start < 60


def test_sources_by_text(spark):
    html = ("<div><p class=a>Alpha one</p><p class=b>Alpha one</p><i>say Alpha one</i><p>it's Beta</p></div><ul>"
            + "".join(f"<li>Alpha one {k}</li>" for k in range(6)) + "</ul>")
    pages = spark.createDataFrame([(1, "u", html), (2, "u", SEED_PAGE)], PAGES)
    nodes = dom.dom_nodes(pages)
    steps = S.steps_frame(spark, {"r": [S.Step([S.Branch(tags=["p"], class_eq="b", output="text")])]})
    vals, st = execute.run_steps(nodes, steps, pages)
    extracted, _, _ = execute.sequence_results(vals, st, steps)
    by = {r.pre: (r.tag, r.first_text) for r in dom.elements(nodes).filter("page_id = 1").collect()}
    src = structure.sources(nodes, vals, st, extracted.select("page_id", "sequence_id", "idx", "value", "node")).filter("page_id = 1").orderBy("o").collect()
    # the first five that hold the text, in document order; the value's first three are among them
    assert [by[r.pre] for r in src] == [("p", "Alpha one"), ("p", "Alpha one"), ("i", "say Alpha one"), ("li", "Alpha one 0"), ("li", "Alpha one 1")]
    exact = structure.sources(nodes, vals, st).filter("page_id = 1").collect()
    assert [by[r.pre] for r in exact] == [("p", "Alpha one")]
    run = execute.execute(pages, S.steps_frame(spark, {"r": [S.Step([S.Branch(tags=["p", "li", "b"], output="text")])]}), nodes, by_text=True)
    assert run.data.filter("page_id = 1").count() > 0


def test_class_and_id_of_the_page(spark):
    """A rule with conditions, no text and too many elements takes the class, else the id,
    of its first element on each page."""
    def page(attr, n=25):
        return "<div>" + f'<b class="x" title="t"></b><p {attr}><b class="x">w</b></p>' * n + '<p class="other"><b class="x">v</b></p></div>'

    pages = spark.createDataFrame([(1, "u", page('class="one two"')), (2, "u", page('id="q"')), (3, "u", page('class="solo"')), (4, "u", page(""))], PAGES)
    nodes = dom.dom_nodes(pages)
    rule = S.Step([S.Branch(tags=["p"], desc_text_any=["w", "v"])], post=[S.op("parent")])
    assert not learn.binds(S.Step([S.Branch(tags=["p"])])) and not learn.binds(rule)  # no condition; a text in it
    rule = S.Step([S.Branch(tags=["b"], class_any=["x"])], post=[S.op("parent")])
    assert learn.binds(rule) and learn.repair_bound(rule).display() == '(//b[contains(@class, "x")])/..[@?]'
    steps = S.steps_frame(spark, {"r": [S.Step([S.Branch(tags=["p"], class_any=["o"])]) ], "any": [S.Step([S.Branch(tags=["p"])])]})
    found = {(r.page_id, r.sequence_id): r.bind for r in learn.bindings(nodes, S.select_nodes(nodes, steps)).collect()}
    assert {k: v for k, v in found.items() if k[1] == "any"} == {(1, "any"): "class=one", (2, "any"): "id=q", (3, "any"): "class=solo", (4, "any"): None}
    # the condition is on the whole attribute: a first class of several finds nothing
    template = S.steps_frame(spark, {"t": [learn.repair_bound(S.Step([S.Branch(tags=["p"], output="self")], post=[]))]})
    rows = spark.createDataFrame([("t", b) for b in ("class=one", "id=q", "class=solo", None)], "sequence_id string, bound string")
    bound = S.bind_steps(template, rows)
    pairs = spark.createDataFrame([(1, "t@class=one"), (2, "t@id=q"), (3, "t@class=solo"), (3, "t@id=q")], "page_id bigint, sequence_id string")
    got = {(r.page_id, r.sequence_id): r.n for r in S.select_nodes(nodes, bound, pairs).groupBy("page_id", "sequence_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(2, "t@id=q"): 25, (3, "t@class=solo"): 25}
    shown = {r.sequence_id: r.xpath for r in bound.collect()}
    assert shown["t"] == "//p[@?]" and shown["t@class=solo"] == "//p[@class='solo']"
    # the step of the learner that leads there
    book = learn.RuleBook()
    book.rules["own"] = rule
    flags = dict.fromkeys(("f_no_data", "f_too_many", "f_single", "f_short", "f_empty", "f_long"), False)
    nid = learn._next_rule(book, {"rule_id": "own", "kind": "specific", "binds": True, **flags})
    assert nid == "bound(own)" and learn._next_rule(book, {"rule_id": nid, "kind": "specific", "binds": True, **flags}) == "refine:content"
    assert learn._next_rule(book, {"rule_id": "own", "kind": "specific", "binds": False, **flags}) == "refine:content"
