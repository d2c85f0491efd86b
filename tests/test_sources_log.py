"""Captured files, the run log, slow advice, tail text."""
from pyspark.sql import functions as F

from pagelens import fixed
from pagelens.operators import advise, dom, execute
from pagelens.operators import select as S
from pagelens.plans import scrape
from pagelens.sources import captures


def test_encodings_of_captured_files(spark, tmp_path):
    text = "<html><head>{0}<title>Preis: 5 € für Käse</title></head><body>x</body></html>"
    named = text.format('<meta charset="windows-1252">')
    files = {"a.html": named.encode("cp1252"), "b.html": b"\xef\xbb\xbf" + text.format("").encode(), "c.html": b"\xff\xfe" + text.format("").encode("utf-16-le"),
             "d.html": text.format('<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-15">').encode("iso-8859-15"),
             "e.html": text.format('<meta charset="no-such-code">').encode(), "f.html": b"\xff broken", "g.html": b"",
             "h.html": text.format('<link rel="canonical" href="https://x.test/h">').encode(), "i.txt": b"not a page"}
    (tmp_path / "sub").mkdir()
    for k, v in files.items():
        (tmp_path / "sub" / k).write_bytes(v)
    got = {r.url.rsplit("/", 1)[1]: r for r in captures.html_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.html", "b.html", "c.html", "d.html", "e.html", "f.html", "h"}  # an empty file is no page
    assert got["a.html"].html == named and got["f.html"].html == "\ufffd broken"
    for k in ("b.html", "c.html", "d.html", "e.html", "h"):
        assert "Preis: 5 € für Käse" in got[k].html and not got[k].html.startswith("\ufeff")
    assert got["h"].url == "https://x.test/h" and len({r.page_id for r in got.values()}) == 7


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"url": "u1", "html": "<p>1</p>", "other": 5}\n{"page_id": 7, "url": "u2", "html": null}\n{"url": "u1", "html": "again"}\n')
    rows = captures.json_lines(spark, str(tmp_path)).collect()
    by = {r.html: r for r in rows}
    assert by[None].page_id == 7 and by["again"].page_id == by["<p>1</p>"].page_id


def test_run_log_envelope_and_slow_advice(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.test/1", "<h1>x</h1>"), (2, None, "<p>y</p>")], "page_id bigint, url string, html string")
    started = scrape.clock(pages)
    results = spark.createDataFrame([(1, "a.test", "t", True, "r", 3, 1.0, 0.5, None), (2, "b.test", "t", False, None, 0, None, None, "no")],
                                    "page_id bigint, domain string, task string, success boolean, sequence_id string, data_count bigint, "
                                    "success_rate double, robustness_score double, error string")
    log = scrape.run_log(results, started, "t")
    rows = {r.page_id: r for r in log.collect()}
    assert rows[1].status == "SUCCESS" and rows[1].items == 3 and 0 < rows[1].seconds < 600
    assert rows[1].line == f"Scraping SUCCESS | URL: https://a.test/1 | Task: t | Time: {rows[1].seconds:.2f}s | Items: 3"
    assert rows[2].line.startswith("Scraping FAILED | URL:  | Task: t | Time: ") and "Items" not in rows[2].line
    values = spark.createDataFrame([(1, 1, "v")], "page_id bigint, idx int, value string")
    docs = {r.page_id: r for r in scrape.envelope(results, values, stamp="s", log=log).collect()}
    assert docs[1].metadata.execution_time_seconds == rows[1].seconds
    path = str(tmp_path / "log")
    scrape.append_log(log, path)
    scrape.append_log(log, path)
    assert spark.read.text(path).count() == 4
    status = spark.createDataFrame([(1, "r", 0, 5), (2, "r", 0, 0), (3, "r", 0, 5)], "page_id bigint, sequence_id string, step_index int, element_count bigint")
    summary = spark.createDataFrame([(i, "r", True, 5) for i in (1, 2, 3)], "page_id bigint, sequence_id string, success boolean, data_count bigint")
    times = spark.createDataFrame([(1, 2.5), (2, 0.5)], "page_id bigint, seconds double")
    said = {r.page_id: r.improvements for r in advise.advice(status, summary, times).collect()}
    assert said == {1: fixed.ADVICE_SLOW, 2: fixed.ADVICE_BROADEN, 3: ""}


def test_html_results_have_their_tail(spark):
    html = ("<div><b>one</b> tail &amp; more<i>x</i><b>two</b><!-- c -->after<b>three</b></div>"
            "<p><b>open<br>inner</p>behind<b>four<b>five</b> five's</b> end")
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    steps = S.steps_frame(spark, {"b": [S.Step([S.Branch(tags=["b"])], action_type=fixed.ACTION_HTML)], "p": [S.Step([S.Branch(tags=["p"])], action_type=fixed.ACTION_HTML)]})
    vals, _ = execute.run_steps(dom.dom_nodes(pages), steps, pages, normalize_whitespace=False)
    got = {}
    for r in vals.orderBy("ord").collect():
        got.setdefault(r.sequence_id, []).append(r.value)
    assert got["b"] == ["<b>one</b> tail &amp; more", "<b>two</b>", "<b>three</b>", "<b>open<br>inner", "<b>four<b>five</b> five's</b> end", "<b>five</b> five's"]
    assert got["p"] == ["<p><b>open<br>inner</p>behind"]


def test_page_files_lie_in_a_bounded_number_of_folders(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<p>{i}</p>\n") for i in range(600)], "page_id bigint, html string")
    path = str(tmp_path / "files")
    captures.write_files(pages, path)
    top = [p for p in (tmp_path / "files").iterdir() if p.is_dir()]
    assert len(top) <= captures.FOLDERS < 600 and len(list((tmp_path / "files").rglob("*.txt"))) == 600
    back = captures.html_files(spark, path, "*.txt", page_id=r"page_id=([0-9]+)")
    assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * 4
    assert {r.page_id: r.html for r in back.collect()} == {i: f"<p>{i}</p>\n\n" for i in range(600)}


def test_page_files_are_written_and_listed_in_rounds(spark, tmp_path, monkeypatch):
    """No plan or commit knows of more files than a round has."""
    monkeypatch.setattr(captures, "FILES_AT_ONCE", 200, raising=False)
    monkeypatch.setattr(captures, "FOLDERS", 8)
    pages = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(600)], "page_id bigint, html string")
    path = str(tmp_path / "files")
    captures.write_files(pages, path)
    assert len(list((tmp_path / "files").rglob("*.txt"))) == 600
    back = captures.html_files(spark, path, "*.txt", page_id=r"page_id=([0-9]+)")
    assert not [f for f in back.inputFiles() if f.endswith(".txt")]
    assert {r.page_id: r.html for r in back.collect()} == {i: f"<p>{i}</p>\n" for i in range(600)} and back.count() == 600


def test_any_tree_of_files_is_read_in_rounds(spark, tmp_path, monkeypatch):
    """Files beside folders, one folder with most of them, empty and hidden ones, names like patterns."""
    monkeypatch.setattr(captures, "FILES_AT_ONCE", 15, raising=False)
    want = set()
    for name, n in (("", 3), ("a", 2), ("a/b", 20), ("c[1]", 9), ("d {x}/e", 5), ("_hidden", 4), ("empty", 0)):
        (tmp_path / name).mkdir(parents=True, exist_ok=True)
        for k in range(n):
            (tmp_path / name / f"{k}.html").write_text(f"{name} {k}")
            (tmp_path / name / f"{k}.txt").write_text("no page")
            if name != "_hidden":
                want.add(f"{name} {k}")
    back = captures.html_files(spark, str(tmp_path))
    assert {r.html for r in back.collect()} == want and back.count() == len(want) == 39
    assert not [f for f in back.inputFiles() if f.endswith(".html")]
    assert captures.html_files(spark, str(tmp_path / "a*")).count() == 22
