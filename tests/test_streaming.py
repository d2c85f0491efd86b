from pagelens.operators import execute
from pagelens.plans import catalog, scrape
from pagelens.session import read_table
from pagelens.streaming import continuous


def test_stream_equals_batch(spark):
    steps = catalog.flat_steps(spark)
    streamed = continuous.run_available(spark, "/root/testdata/sf0.001/pages.parquet", steps)
    run = execute.execute(scrape.clean_pages(read_table(spark, "/root/testdata/sf0.001", "pages")), steps)
    cols = ["page_id", "sequence_id", "idx", "value"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in scrape.final_values(run.data).select(*cols).collect())
    assert a == b and len(a) > 0


def test_rules_published_between_batches_are_used(spark, tmp_path):
    from pagelens.operators import repository
    from pagelens.operators import select as S

    html = "<html><body><h1>{0} heading text</h1><h2>{0} second text</h2></body></html>"
    pages = [spark.createDataFrame([(i, f"https://library.test/{i}", html.format(f"Page{i}"))], "page_id bigint, url string, html string") for i in (1, 2)]

    def rule(name, tag):
        steps = S.steps_frame(spark, {name: [S.Step([S.Branch(tags=[tag], output="text")])]}).collect()[0]
        row = (name, "library.test", "Headings", [(0, steps.action_type, None, steps.xpath, steps.branches, steps.post)], 1.0,
               0.5 if tag == "h1" else 0.9, None, None, {})
        return spark.createDataFrame([row], repository.RULE_DDL)

    src, store, out, chk = (str(tmp_path / x) for x in ("src", "store", "out", "chk"))
    repository.save(rule("one", "h1"), store)
    for i, page in enumerate(pages):
        if i:
            repository.apply(spark, store, upserts=rule("two", "h2"))
        page.coalesce(1).write.mode("append").parquet(src)
        continuous.start_stored(spark, src, store, "Headings", out, chk).awaitTermination()
    got = {r.page_id: r for r in continuous.results(spark, out).collect()}
    assert (got[1].sequence_id, got[1].rule_version) == ("one", 1) and (got[2].sequence_id, got[2].rule_version) == ("two", 2)
    # a retried batch takes the version that it has written down
    assert repository.pinned(spark, store, f"{chk}/rules/0") == 1
    # the stream gives what the batch flow gives
    res, _ = scrape.scrape_known(pages[1], repository.load(spark, store), "Headings")
    want = res.first()
    assert (want.sequence_id, want.data_count, want.success) == (got[2].sequence_id, got[2].data_count, got[2].success)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    import pytest
    from pagelens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
