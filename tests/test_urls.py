from pyspark.sql import functions as F

from fixtures import URLS
from pagelens.functions import urls


def _rows(spark, cols):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    return [r for r in df.select("url", *cols).collect()]


def test_validate_collects_all_issues(spark):
    iss = [r["iss"] for r in _rows(spark, [urls.issues(F.col("url")).alias("iss")])]
    assert iss[0] == [] and iss[1] == [] and iss[6] == []
    assert iss[2] == ["Blocked domain pattern: 192\\.168\\."]
    assert iss[3] == ["Invalid URL format", "Unsupported scheme: ", "Missing domain name"]
    assert iss[4] == ["Invalid URL format", "Unsupported scheme: gopher"]
    assert iss[5] == ["Invalid URL format"]


def test_normalise(spark):
    norm = [r["n"] for r in _rows(spark, [urls.normalized(F.col("url")).alias("n")])]
    assert norm[0] == "https://garden.test/" and norm[6] == "https://garden.test/a/b"
    assert norm[2] is None and norm[3] is None


def test_metadata_and_site_type(spark):
    m = [r["m"] for r in _rows(spark, [urls.metadata(F.col("url")).alias("m")])]
    assert m[1]["site_type"] == "ecommerce" and m[0]["site_type"] == "general"
    assert m[1]["has_query"] and m[1]["has_fragment"] and m[1]["is_secure"]
    assert m[1]["path_segments"] == ["tools", "rake"] and m[6]["port"] == 443 and m[4] is None


def test_blocked_pattern_anywhere_in_host(spark):
    df = spark.createDataFrame([("https://radio10.example.com/x",)], "url string")
    assert df.select(urls.issues(F.col("url"))).first()[0] == ["Blocked domain pattern: 10\\."]


def test_absolute_join_and_normalise(spark):
    df = spark.createDataFrame(
        [("https://h.test/a/b/", "../c.html"), ("https://h.test/a/b", "/für"),
         ("https://h.test/a/b", "c?q=1"), ("https://h.test/a/b", "//other.test/z"), ("https://h.test/a", "/a b")],
        "base string, rel string")
    out = urls.resolve(df, "base", "rel", "abs").select("abs").collect()
    assert [r[0] for r in out] == [
        "https://h.test/c.html", "https://h.test/f%C3%BCr", "https://h.test/a/c?q=1",
        "https://other.test/z", None]  # a blank fails the format check of the joined URL


def test_default_port_removal_is_substring_replace(spark):
    df = spark.createDataFrame([("http://pond.test:8080/x",)], "url string")
    assert df.select(urls.normalized(F.col("url"))).first()[0] == "http://pond.test80/x"


def test_robots_and_domain(spark):
    df = spark.createDataFrame([("https://Pond.TEST/x",), ("no url",)], "url string")
    rows = df.select(urls.domain(F.col("url")), urls.robots_url(F.col("url"))).collect()
    assert tuple(rows[0]) == ("pond.test", "https://Pond.TEST/robots.txt")
    assert tuple(rows[1]) == (None, None)
