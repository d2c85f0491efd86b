import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from pagelens.operators import repository as R

T1, T2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)


def _rules(spark):
    rows = [("a", "ferry.test", "fares", [], 0.8, 0.7, T1, T1, {"origin": "x"}), ("b", "shop.test", "prices", [], 0.9, 0.85, T1, T1, {}),
            ("c", "", "fares", [], 0.1, 0.2, T1, T1, {}), ("d", None, "fares", [], 0.1, 0.15, T1, T1, {})]
    return spark.createDataFrame(rows, R.RULE_DDL)


def test_statistics_and_lookups(spark):
    rules = _rules(spark)
    stats = {r["metric"]: r["value"] for r in R.statistics(rules).collect()}
    assert stats["total_sequences"] == "4" and stats["unique_tasks"] == "2" and stats["average_robustness"] == "0.475"
    assert [r["sequence_id"] for r in R.list_all(rules).collect()] == ["b", "a", "c", "d"]
    assert R.fetch(rules, "b").first()["domain"] == "shop.test"
    assert R.fetch_by_domain_and_task(rules, "ferry.test", "fares").count() == 1
    assert [r.sequence_id for r in R.fetch_by_task(rules, "fares", 2).collect()] == ["a", "c"]


def test_upsert_last_wins_and_delete(spark):
    rules = _rules(spark)
    new = spark.createDataFrame([("a", "ferry.test", "fares", [], s, s, T2, T2, {}) for s in (0.3, 0.4)]
                                + [("e", "new.test", "fares", [], 0.5, 0.5, T2, T2, {})], R.RULE_DDL).coalesce(1)
    up = R.upsert(rules, new, now=F.lit(T2))
    a = up.filter("sequence_id = 'a'").collect()
    assert len(a) == 1 and a[0]["created_at"] == T1 and a[0]["updated_at"] == T2 and a[0]["robustness_score"] == 0.4
    assert up.count() == 5
    assert R.delete(up, spark.createDataFrame([("a",)], "sequence_id string")).count() == 4


def test_versions(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    assert R.load(spark, path).count() == 0
    assert R.save(_rules(spark), path) == 1
    assert {r.domain for r in R.load(spark, path).collect()} == {"ferry.test", "shop.test", "", None}
    now = R.load(spark, path)
    assert R.save(R.delete(now, now.filter("sequence_id = 'b'")), path) == 2
    assert R.load(spark, path).count() == 3 and R.load(spark, path, version=1).count() == 4
    assert [r.sequence_id for r in R.load(spark, path, domain="").collect()] == ["c"]
    (tmp_path / path / "data" / "write=dead").mkdir()  # a write that did not finish
    assert R.load(spark, path).count() == 3 and R.save(_rules(spark), path) == 3


def test_commits_rewrite_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    R.save(_rules(spark), path)
    first = R._manifest(R._Files(spark, path), 1)
    moved = spark.createDataFrame([("a", "shop.test", "fares", [], 0.9, 0.9, T2, T2, {})], R.RULE_DDL)  # another domain
    assert R.apply(spark, path, upserts=moved, now=F.lit(T2)) == 2
    second = R._manifest(R._Files(spark, path), 2)
    where = {d: str(spark.range(1).select(R._bucket(F.lit(d)).alias("b")).first().b) for d in ("ferry.test", "shop.test", "")}
    assert second[where[""]] == first[where[""]] and second[where["shop.test"]] != first[where["shop.test"]]
    assert {r.sequence_id for r in R.load(spark, path, domain="shop.test").collect()} == {"a", "b"}
    assert R.load(spark, path, domain="ferry.test").count() == 0 and R.load(spark, path, version=1).count() == 4
    assert R.apply(spark, path, deletes=moved) == 3 and R.load(spark, path).count() == 3


def test_concurrent_commits_all_survive(spark, tmp_path):
    import threading

    path = str(tmp_path / "store")
    R.save(_rules(spark), path)
    # two writers in the same bucket, two in others
    rows = [(f"n{i}", d, "fares", [], 0.5, 0.5, T2, T2, {}) for i, d in enumerate(["same.test", "same.test", "x.test", "ferry.test"])]
    got, errors = [], []

    def write(row):
        try:
            got.append(R.apply(spark, path, upserts=spark.createDataFrame([row], R.RULE_DDL)))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(r,)) for r in rows]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(got) == [2, 3, 4, 5]
    assert {r.sequence_id for r in R.load(spark, path).collect()} == {"a", "b", "c", "d", "n0", "n1", "n2", "n3"}
    for v in range(2, 6):  # every version holds what the one before it held
        assert R.load(spark, path, version=v).count() == 3 + v


def test_clean_up_keeps_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "store")
    R.save(_rules(spark), path)
    for i in range(3):
        R.apply(spark, path, upserts=spark.createDataFrame([(f"n{i}", "x.test", "t", [], 0.5, 0.5, T2, T2, {})], R.RULE_DDL))
    (tmp_path / "store" / "data" / "write=dead").mkdir()
    assert R.clean_up(spark, path) == 1  # version 2's bucket; version 1's folder still holds the other domains
    assert R.versions(spark, path) == [3, 4] and R.load(spark, path).count() == 7 and R.load(spark, path, version=3).count() == 6
    assert R.clean_up(spark, path, age_seconds=-60) == 1  # the writer that died
    assert R.load(spark, path).count() == 7


def test_rule_id(spark):
    df = spark.range(1).select(R.rule_id(F.lit("ferry.test"), F.lit("fares"), F.lit("2026-01-01T00:00:00")).alias("i"))
    assert df.first()["i"] == "seq_" + hashlib.md5(b"ferry.test:fares:2026-01-01T00:00:00").hexdigest()[:12]
