import sys

import numpy as np
import pytest
from helpers import LONG, documents, empty
from pagelens.llm import langid, textops, toxicity
from pagelens.session import read_table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_words_in_blocks(monkeypatch):
    texts = [b"", b"One two", b" a", b"b ", "straße ÀB".encode(), b"x" * 50, b"--", b"q-r"]
    table = textops.byte_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
    whole = textops.words(texts, table, (2,))
    spans = [whole.buf[s:e] for s, e in zip(whole.starts, whole.ends)]
    assert spans == [b"one", b"two", b"a", b"b", "straße".encode(), "ÀB".encode().lower(), b"x" * 50, b"q", b"r"]
    assert whole.first.tolist() == [0, 0, 2, 3, 4, 6, 7, 7, 9]
    for size in (4, 16):
        monkeypatch.setattr(textops, "BLOCK", size)
        sys.__dict__.get("_llm_stash", {}).pop("powers", None)
        part = textops.words(texts, table, (2,))
        assert part.hashes.tolist() == whole.hashes.tolist() and part.prefixes[0].tolist() == whole.prefixes[0].tolist()
        assert part.first.tolist() == whole.first.tolist()
    sys.__dict__["_llm_stash"].pop("powers", None)


def test_gram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Straße und 12 häuser, viele wörter. " * 20
    want = langid.gram_counts(text)
    monkeypatch.setattr(textops, "BLOCK", 7)
    assert (langid.gram_counts(text) == want).all()


def test_language_held_out(spark):
    docs = read_table(spark, SF, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs, ~held)
    p = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in p]) > 0.98
    assert np.mean([r.rejected for r in p]) < 0.02
    odd = documents(spark)
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in langid.predict(odd, model).collect()]
    blank = {4, 5, 6, 11}
    for i, lang, score, rejected in got:
        assert 0 <= score <= 1
        assert i is None or (lang == "und") == (i in blank) and (i not in blank or rejected and score == 0)
    left = langid.keep_known(odd, model)
    assert left.columns == odd.columns and not blank & {r.doc_id for r in left.collect()}
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    # One text gives one result, in whatever batch or block it is read.
    a = model.predict(["Das ist ein Haus", LONG, None])
    assert a[1] == model.predict([LONG])[0]


@pytest.mark.parametrize("known", [("de", "en", "es"), ("en", "fr"), ("de", "en")])
def test_junk_and_unseen_languages_go(spark, known):
    docs = read_table(spark, SF, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs, ~held & F.col("lang").isin(*known))
    rows = [(r.lang, r.text) for r in docs.filter(held & (F.length("text") > 200)).collect()]
    share = lambda texts: np.mean([r[2] for r in model.predict(texts)])
    clean = [t for lang, t in rows if lang in known]
    assert share(clean) < 0.05
    assert share([t for lang, t in rows if lang not in known]) > 0.95
    assert share([langid.shuffled(t, i) for i, t in enumerate(clean)]) > 0.95
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    assert share(["".join(rng.choice(letters, 200)) for _ in range(50)]) > 0.95


def test_thresholds():
    right, other = np.linspace(0.6, 1, 1000), np.linspace(0, 0.4, 100)
    assert 0.45 < langid.threshold(right, other) < 0.55  # the middle of the gap
    assert np.mean(right < langid.threshold(right, right)) <= langid.REJECTED / 2
    assert langid.threshold(right + 1, np.zeros(0)) > 1.5 and langid.threshold(right[:0], other) == -np.inf
    assert sorted(langid.shuffled("Ab, 1 çd", 3)) == sorted("Ab, 1 çd")


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.5, (600, 5)).astype(float)
    z = x @ np.array([1.5, 1.0, 0, 0, -0.5]) + rng.logistic(0, 0.3, 600)
    y = np.searchsorted([1.0, 2.0, 3.5], z)
    w, cuts = toxicity.fit_ordinal(x, y, np.ones(600))
    assert (np.diff(cuts) > 0).all() and w[0] > w[1] > abs(w[2]) and w[4] < 0
    p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
    assert (np.diff(p, axis=1) <= 0).all()
    assert np.corrcoef(p.sum(axis=1), y)[0, 1] > 0.85


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    s = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    hit = sum(r.said and r.toxic == 1 for r in s)
    assert hit / sum(r.said for r in s) > 0.93 and hit / sum(r.toxic for r in s) > 0.87
    clean = [r.severity for r in s if r.toxic == 0]
    bad = [r.severity for r in s if r.toxic == 1]
    assert np.mean(bad) > 10 * np.mean(clean) and {r.grade for r in s} == {0, 1, 2, 3}
    odd = documents(spark)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.train(odd, labels.filter("false"))
    assert {r.severity for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_toxicity_awkward_labels(spark):
    odd = documents(spark, [(20 + i, "vile words here" if i % 2 else "kind words here", "en") for i in range(40)])
    labels = spark.createDataFrame([(20 + i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, 1, None), (21, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    said = {r.doc_id: r.toxic for r in toxicity.score(odd, model).collect()}
    assert all(said[20 + i] == bool(i % 2) for i in range(40))
