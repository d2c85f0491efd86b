"""Importance resampling against a plain version, and texts longer than a batch."""
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import LONG, documents, empty, low, sha
from pagelens.llm import importance as I
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall(low(text or ""))
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]], len(w)


def drawn(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain(text)[0])
    for text in target:
        t.update(plain(text)[0])
    S, T = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * S) / ((s[b] + 1) * T)))
    out = []
    for i, text in rows:
        f, n = plain(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    best = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))[: sum(x[4] for x in out) * 25 // 100]
    place = {}
    for k, x in enumerate(best):
        place.setdefault(x[:4], []).append(k + 1)
    result = []
    for x in out:
        ranks = place.get(x[:4], [])
        result.append((*x[:4], ranks.pop(0) if ranks and x[4] else None))
    return sorted(result, key=str)


def rows_of(d):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in d.collect()), key=str)


def test_draw(spark):
    prose = [(20 + i, " ".join(f"w{(i * j) % 23}" for j in range(1, 15 + i)), "en") for i in range(30)]
    twice = [(90, "same words " * 15, "en")] * 5 + [(None, "other words " * 12, "en")] * 3
    d = documents(spark, prose + twice)
    bench = spark.createDataFrame([(1, "w1 w2 w3 Same WORDS same words"), (2, None), (3, "")], "item_id long, text string")
    got = rows_of(I.draw(d, bench))
    assert got == drawn([(r.doc_id, r.text) for r in d.collect()], [r.text for r in bench.collect()])
    assert I.draw(empty(spark), bench).count() == 0
    nothing = bench.filter("false")
    assert rows_of(I.draw(d, nothing)) == drawn([(r.doc_id, r.text) for r in d.collect()], [])
    kept = I.resample(d, bench)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[4]}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_batches_do_not_matter(monkeypatch, size):
    texts = ["One two  three", "", "!!!", "a", LONG[:3000], "Ünïcode wörds ÀÉ 日本語 straße", "x" * 500 + " y", " lead", "trail ", "a" * 20 + "-" * 40 + "b c"]
    monkeypatch.setattr(I, "BATCH", size)
    got = [Counter() for _ in texts]
    for of, buckets in I.features([t.encode() for t in texts]):
        for i, b in zip(of.tolist(), buckets.tolist()):
            got[i][b] += 1
    assert got == [Counter(plain(t)[0]) for t in texts]


def test_ranks_over_many_ranges(spark):
    d = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit(1).cast("bigint").alias("text_key"),
        F.lit(3).cast("bigint").alias("n_features"), F.lit(0).cast("bigint").alias("weight"), (F.col("id") % 4).alias("score"))
    got = I.ranked(d).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    key = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in got]
    assert key == sorted(key)
