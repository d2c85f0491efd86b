"""Hard negatives and nearest neighbours against brute force."""
import math
import random

import numpy as np
import pytest
from pagelens.llm import ann, hardneg, queries, vectors
from pyspark.sql import functions as F

DDL = "vec_id long, embedding array<double>, label int, id long, block int, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, 0.5) for r in rows], DDL)


def some(n, dims, seed, scale=1.0, hot=0):
    rng = random.Random(seed)
    one = [rng.gauss(0, 0.2) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(one) if i < hot else [scale * rng.gauss(0, 0.2) for _ in range(dims)]
        rows.append((i, v, 3 if i < hot else rng.randrange(3)))
    return rows


AWKWARD = [(None, [0.1] * 9, 1), (5000, None, 1), (5001, [], 1), (5002, [0.1, None] + [0.2] * 7, 1), (5003, [float("nan")] * 9, 1),
           (5004, [float("inf")] + [0.1] * 8, 1), (5100, [0.0] * 9, None), (5200, [0.3, 0.1], 2), (5300, [1e200, -1e200] + [0.1] * 7, 1)]


def brute_hard(rows, k=5):
    ok = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    most = math.floor(math.sqrt(2.0**62 / max(len(v) for _, v, _ in ok)))
    q = [(i, [max(-most, min(most, math.floor(min(1e300, max(-1e300, 256 * x))))) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in ok]
    out, seen = [], set()
    for a, av, al in q:
        if a % 100 or (a, tuple(av), al) in seen:
            continue
        seen.add((a, tuple(av), al))
        s = sorted(((-sum(x * y for x, y in zip(av, v)), i, l) for i, v, l in q if i != a))
        for p, pid, _ in [x for x in s if x[2] == al][:k]:
            p = -p
            negatives = [(-n, i) for n, i, l in s if l != al and 80 * p <= 100 * -n <= 100 * p][:k]
            out += [(a, pid, r + 1, i, p, n) for r, (n, i) in enumerate(negatives)]
    return sorted(out)


def mined(d):
    label = F.col("label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label.cast("bigint") + 1) % 10).otherwise(label)
    m = hardneg.mine(d, F.col("id") % 100 == 0, label=noisy)
    return sorted(tuple(r) for r in m.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("rows", [
    some(450, 9, 1) + AWKWARD + some(40, 9, 1)[:30],  # repeated rows, an anchor among them
    some(400, 17, 2, hot=150),  # a third are one vector: ties
    [(100 * i, [0.5 - i / 7, 0.25], i % 2) for i in range(8)],  # every row an anchor, scores below zero
])
def test_hard_negatives(spark, monkeypatch, rows):
    monkeypatch.setattr(hardneg, "CHUNK", 64)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    monkeypatch.setattr(vectors, "GROUP_BYTES", 2000)  # several groups of blocks
    want = brute_hard(rows)
    got = mined(table(spark, rows).repartition(3))
    assert got == want and want


def test_hard_negatives_of_nothing(spark):
    assert mined(table(spark, some(5, 4, 1)).filter("false")) == []
    assert mined(table(spark, [(7, [0.1], 1)])) == []


def test_four_russians_scores():
    rng = np.random.default_rng(1)
    for bits, dims in ((3, 5), (12, 64), (27, 20)):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (n, dims)) for n in (7, 300))
        assert (hardneg.scores(hardneg.subset_sums(a), hardneg.bit_planes(b)) == b @ a.T).all()
    assert hardneg.bit_planes(np.array([[0, -1], [127, -128]])).shape[0] == 8


def brute_near(rows, k=5):
    ok = {}
    rows = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in rows)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in rows])
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for j, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = u @ u[j]
            ok[i] = sorted((-round(s[n], 12), rows[n][0]) for n in range(len(rows)) if rows[n][0] != i)[:k]
    return ok


def found(d, **kw):
    out = {}
    for r in ann.search(d, F.col("id") % 50 == 0, **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("rows", [some(600, 20, 3) + AWKWARD, some(900, 16, 4, hot=300), some(4, 3, 5), some(1, 3, 5), [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0)]])
def test_neighbours(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "CHUNK", 32)
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(vectors, "GROUP_BYTES", 5000)
    want = brute_near(rows)
    got = found(table(spark, rows).repartition(3))
    hit = sum(len({i for _, i in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    ids = {i: v for i, v, _ in rows if i is not None}
    for q, answers in got.items():
        assert len(answers) == min(5, len(want[q]))
        assert answers == sorted(answers, key=lambda x: (-round(x[1], 12), x[0]))
        for i, s in answers:
            a, b = (np.pad(np.array(ids[x]), (0, 64 - len(ids[x]))) for x in (q, i))
            scale = lambda v: v / np.abs(v).max()
            a, b = scale(a), scale(b)
            assert math.isclose(s, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=0, abs_tol=1e-12)


def test_neighbours_of_copies_are_the_smallest_ids(spark):
    rows = some(400, 12, 6, hot=150)
    got = found(table(spark, rows))
    for q in (0, 50, 100):
        assert [i for i, _ in got[q]] == [i for i in range(6) if i != q][:5]


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in d.collect()]
    want, got = brute_near(rows), {}
    for r in queries.op13_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len({i for _, i in want[q]} & got[q]) for q in want)
    assert set(got) == set(want) and hit >= 0.9 * 5 * len(want)


def test_neighbours_of_nothing(spark):
    assert found(table(spark, AWKWARD[:7]).filter("false")) == {}
    assert found(table(spark, AWKWARD[:7])) == {}
