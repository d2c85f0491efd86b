import random
import re

import pytest
from helpers import DOCS, documents, empty, linked, sha, simhash
from pagelens.llm import exact_dedup, simhash as S


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(rows, marks):
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(normal(t)), []).append(i)
    key = lambda i: (i is None, i or 0)
    want = sorted(((i, min(g, key=key), len(g), sha_) for sha_, g in groups.items() for i in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in marks), key=str) == want
    kept = {}
    for r in marks:
        if r.kept:
            assert r.digest not in kept and r.doc_id == r.keep_id
            kept[r.digest] = r.doc_id
    assert set(kept) == set(groups)


@pytest.mark.parametrize("support", [1.0, 0.2, 1e-3])
def test_exact_awkward(spark, support):
    """The result is the same whether groups count as heavy or not."""
    d = documents(spark)
    check_exact([(r.doc_id, r.text) for r in d.collect()], exact_dedup.mark_duplicates(d, support=support).collect())


def test_heavy_digests_are_found(spark):
    d = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'warm' ELSE CAST(id AS STRING) END AS text").repartition(7)
    win = exact_dedup.heavy_winners(exact_dedup.stored(exact_dedup.digests(d)), 0.01).collect()
    assert {(w.keep_id, w.group_size) for w in win} == {(0, 667), (1, 27)}
    check_exact([(r.doc_id, r.text) for r in d.collect()], exact_dedup.mark_duplicates(d, support=0.01).collect())


def test_exact_rows_that_stay(spark):
    d = documents(spark)
    left = exact_dedup.drop_duplicates(d)
    assert left.columns == d.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [1, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13]  # null and empty are equal; blank is one space
    assert exact_dedup.drop_duplicates(empty(spark)).count() == 0
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def test_fingerprint_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "A", "a b", "A b C", " a\nb\tc d ", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 60))) for _ in range(40))]
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(S, "BLOCK", size)
        assert [S.fingerprint(t.encode()) for t in texts] == [simhash(t) for t in texts]
    assert S.fingerprint(None) == 0


def test_simhash_awkward(spark):
    d = documents(spark)
    got = S.near_duplicates(d).collect()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    fp = [simhash(t) for _, t in rows]
    root = linked(range(len(rows)), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    members = {}
    for i, r in root.items():
        members.setdefault(r, []).append(rows[i][0])
    first = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    want = sorted(((rows[i][0], f"{fp[i]:016x}", first[root[i]]) for i in root), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert S.near_duplicates(empty(spark)).count() == 0
    left = S.drop_near_duplicates(d)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == set(first.values())


@pytest.mark.parametrize("t", [1, 2, 3])
def test_links_keep_components(spark, t):
    """However the differing bits lie on the ring and however crowded a key is."""
    rng = random.Random(t)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for base in list(fps)[:6]:
        x = base
        for _ in range(15):
            for _ in range(rng.randint(1, t + 1)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    low = rng.getrandbits(64) & ~0xFFF  # a first key that many share
    fps |= {low | x for x in rng.sample(range(1 << 12), 250)}
    sign = {f: f - (1 << 64 if f >> 63 else 0) for f in fps}
    e = S.links(spark.createDataFrame([(v,) for v in sign.values()], "fp long"), t)
    edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in e.collect()]
    assert all((a ^ b).bit_count() <= t for a, b in edges)
    near = set(edges) | {(b, a) for a, b in edges}
    assert linked(sorted(fps), lambda i, j: (i, j) in near) == linked(sorted(fps), lambda i, j: (i ^ j).bit_count() <= t)


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(0, 40) if i % 10 != 9] + [(100, 3), (100, 25)]
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = sorted({x for p in edges for x in p})
    near = {frozenset(p) for p in edges}
    want = linked(nodes, lambda i, j: frozenset((i, j)) in near)
    got = {r.node: r.root for r in S.components(e).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert DOCS
