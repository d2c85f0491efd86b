"""Small tables with every awkward case, and brute-force versions."""
import hashlib
import re

import xxhash

SF = "/root/testdata/sf0.001"

#: Extra columns clash with names that operators use themselves.
DOCS = "doc_id long, text string, lang string, digest string, text_key long, kept boolean, shard int, hits string, row long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(300_000))


def documents(spark, extra=()):
    rows = [
        (1, "One two three four", "en"), (2, "one  two\tthree four", "en"), (3, "One two three four", "en"), (3, "One two three four", "en"),
        (4, None, None), (5, "", "de"), (6, " \n ", "de"), (None, "One two three four", None), (None, None, "fr"),
        (7, "solo", "en"), (8, "a b", "fr"), (9, LONG, "en"), (10, LONG + " end", "en"), (11, "!!! 123 ???", "en"),
        (12, "Ünïcode wörds ÀÉ 日本語 😀 straße", "de"), (13, "x" * 200_000, "en"), *extra]
    return spark.createDataFrame([(*r, "c", 5, True, 3, "h", 9) for r in rows], DOCS)


def empty(spark):
    return documents(spark).filter("false")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def simhash(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(items, near):
    """Smallest member of each item's component, by comparing all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in items:
        for j in items:
            if i < j and near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in items}
