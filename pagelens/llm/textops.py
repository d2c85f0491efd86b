"""Vectorised text primitives for functions that run inside Spark tasks.

All of them work on whole batches of texts as UTF-8 bytes, in blocks of
``BLOCK`` bytes, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np

#: Bytes hashed at once.
BLOCK = 1 << 20

#: Base of the polynomial hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15

#: Entries kept per worker process in stash().
STASH_ENTRIES = 6


def stash(key, make):
    """``make()`` once per worker process and key; a few entries are kept.

    Functions that travel by value have no lasting globals of their own.
    """
    kept = sys.__dict__.setdefault("_llm_stash", {})
    if key not in kept:
        while len(kept) >= STASH_ENTRIES:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


def _powers():
    def run(x):
        out = np.full(BLOCK + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(np.uint64(BASE)), run(np.uint64(pow(BASE, -1, 1 << 64)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits (multiply-xorshift)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def byte_table(is_word, lower: bool = True) -> bytes:
    """Translation table: bytes outside words become 0, A-Z lower case."""
    t = bytearray(256)
    for b in range(256):
        low = b + 32 if lower and 0x41 <= b <= 0x5A else b
        t[b] = low if is_word(low) else 0
    return bytes(t)


class Words(NamedTuple):
    buf: bytes  # translated texts, one 0 byte behind each
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray  # 64-bit hash of each word
    prefixes: list  # for each asked length: hash of that many first bytes
    first: np.ndarray  # word index at which each text begins, and the total


def words(texts: list[bytes], table: bytes, prefix_bytes: tuple = ()) -> Words:
    """Words of all texts with their hashes, and where each text's words begin."""
    power, inverse = stash("powers", _powers)
    buf = b"".join(t + b"\0" for t in texts).translate(table)
    a = np.frombuffer(buf, np.uint8)
    ss, es, hs, ps = [], [], [], [[] for _ in prefix_bytes]
    at, n = 0, len(buf)
    while at < n:
        stop = min(at + BLOCK, n)
        if stop < n:  # cut behind the last separator, or behind the word that fills the block
            cut = buf.rfind(b"\0", at, stop)
            stop = cut + 1 if cut >= at else buf.find(b"\0", stop) + 1
        x = a[at:stop]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (x != 0).view(np.int8), [0]))))
        s, e = edge[::2], edge[1::2]
        if len(x) > BLOCK:  # one word longer than a block
            h, pre = _long_words(x, s, e, prefix_bytes)
        else:
            p = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * power[: len(x)], out=p[1:])
            h = (p[e] - p[s]) * inverse[s]
            pre = [(p[np.minimum(s + k, e)] - p[s]) * inverse[s] for k in prefix_bytes]
        ss.append(s + at)
        es.append(e + at)
        hs.append(h)
        for out, v in zip(ps, pre):
            out.append(v)
        at = stop
    cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
    starts = cat(ss, np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return Words(buf, starts, cat(es, np.int64), mix(cat(hs, np.uint64)), [mix(cat(v, np.uint64)) for v in ps],
                 np.searchsorted(starts, bounds))


def _long_words(x, starts, ends, prefix_bytes):
    """The same polynomial, block by block within a word."""
    power, _ = stash("powers", _powers)

    def poly(b):
        total, shift = 0, 1
        for i in range(0, len(b), BLOCK):
            part = b[i : i + BLOCK]
            v = int(np.sum(part * power[: len(part)], dtype=np.uint64))
            total = (total + v * shift) & (2**64 - 1)
            shift = shift * pow(BASE, BLOCK, 1 << 64) & (2**64 - 1)
        return total

    h = np.array([poly(x[s:e]) for s, e in zip(starts, ends)], np.uint64)
    pre = [np.array([poly(x[s : min(s + k, e)]) for s, e in zip(starts, ends)], np.uint64) for k in prefix_bytes]
    return h, pre


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (one per start; empty if too few)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + h[j : j + m]
    return mix(out)
