"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the canonical token sequences.  It starts with
one state and an arc for every byte, and one *merge gadget* is applied for each
merge (u, v) -> w, in rank order:

* the state behind ``u`` is split off and loses its arc ``v``, so that ``u``
  can no longer be followed by ``v``;
* every state with an arc ``u`` gets an arc ``w``, which leads to a copy of
  the state behind ``v``.

States are never copied out: the state behind a token stores what it was
copied from and when (the token's right spine), an arc stores what it was
copied from and when (its left spine), and a cut stores its rank.  An arc
exists if no cut met both spines while they were exposed.  Looked-up arcs are
kept in a transition table, so the automaton is deterministic and
table-driven.  A pre-split word has exactly one path; it is found by taking
the longest token that has an arc and stepping back from dead ends.  Decoding
emits the arcs' labels (bytes).

Defined cases: null text is empty (no tokens); special tokens inside a text
are cut out first, as the tokenizers library does; very long words take time
in proportion to their length; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import by_value, small_batches

#: Split pattern of byte-level BPE (fixed value of the public tokenizer).  The
#: alternatives with the same first characters are in the tokenizer's order;
#: letters, which share none with the contractions, are tried first.
SPLIT = " ?{L}+| ?{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
PATTERN = SPLIT.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", s=r"\s")

#: For texts within U+0000..U+00FF the letter, number and space classes are
#: spelled out, so that the plain matcher can be used.
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
LATIN_PATTERN = SPLIT.format(L=f"[{LATIN_LETTER}]", N=f"[{LATIN_NUMBER}]", l=LATIN_LETTER, n=LATIN_NUMBER, s=LATIN_SPACE)

#: Entries of the table of encoded words and of the transition table in a
#: worker; a full table is emptied, which changes nothing but time.
WORDS, ARCS, WORD_BYTES = 200_000, 300_000, 64

#: Ids decoded at once.
BLOCK_IDS = 1 << 16
NEVER = 1 << 60


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.label = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for b, i in vocab.items():
            self.label[i] = b
        for s, i in special.items():
            self.label[i] = s.encode()
        self.special = special
        # Spines: what the state behind a token, or an arc into it, was copied
        # from, each with the rank until which it stays exposed.
        base = {b: i for b, i in vocab.items() if len(b) == 1}
        self.out = {i: ((i, NEVER),) for i in base.values()}
        self.into = {i: ((i, NEVER),) for i in base.values()}
        self.cut: dict[tuple[int, int], int] = {}
        self.token = dict(base)
        for rank, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], rank)
        # Arcs that can be tried at a place: a trie over the labels.
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends = [-1]  # the token that ends at a node
        for b, t in self.token.items():
            node = 0
            for byte in b:
                key = node << 8 | byte
                if key not in self.trie:
                    self.trie[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.trie[key]
            self.ends[node] = t
        # The transition table: known arcs, by the state's token.
        self.known: list[dict[int, bool]] = [{} for _ in self.label]
        self.n_known = 0

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if u not in self.out or v not in self.into or not self._arc(u, v):
            return  # no path u v is left: the merge never applies
        self.cut[u, v] = rank
        if w not in self.out:
            self.out[w] = ((w, NEVER), (v, rank), *self.out[v][1:])
            self.into[w] = ((w, NEVER), (u, rank), *self.into[u][1:])
            self.token[self.label[w]] = w

    def _arc(self, t: int, u: int) -> bool:
        """Whether the state behind ``t`` has an arc ``u``.

        A cut between the spines counts while both ends are exposed.  Merges
        go from left to right, so at its own rank the right end still is.
        """
        cut = self.cut
        for x, until_x in self.out[t]:
            for y, until_y in self.into[u]:
                rank = cut.get((x, y))
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True

    def arc(self, t: int, u: int) -> bool:
        """An entry of the transition table, made when it is first met."""
        if self.n_known >= ARCS:
            self.known, self.n_known = [{} for _ in self.label], 0
        self.n_known += 1
        found = self.known[t][u] = self._arc(t, u)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The accepting path of a pre-split word."""
        trie, token_at, n = self.trie, self.ends, len(word)
        path, stack = [], []  # tokens so far; untried (token, end) of each place
        dead = set()  # places from which the end can't be reached
        at, last = 0, -1
        while at < n:
            node, i, tries = 0, at, []
            while i < n:
                node = trie.get(node << 8 | word[i])
                if node is None:
                    break
                i += 1
                if token_at[node] >= 0:
                    tries.append((token_at[node], i))
            stack.append(tries)
            while True:
                if not stack:
                    raise ValueError("the vocabulary lacks a byte of the text")
                tries = stack[-1]
                row = self.known[last] if last >= 0 else None
                while tries:
                    t, end = tries.pop()
                    if end not in dead:
                        ok = True if row is None else row.get(t)
                        if ok or ok is None and self.arc(last, t):
                            break
                else:  # a place has one canonical path only, so it is dead for good
                    dead.add(at)
                    stack.pop()
                    if path:
                        at -= len(self.label[path.pop()])
                        last = path[-1] if path else -1
                    continue
                break
            path.append(t)
            at, last = end, t
        return path


def load(path: str) -> Automaton:
    """Automaton of a tokenizers JSON file (byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return build(spec["model"]["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]],
                 {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


def build(vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> Automaton:
    of = byte_of_char()
    raw = lambda s: bytes(of[c] for c in s)
    return Automaton({raw(s): i for s, i in vocab.items() if s not in special}, [(raw(a), raw(b)) for a, b in merges], special)


class _Encoded(dict):
    """Word -> (its ids in decimal, joined by commas; its ids as int32 bytes)."""

    def __init__(self, automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word):
        raw = word.encode()
        path = self.automaton.encode_word(raw)
        ids = ",".join(map(str, path)), array("i", path).tobytes()
        if len(raw) <= WORD_BYTES:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, automaton: Automaton):
        import regex

        self.words = _Encoded(automaton)
        self.split, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.special = {s: (str(i), array("i", [i]).tobytes()) for s, i in automaton.special.items()}
        # Longer special tokens win where two begin at one place.
        names = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.labels = np.frombuffer(b"".join(automaton.label), np.uint8)
        self.size = np.array([len(b) for b in automaton.label], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """(ids in decimal joined by commas, ids)."""
        parts = [text] if self.at_special is None else self.at_special.split(text)
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                try:
                    part.encode("latin-1")
                    words = self.split_latin(part)
                except UnicodeEncodeError:
                    words = self.split(part)
                out += map(self.words.__getitem__, words)
        return ",".join([x[0] for x in out]), np.frombuffer(b"".join([x[1] for x in out]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the ids' arcs; bytes that are not UTF-8 become U+FFFD."""
        out = []
        for at in range(0, len(ids), BLOCK_IDS):
            part = ids[at : at + BLOCK_IDS]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.labels[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document and, if
    asked for, its ``ids`` (array<int>) and ``decoded`` text.

    ``vocabulary`` is the path of a tokenizers JSON file on the driver; the
    file's contents (a fixed size) are broadcast, the corpus never is.
    """
    by_value(__name__, textops.__name__)
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    small = (spec["model"]["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]],
             {t["content"]: t["id"] for t in spec.get("added_tokens", [])})
    shared, key = spark.sparkContext.broadcast(small), hashlib.sha256(json.dumps(small).encode()).hexdigest()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        codec = textops.stash(("bpe", key), lambda: Codec(build(*shared.value)))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                shown, ids = codec.encode(text or "")
                raw = codec.decode(ids)
                row = [len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()]
                if keep_ids:
                    row += [ids, raw.decode()]
                rows.append(row)
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", *names])

    return d.mapInArrow(run, schema + (", ids array<int>, decoded string" if keep_ids else ""))
