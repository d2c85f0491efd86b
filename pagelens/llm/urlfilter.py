"""URL filter: rules first, then words of the host and a naive Bayes score.

Rules (``net/``, ``example.net/en/``) fit a host and its subdomains when the
url's path starts with the rule's; the longest fitting rule decides.

Otherwise concatenated host names are split into words by a unigram Viterbi
search and the words of host and path are scored by multinomial naive Bayes.
Unigram counts are numbers of *owners* (the label before the public suffix),
not of hosts or pages: however many subdomains, suffixes or pages a name has, it
counts once, and it is no evidence for itself.  Counts come from all urls, plus
the words of the small labelled table ``TRAINING``.  A name that many owners
write in their paths is still no word if it splits into known words, and the
seen counts are scaled to a fixed weight, so splits do not depend on the table's
size.  Words and distinct name pieces meet the counts by a join on their
substrings, which is broadcast only when the counts are few; scores return to
the pages by a join on the host with skew splitting, after hosts were made
distinct.

The words of ``TRAINING`` are only where it starts: owners whose words speak
clearly against or for them label all other words of their names and of their hosts' paths, and
words that ``MIN_OWNERS`` labelled owners use get weights of their own, which
score hosts (words of both kinds of owners weigh nothing).

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule fits, and no word speaks against it (allow); repeated rows get equal rows;
very long names are split in linear time; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_value, maybe_broadcast, small_batches, stored

#: Hand-labelled names: words of hosts and paths to block and to allow.
TRAINING = {
    "block": [
        "casino win", "casino bonus free spins", "online casino jackpot", "best casino slots win", "casino poker bet",
        "cheap pills", "cheap pills online pharmacy", "buy cheap viagra pills", "discount pills rx", "cheap meds pills store",
        "adult x", "adult xxx video", "adult pics blog", "hot adult pics", "spam blog comments", "adult cams x live", "adult dating sex", "xxx porn adult tube",
        "spam farm", "spam links farm", "link farm seo spam", "spam bulk mail", "content farm spam clicks",
        "replica watches cheap", "payday loan fast cash", "free crack keygen warez", "hacked accounts cheap", "escort adult",
        "ads track", "ads tracker click", "track ads banner", "free bets", "bets odds betting", "bets win casino",
        "viagra cialis xanax pills", "xanax valium rx", "pharmacy rx meds", "poker gambling casino", "gambling slots roulette", "nude porn sex",
    ],
    "allow": [
        "news daily", "city news today", "weather report", "blog travel", "blog cooking food", "health clinic", "public library",
        "school science", "university physics", "research open data", "music review", "film review blog", "garden plants",
        "sports league", "football club", "history museum", "art gallery", "local council", "software docs", "python tutorial",
        "wiki pages", "forum talk", "photo album", "house design", "book store", "bank savings", "online shop", "game news",
        "free software", "video lessons", "live concert", "web mail", "farm museum",
        "cheap flights", "cheap hotels travel", "adult learning", "adult education courses", "free recipes", "fast cars", "cash register",
        "online courses", "best books", "hot springs", "city pharmacy", "track and field", "link road",
    ],
}
#: Log prior odds against a url: a url is blocked only on evidence.
PRIOR = math.log(0.2 / 0.8)
#: A piece counts as a word if it occurs in at most so long a form, with at least
#: so many owners; words of TRAINING count as SEED_OWNERS owners.
MAX_WORD, MIN_OWNERS, SEED_OWNERS = 24, 3, 50
#: Other words that a word may be made of have at least so many letters.
MIN_PART = 3
#: All seen words together weigh at most so many owners.
SEEN_WEIGHT = 10_000
#: Smoothing of the labelled counts: a word of one side only says much.
SMOOTH = 0.1
#: Log odds from which an owner labels its words, and the most that a learned word weighs.
CLEAR, LEARNED = math.log(4), 2.0
#: Hosts (with their words) that may be broadcast to the pages.
BROADCAST_HOSTS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def owner(host: Column) -> Column:
    """The label before the public suffix: the last label, or a general label
    (``co``, ``com``, ...) and a country's."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(?::\d*)?\.?$", "")
    return F.regexp_extract(name, r"(?:^|\.)([^.]++)(?:\.(?:ac|co|com|edu|gob|gov|gv|ne|net|or|org)\.[a-z]{2}|\.[^.]++)?$", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def naive_bayes(training: dict[str, list[str]] = TRAINING) -> dict[str, float]:
    """Log odds against each known word (additive smoothing); single letters
    say nothing about a name."""
    n = {k: Counter(w for text in v for w in text.split() if len(w) > 1) for k, v in training.items()}
    known = set(n["block"]) | set(n["allow"])
    total = {k: sum(c.values()) + SMOOTH * len(known) for k, c in n.items()}
    return {w: math.log((n["block"][w] + SMOOTH) / total["block"]) - math.log((n["allow"][w] + SMOOTH) / total["allow"]) for w in sorted(known)}


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``name`` under unigram ``counts`` (Viterbi);
    an unknown word's probability falls by ten with each letter."""
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get(name[start:end])
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(c), F.lit(r"([a-z]+)"), F.lit(1))


def seeds(training: dict[str, list[str]]) -> list[str]:
    return sorted({w for v in training.values() for t in v for w in t.split()})


def is_compound(word: str, known) -> bool:
    """Whether ``word`` is a row of two or more of the ``known`` words."""
    reached = [True] + [False] * len(word)
    for end in range(1, len(word) + 1):
        reached[end] = any(reached[start] and end - start < len(word) and word[start:end] in known for start in range(end))
    return reached[-1]


def _with_known(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words): each distinct piece with its substrings that are words
    and their counts; linear in the piece's length."""
    starts = F.sequence(F.lit(1), F.length("piece"))
    sub = names.select("piece", F.explode(starts).alias("s")).select(
        "piece", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("piece") - F.col("s") + 1, F.lit(MAX_WORD))),
                                       lambda n: F.substring(F.col("piece"), F.col("s"), n))).alias("word")).distinct()
    return sub.join(maybe_broadcast(counts), "word", "left").groupBy("piece").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("owners").isNotNull(), F.struct("word", "owners")))).alias("words"))


def unigrams(pages: DataFrame, training: dict[str, list[str]] = TRAINING) -> DataFrame:
    """(word, owners): with how many owners each word occurs in the names or
    paths of their hosts; a word that is the owner's whole label is not counted
    there.  Words made of other words are left out, those of ``training`` stay."""
    # Parts of a compound that are compounds themselves have parts in turn, so
    # one pass over all seen words finds every compound.
    seen = pages.select(owner(F.col("host")).alias("owner"), F.explode(F.array_distinct(F.concat(_pieces(F.col("host")), _pieces(F.col("path"))))).alias("word"))
    seen = seen.filter(F.length("word").between(2, MAX_WORD) & (F.col("word") != F.col("owner"))).distinct().groupBy("word").agg(
        F.count("*").alias("owners")).filter(F.col("owners") >= MIN_OWNERS)
    seen = stored(seen)
    first = pages.sparkSession.createDataFrame([(w, SEED_OWNERS) for w in seeds(training)], "word string, owners long")
    parts = seen.filter(F.length("word") >= MIN_PART).unionByName(first.filter(F.length("word") > 1)).groupBy("word").agg(
        F.sum("owners").alias("owners"))
    found = _with_known(seen.join(F.broadcast(first), "word", "left_anti").select(F.col("word").alias("piece")), parts)

    def run(batches):
        for b in batches:
            words = b.column("piece").to_pylist()
            made = [is_compound(w, dict(k)) for w, k in zip(words, b.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, m in zip(words, made) if m], pa.string())], ["word"])

    words = seen.join(found.mapInArrow(run, "word string"), "word", "left_anti")
    return words.unionByName(first).groupBy("word").agg(F.sum("owners").alias("owners"))


def scaled(counts: DataFrame, training: dict[str, list[str]] = TRAINING) -> tuple[DataFrame, float]:
    """The counts with those of seen words scaled to ``SEEN_WEIGHT`` together,
    but at least 1 each, and the total."""
    first = SEED_OWNERS * len(seeds(training))
    of_seen = counts.agg(F.sum("owners")).first()[0] - first
    rate = min(1.0, SEEN_WEIGHT / max(1, of_seen))
    base = F.when(F.col("word").isin(*seeds(training)), F.lit(SEED_OWNERS)).otherwise(F.lit(0))
    weight = base + F.when(F.col("owners") > base, F.greatest(F.lit(1.0), (F.col("owners") - base) * rate)).otherwise(F.lit(0.0))
    return counts.select("word", weight.alias("owners")), float(first + of_seen * rate)


def host_scores(pages: DataFrame, training: dict[str, list[str]] = TRAINING) -> DataFrame:
    """(host, host_words, host_score) of every distinct host."""
    by_value(__name__)
    small_batches(pages.sparkSession)
    hosts = pages.select("host").distinct()
    of = hosts.select("host", F.posexplode(_pieces(F.col("host"))).alias("at", "piece"))
    counts, total = scaled(stored(unigrams(pages, training)), training)
    weights = naive_bayes(training)
    found = _with_known(of.select("piece").distinct(), counts)

    def run(batches):
        for b in batches:
            rows = [segment(p, dict(w), total) for p, w in zip(b.column("piece").to_pylist(), b.column("words").to_pylist())]
            score = [sum(weights.get(w, 0.0) for w in r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(rows, pa.list_(pa.string())), pa.array(score, pa.float64())],
                                             ["piece", "words", "score"])

    split = found.mapInArrow(run, "piece string, words array<string>, score double")
    return of.join(maybe_broadcast(split), "piece").groupBy("host").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"),
        F.sum("score").alias("host_score"))


def learned(pages: DataFrame, hosts: DataFrame, training: dict[str, list[str]] = TRAINING) -> DataFrame:
    """(word, weight) of words that are not in ``training``, from the owners that
    its words label: log odds of the share of blocked and of allowed owners that use the word."""
    of = owner(F.col("host"))
    words = hosts.select(of.alias("owner"), F.explode(F.array_distinct("host_words")).alias("word")).unionByName(
        pages.select(of.alias("owner"), F.explode(F.array_distinct(_pieces(F.col("path")))).alias("word"))).filter(
        (F.col("owner") != "") & F.length("word").between(2, MAX_WORD)).distinct()
    ends = hosts.select(F.explode(_pieces(F.regexp_extract("host", r"((?:\.[^.]{2,3})?\.[^.]*)$", 1))).alias("word")).distinct()
    words = words.join(ends, "word", "left_anti")  # public suffixes say nothing
    known = naive_bayes(training)
    first = pages.sparkSession.createDataFrame(sorted(known.items()), "word string, w double")
    words = stored(words.join(F.broadcast(first), "word", "left"))
    label = F.sum(F.coalesce("w", F.lit(0.0)))
    owners = words.groupBy("owner").agg(label.alias("s")).select("owner", F.when(F.col("s") >= CLEAR, 1).when(F.col("s") < 0, 0).alias("bad")).filter("bad is not null")
    owners = stored(owners)
    n = owners.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("every")).first()
    bad, good = n.bad, n.every - n.bad
    per = words.filter("w is null").join(owners, "owner").groupBy("word").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
    odds = F.log((F.col("b") + 0.5) / float(bad + 1)) - F.log((F.col("g") + 0.5) / float(good + 1))
    weight = F.greatest(F.lit(-LEARNED), F.least(F.lit(LEARNED), odds))
    enough = (F.col("b") + F.col("g") >= MIN_OWNERS) & F.lit(min(bad, good) >= MIN_OWNERS)
    return per.filter(enough).select("word", weight.alias("weight")).filter(F.abs("weight") >= 0.5)


def with_learned(hosts: DataFrame, more: DataFrame) -> DataFrame:
    """``hosts`` with the weights of learned words in their score."""
    extra = hosts.select("host", F.explode("host_words").alias("word")).join(maybe_broadcast(more), "word").groupBy("host").agg(F.sum("weight").alias("extra"))
    return hosts.join(extra, "host", "left").select("host", "host_words", (F.col("host_score") + F.coalesce("extra", F.lit(0.0))).alias("host_score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          training: dict[str, list[str]] = TRAINING) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, host_words) of every page;
    ``score`` is the log odds against the url."""
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    weights = F.create_map(*[F.lit(x) for kv in naive_bayes(training).items() for x in kv])
    of_path = F.aggregate(_pieces(F.col("path")), F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
    # Stored, so that beyond the bound both sides are dealt anew and a hot
    # host's pages can be split.
    hosts = stored(host_scores(p, training))
    hosts = stored(with_learned(hosts, stored(learned(p, hosts, training))))
    j = p.join(maybe_broadcast(hosts, BROADCAST_HOSTS), "host", "left")
    score = F.lit(PRIOR) + F.coalesce("host_score", F.lit(0.0)) + of_path
    j = j.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("r"), score.alias("score"),
                 F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
    return j.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "host_words")
