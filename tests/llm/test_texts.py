import random
import re

import public_tokenizers
import pytest
from helpers import documents, empty, low, sha
from pagelens.llm import bpe, decontam, htmltext, queries, urlfilter
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_marks(text, items):
    w = WORD.findall(low(text or ""))
    hits, found = set(), set()
    for i, t in items:
        v = WORD.findall(low(t or ""))
        n = min(10, len(v))
        spans = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in spans:
                hits |= set(range(k, k + n))
                found.add("" if i is None else str(i))
    return len(w), sorted(hits), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, monkeypatch, block_bytes):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(["Alpha", "beta", "c", "d4", "été", "zz"]) for _ in range(n))
    items = [(1, line(30)), (2, line(12)), (10, line(10)), (3, line(9)), (4, "Only three words"), (5, None), (6, "!!"), (None, line(11)), (2, line(14)), (7, "c c c c c c c c c c c c")]
    texts = [items[0][1][10:150], "x, " + items[1][1].upper() + "; y " + line(20), items[2][1].replace(" ", " - "), line(200) + " " + items[3][1] + " " + line(50),
             "only THREE words only three", "c " * 30, items[7][1], line(3000)]
    d = documents(spark, [(100 + i, t, "en") for i, t in enumerate(texts)] + [(100, texts[0], "en")])
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = decontam.document_marks(d, b, block_bytes=block_bytes).collect()
    want = sorted(((i, *brute_marks(t, items)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, list(r.hits), list(r.items)) for r in got), key=str) == want
    left = decontam.clean_documents(d, b, block_bytes=block_bytes)
    assert left.columns == d.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)
    assert decontam.document_marks(empty(spark), b).count() == 0
    assert decontam.clean_documents(d, b.filter("false")).count() == len(rows)


def test_long_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 7)
    item = " ".join(f"w{i}" for i in range(60))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {item} y"), (2, " ".join(f"w{i}" for i in range(20, 30))), (3, " ".join(f"w{i}" for i in range(20, 29)))], "doc_id long, text string")
    got = {r.doc_id: len(r.hits) for r in decontam.document_marks(d, b).collect()}
    assert got == {1: 60, 2: 10, 3: 0}


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(public_tokenizers.path(queries.VOCABULARY)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))


PARTS = ["a", "b", " ", "  ", "\n", "é", " the", "=", "==", "<|endoftext|>", "0", "12", "!", "...", "'s", "'ll", "'", "\t", "　", "日本", "😀", "\x85", "\xa0", "½", "ß", "ing", "́", "\r\n", "İ", "ª", "\x00", "٣", "aaaa"]


def test_bpe_like_the_library(codec, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15))) for _ in range(5000)]
    texts += ["".join(rng.choice("etaoinshr lü=") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * 50_000, " " * 3001 + "x", "ab" * 20_000, "=" * 5000]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        shown, ids = codec.encode(t)
        assert ids.tolist() == want and shown == ",".join(map(str, want)), t[:80]
        assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_small_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "ARCS", 5)
    c = bpe.Codec(bpe.load(public_tokenizers.path(queries.VOCABULARY)))
    t = "The quick brown fox, the quick brown foxes; unquickly re-quickened." * 3
    assert c.encode(t)[1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_automaton_accepts_canonical_only():
    """Every pair of arcs on a path is one that merging keeps apart."""
    a = bpe.build({"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}, [("a", "a"), ("a", "b"), ("a", "ab")], {})
    assert 4 not in a.out  # a ab never occurs: a a merges first
    assert a.encode_word(b"aab") == [2, 1] and a.encode_word(b"aaab") == [2, 3] and a.encode_word(b"aaaaa") == [2, 2, 0]
    assert not a._arc(0, 0) and not a._arc(0, 2) and a._arc(2, 0) and a._arc(2, 2)


def test_bpe_table(spark, library):
    d = documents(spark, [(50, "x<|endoftext|>y", "en")])
    got = bpe.tokenize(d, queries.vocabulary(), keep_ids=True).collect()
    rows = [(r.doc_id, r.text or "") for r in d.collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256 for r in got)
    assert bpe.tokenize(empty(spark), queries.vocabulary()).count() == 0


PAGES = {
    # furniture around an article, inside it, nested, with character references
    """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>A slogan of the site that is long enough to count as text</p></header>
    <nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><aside><p>Side words that are many and not linked at all here</p></aside>
    <article><header><h2>Head &amp; line</h2></header><p>First&nbsp;para <b>bold</b>
      <a href="x>y">link</a>.<p>Short.<div class="ad">Buy <b>now</b></div><blockquote>Quoted 1 &lt; 2</blockquote><script>var t="</p>";</script>
    <section class="comments"><p>A reader writes a rather long comment here that goes on and on</p></section><form>Your <input> name</form><p>Last one<br>here</article>
    <div class="cookie-notice"><p>We use cookies and tell you so in a long sentence like this one</p></div><footer>&copy; all rights of everybody reserved for ever</footer>""":
    "Head & line\nFirst para bold link.\nShort.\nQuoted 1 < 2\nLast one here",
    "<p>" + "word " * 50 + "</p><div><a href=1>a</a> <a href=2>b</a></div><p>" + "more " * 40: ("word " * 50).strip() + "\n" + ("more " * 40).strip(),
    "<article><p>1 < 2 and <!-- no --> x <? y ?> z</p><textarea><p>no</p></textarea><noscript><p>none</p></noscript></article>": "1 < 2 and x z",
    "": "", None: "", "<div class='menu'>Home": "", "<article>": "", "<article><p title=\"open>text</article>": "text",
}


def test_html(spark):
    tree = htmltext.train()
    for page, want in PAGES.items():
        assert htmltext.main_text(page, tree) == want
    d = spark.createDataFrame([(i, None if i == 1 else "u", p, "c") for i, p in enumerate(PAGES)] + [(None, "u", "x", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(d).collect()}
    for i, want in enumerate(PAGES.values()):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert htmltext.extract(d.filter("false")).count() == 0


PROSE = ["The river rose in the night and by morning the lower fields were under water as far as the mill and the old road",
         "Nobody had seen it as high since the winter of the great frost when the bridge went and two barns were carried off with it",
         "The miller opened the sluices before dawn and stood in the yard with a lamp until the level had begun to fall again at last"]
BODY = "<h2>High water</h2>" + "".join(f"<p>{p}</p>" for p in PROSE)
TEXT = "\n".join(["High water", *PROSE])
LINKS = "<ul><li><a href=1>Home</a><li><a href=2>About us</a><li><a href=3>Contact</a></ul>"
WRAPPED = {
    # names of layouts and of a text's own header are no hint
    f'<div class="container with-sidebar">{BODY}</div>': TEXT,
    f'<div id="no-sidebar">{BODY}</div>': TEXT, f'<div class="has-sidebar">{BODY}</div>': TEXT,
    f'<article><header class="entry-header"><h1>Flood</h1></header>{BODY}</article>': "Flood\n" + TEXT,
    # within a hint words, links and neighbours decide
    f'<div class="sidebar-layout widget">{LINKS}{BODY}<p>Read more here</p>{LINKS}</div>': TEXT,
    f"<form id=aspnet>{LINKS}{BODY}</form>": TEXT,
    f'<div class="related"><h3>See also</h3>{LINKS}<p>Ten more things to read today</p></div>': "",
    f'<div class="related"><article><h3>Other</h3><p>Ten more things to read today</p></article></div>': "",
    # articles do not undo asides and comments
    f"<article>{BODY}</article><aside><article>{BODY}</article></aside>": TEXT,
    f'<article>{BODY}</article><section id="comments"><article><p>{PROSE[0]}</p></article></section>': TEXT,
    f'<article>{BODY}<ol class="comment-list"><li><article class="comment"><p>{PROSE[1]}</p></article></ol></article>': TEXT,
    f'<form><article><p>Short.</p>{BODY}</article></form>': "Short.\n" + TEXT,
    f"<article>{BODY}{LINKS}</article>": TEXT,
}


SHORT = {
    # pages of short paragraphs only
    "<h1>Opening hours</h1><p>We open at nine.</p><p>We close at five.</p>": "Opening hours\nWe open at nine.\nWe close at five.",
    "<nav><a href=a>Home</a></nav><div class=post><p>We open at nine.</p><p>We close at five.</p></div><footer>c 2020</footer>": "We open at nine.\nWe close at five.",
    '<div class="wrapper sidebar-left"><p>A paragraph of some fourteen words that says a little about us and the old mill.</p><ul><li>One item</li><li>Two items</li></ul></div>':
        "A paragraph of some fourteen words that says a little about us and the old mill.\nOne item\nTwo items",
    "<ul><li><a href=1>Home</a><li><a href=2>More</a></ul><p>Closed today.</p>": "Closed today.",
    # pictures and films without an end tag hide nothing behind them
    f"<div><video src=x><p>{PROSE[0]}</p></div><p>{PROSE[1]}</p>": PROSE[0] + "\n" + PROSE[1],
    f"<p>{PROSE[0]}</p><svg><path d=x><p>{PROSE[1]}</p><p>{PROSE[2]}</p></svg>": "\n".join(PROSE),
    f"<div><object data=x></div><p>{PROSE[0]}</p><object><p>instead</p></object><p>{PROSE[1]}</p>": PROSE[0] + "\n" + PROSE[1],
    f"<div><canvas><p>{PROSE[0]}</p></div><p>{PROSE[1]}</p><canvas></canvas>": PROSE[1],
    f"<noscript><div>no</div></noscript><p>{PROSE[1]}</p>": PROSE[1],
    # notices, adverts and teasers go, however long
    f'<p>{PROSE[0]}</p><div class="popup"><p>{PROSE[1]} {PROSE[2]}</p></div><p class="notice">{PROSE[1]} {PROSE[1]}</p><div class="related"><h3>Read more</h3><p>Flood</p></div>': PROSE[0],
    f'<div class="ads-enabled share-ready">{BODY}</div>': TEXT, f'<div class="modal"><main>{BODY}</main></div>': TEXT,
}


def test_html_short_pages_media_and_notices():
    tree = htmltext.train()
    assert {p: htmltext.main_text(p, tree) for p in SHORT} == SHORT


def test_html_furniture_is_a_hint():
    tree = htmltext.train()
    got = {p: htmltext.main_text(p, tree) for p in WRAPPED}
    assert got == WRAPPED


def test_html_is_linear():
    tree = htmltext.train()
    page = "<article>" + "<p>para one two" * 40_000 + "<b a=\"" * 2000
    assert htmltext.main_text(page, tree).count("\n") >= 39_999
    assert htmltext.main_text("<div>" * 30_000 + "x", tree) == "x"
    assert len(htmltext.main_text("<article><p>" + "word " * 400_000, tree)) == 1_999_999
    import time

    start = time.time()
    htmltext.main_text("<div>x" * 50_000 + "</section>" * 100_000 + "<video>" * 50_000 + "</video>", tree)
    assert time.time() - start < 4


def test_html_article_of_the_tables(spark):
    import html

    from pagelens.session import read_table

    p = read_table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in htmltext.extract(p).collect()}
    for r in p.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(x for x in parts if x)
    # without marked articles a few short paragraphs may go, and nothing may come
    tree, lost, total = htmltext.train(), 0, 0
    for r in p.collect():
        bare = htmltext.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), tree).split("\n")
        want = got[r.page_id].split("\n")
        assert not set(bare) - set(want)
        lost, total = lost + len(want) - len(bare), total + len(want)
    assert lost <= 0.002 * total


URLS = {
    "https://A.Example.NET/en/x?q=/de/": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://www.example.net/de/1#f": ("www.example.net", "/de/1", "net/", "block"),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "ftp://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"),
    "http://x.net": ("x.net", "", None, "allow"), "http://x.net?u=://y.org/": ("x.net", "", None, "allow"),
    "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "://h#/fr/": ("h", "", None, "allow"), "http://casino-win.example.org/a": ("casino-win.example.org", "/a", None, "block"),
    "http://cheappillsonline.biz/en/1": ("cheappillsonline.biz", "/en/1", None, "block"),
    "http://citynews.biz/weather": ("citynews.biz", "/weather", None, "allow"),
    "http://" + "q" * 3000 + ".biz/": ("q" * 3000 + ".biz", "/", None, "allow"),
}


def test_urls(spark):
    d = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule string")
    got = urlfilter.judge(d, queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    want = list(URLS.values())
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id % len(want)], r
    words = {r.host: r.host_words for r in got}
    assert words["cheappillsonline.biz"] == ["cheap", "pills", "online", "biz"]
    assert urlfilter.judge(d.filter("false"), queries.URL_RULES).count() == 0


def test_names_on_many_hosts_are_split(spark):
    """A name does not become a word by its subdomains, suffixes or paths."""
    want = {}
    for name, split in (("cheappills", ["cheap", "pills"]), ("casinobonuswin", ["casino", "bonus", "win"])):
        for hosts in ([f"{x}{name}.com" for x in ("", "www.", "m.")], [f"s{i}.{name}.com" for i in range(1000)],
                      [f"{name}.{x}" for x in ("com", "org", "net", "co.uk")], [f"{name}.com"] * 3):
            want |= {h: split for h in hosts}
    rows = [f"http://{h}/" for h in want]
    # in the paths of three and of 300 owners
    rows += [f"http://site{chr(97 + i)}.org/cheappills/" for i in range(3)]
    rows += [f"http://a{chr(97 + i // 20)}{chr(97 + i % 20)}.org/casinobonuswin/zebra" for i in range(300)]
    rows += ["http://zebracheap.org/", "http://user@www.flowers.co.uk:8080/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.host: r for r in urlfilter.judge(d, []).collect()}
    for h, split in want.items():
        name = got[h].host_words[1:] if h.startswith(("www", "m.", "s")) else got[h].host_words
        assert name[: len(split)] == split and got[h].verdict == "block", got[h]
    assert got["zebracheap.org"].host_words == ["zebra", "cheap", "org"]
    assert got["user@www.flowers.co.uk:8080"].host_words == ["user", "www", "flowers", "co", "uk"]
    p, path = urlfilter.host_and_path(d.url)
    counts = {r.word: r.owners for r in urlfilter.unigrams(d.select(p.alias("host"), path.alias("path"))).collect()}
    assert "cheappills" not in counts and "casinobonuswin" not in counts and counts["zebra"] == 300
    owners = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "www.x.com", "x", "", "u@m.y.org:80", "z.net.")], "h string")
    assert [r[0] for r in owners.select(urlfilter.owner(owners.h)).collect()] == ["b", "x", "x", "", "y", "z"]


def test_split_does_not_depend_on_the_size(spark):
    seen = [(w, n) for w in ("zebra", "shop") for n in (10**9,)]
    seeds = [(w, urlfilter.SEED_OWNERS) for w in urlfilter.seeds(urlfilter.TRAINING)]
    counts, total = urlfilter.scaled(spark.createDataFrame(seen + seeds, "word string, owners long").groupBy("word").sum("owners").toDF("word", "owners"))
    known = {r.word: r.owners for r in counts.collect()}
    assert urlfilter.segment("adultpicsblog", known, total) == ["adult", "pics", "blog"]
    assert urlfilter.segment("cheaprx", known, total) == ["cheap", "rx"]


def test_segmentation_is_the_best_split():
    counts = {"a": 5, "ab": 3, "b": 4, "ba": 9, "abc": 1, "c": 2}
    total = sum(counts.values())

    def p(w):
        return counts[w] / total if w in counts else 10 / total / 10 ** len(w)

    def splits(s):
        yield [s]
        for i in range(1, len(s)):
            yield from ([s[:i], *r] for r in splits(s[i:]))

    import math

    for s in ("abc", "abab", "cabba", "xab", "abxxba"):
        best = max(math.prod(map(p, x)) for x in splits(s))
        assert math.isclose(math.prod(map(p, urlfilter.segment(s, counts, total))), best)


def test_urls_that_are_in_no_table(spark):
    """Single strong words decide, words that clean names share do not, and words
    learned from labelled owners decide where no word of the table does."""
    bad = ["freeviagra.com", "pharmacyrx.net", "poker.org", "xanaxnow.com", "gamblinghub.com", "cheappills.com", "casinowin.net"]
    good = ["cheapflights.com", "adultlearning.org", "citylibrary.org", "hotsprings.com", "cashregister.com", "bestbooks.net", "localmuseum.org"]
    # "zorbo" stands in the paths of blocked owners only, "quill" of allowed ones, "page" of both
    shady = [f"casino{x}win.com" for x in ("alpha", "bravo", "delta", "gamma", "omega")]
    decent = [f"library{x}.org" for x in ("alpha", "bravo", "delta", "gamma", "omega")]
    rows = [f"http://{h}/" for h in bad + good] + [f"http://{h}/zorbo/page" for h in shady] + [f"http://{h}/quill/page" for h in decent]
    rows += ["http://zorbo-zone.com/", "http://quill-zone.com/", "http://page-zone.com/"]
    got = {r.host: r.verdict for r in urlfilter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string"), []).collect()}
    assert {h for h in bad + shady if got[h] != "block"} == set()
    assert {h for h in good + decent if got[h] != "allow"} == set()
    assert (got["zorbo-zone.com"], got["quill-zone.com"], got["page-zone.com"]) == ("block", "allow", "allow")
