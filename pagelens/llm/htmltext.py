"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks.  Each block
is described by its word count and link density, those of its neighbours, and
what it stands in (article, heading, and how much speaks for page furniture).
A decision tree, trained on the small hand-labelled table ``LABELLED``, keeps or
drops it.

Furniture has grades: ``SOFT`` (a form or header element), ``HINT`` (a class, id
or role that may name furniture), ``NAMED`` (one that names notices, adverts and
the like) and ``FIRM`` (nav, aside, footer and the like, comments).  Within SOFT
and HINT the tree decides by words, links and neighbours, from NAMED on nothing
stays.  An article starts anew within SOFT, a main element up to NAMED, none
within FIRM.  Names of layouts and of an article's own header do not count.

What is long depends on the page: the tree also sees the longest text of a page that
is not in furniture, so that a page of short paragraphs keeps them.

Defined cases: null and empty html give an empty text; unclosed and stray tags
are tolerated (a picture or film without an end tag hides no text: it ends with
the element around it, or at once if no end tag follows at all); very long pages take time in proportion to their length;
repeated rows get equal rows; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, small_batches

#: Elements that end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split())
#: Their text is no text of the page.
SILENT = frozenset("script style noscript template title textarea iframe object svg math canvas audio video noembed noframes xmp".split())
#: Of these, everything up to the end tag is text whatever it looks like.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Page furniture by element, and by words of class, id or role.
SOFT, HINT, NAMED, FIRM = 1, 2, 2.9, 3
FURNITURE = frozenset("nav footer aside menu dialog button select".split())
#: Readers' comments.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment[_-]\w+|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Names of layouts (with-sidebar) and of a text's own header (entry-header).
LAYOUT = re.compile(
    r"(?<!\S)(?:(?:[\w]+[_-]+)?(?:with|has|no|without|hide|hidden|show)[_-]+[\w-]+|(?:content[_-]+sidebar|sidebar[_-]+content)[\w-]*|"
    r"(?:\w+[_-]+)?(?:entry|post|article|page|section|story|content|title|heading)[_-]+header|"
    r"[\w-]+[_-]+(?:enabled|disabled|ready|loaded|support\w*))(?!\S)", re.I)
#: A container that is laid out around a sidebar on one side.
WRAPPER = re.compile(r"(?<!\S)(?:[\w-]*[_-])?(?:wrapper|wrap|container|layout|site|row|grid|main|content)(?:[_-][\w-]*)?(?!\S)", re.I)
SIDE = re.compile(r"(?<!\S)(?:sidebar[_-]+(?:left|right|first|second|both|none)|(?:left|right|one|two|both)[_-]+sidebars?)(?!\S)", re.I)
NAMED_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|breadcrumbs?|cookies?|consent|login|modal|newsletter|notices?|pagination|popup|promo\w*|related|share\w*|"
    r"sharing|signup|sponsor\w*|subscribe)(?:$|[\s_-])", re.I)
FURNITURE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment\w*|complementary|contentinfo|cookies?|consent|disqus|footer|"
    r"header|login|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|search|share\w*|"
    r"sharing|sidebar|signup|social|sponsor\w*|subscribe|teaser|toolbar|widget)(?:$|[\s_-])", re.I)
#: A start of these ends an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<!--|<([/]?)([A-Za-z][^\s/>\x00]*)|<[!?/]")
#: Rest of a tag; quoted values may hold ``>``.
REST = re.compile(r"""(?>[^>"']|"[^"]*"|'[^']*')*>""")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: float  # share of the words inside links
    article: bool
    furniture: float  # 0, SOFT, HINT, NAMED or FIRM
    heading: bool


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    # Open block elements: (tag, inside an article, furniture around it), and the places of each tag's.
    stack: list[tuple[str, bool, float]] = [("", False, 0)]
    places: dict[str, list[int]] = {}
    text, in_link, silent, silent_tag, heading = [], False, 0, "", False
    hidden: dict[str, int] = {}  # block elements opened within a silent one
    last_end: dict[str, int] = {}  # where the last end tag of a silent element is

    def shut(to):
        while len(stack) > to:
            places[stack.pop()[0]].pop()

    def ends_later(tag, at):
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return last_end[tag] >= at

    def add(s):
        if s and not silent:
            text.append((s, in_link))

    def flush():
        if text:
            whole = " ".join(entities.unescape("".join(s for s, _ in text)).split())
            if whole:
                n = whole.count(" ") + 1
                linked = sum(len(entities.unescape(s).split()) for s, a in text if a)
                _, article, furniture = stack[-1]
                out.append(Block(whole, n, min(1.0, linked / n), article, furniture, heading))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if not m[2]:  # doctype, processing instruction or bogus comment
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = REST.match(page, m.end())
        if not rest:  # an open quote: the tag ends at the next >
            end = page.find(">", m.end())
            end = n if end < 0 else end + 1
        else:
            end = rest.end()
        tag, closing, attrs, at = m[2].lower(), bool(m[1]), page[m.end() : max(m.end(), end - 1)], end
        if silent:
            if tag == silent_tag:
                silent += -1 if closing else not attrs.endswith("/")
                continue
            if tag not in BLOCK_TAGS or tag in VOID:
                continue
            if not closing and silent_tag not in ("svg", "math"):  # a block ends these two
                hidden[tag] = hidden.get(tag, 0) + 1
                continue
            if closing and (hidden.get(tag) or not places.get(tag) and tag not in ("body", "html")):
                hidden[tag] = max(0, hidden.get(tag, 0) - 1)
                continue
            silent = 0  # the element around it ends, or a block begins
        if tag in SILENT:
            if not closing and not attrs.endswith("/") and ends_later(tag, at):
                if tag in BLOCK_TAGS:
                    flush()
                if tag in RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                    at = stop.start() if stop else n
                    if stop:
                        close = page.find(">", at)
                        at = n if close < 0 else close + 1
                else:
                    silent, silent_tag = 1, tag
                    hidden.clear()
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if closing:
                heading = False
                if places.get(tag):
                    shut(places[tag][-1])
                    in_link = False
                continue
            heading = tag in HEADINGS
            if stack[-1][0] == "p" or tag in SELF_CLOSING and stack[-1][0] == tag:
                shut(len(stack) - 1)
            if tag not in VOID and not (tag in ("html", "body", "head")):
                _, article, furniture = stack[-1]
                words = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs)) if attrs else ""
                words = LAYOUT.sub(" ", words)
                words = SIDE.sub(" ", words) if WRAPPER.search(words) else words
                named = FIRM if COMMENTS.search(words) else NAMED if NAMED_WORD.search(words) else HINT if FURNITURE_WORD.search(words) else 0
                if named or tag in FURNITURE:
                    furniture = max(furniture, named, FIRM * (tag in FURNITURE))
                elif tag in ("article", "main"):
                    article, furniture = True, furniture if furniture > (SOFT if tag == "article" else NAMED) else 0
                elif tag == "form" or tag == "header" and not article:
                    furniture = max(furniture, SOFT)
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, article, furniture))
    flush()
    return out


#: Labelled blocks: words, linked, words and linked of the block before and
#: after, in article, furniture grade, heading -> main text?  (0 words: no block)
#: Where a page's longest text is short, its words outside links stand behind the label.
LABELLED = [
    # pages of short texts only: what is no link stays
    (2, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, 1, 4), (4, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 1, 4), (4, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1, 4),
    (3, 0.0, 2, 1.0, 5, 0.0, 0, 0, 1, 1, 6), (5, 0.0, 3, 0.0, 6, 0.0, 0, 0, 0, 1, 6), (6, 0.0, 5, 0.0, 2, 1.0, 0, 0, 0, 1, 6),
    (14, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 1, 14), (3, 0.0, 14, 0.0, 2, 0.0, 0, 0, 0, 1, 14), (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1, 14),
    (9, 0.0, 2, 1.0, 8, 0.0, 0, 0, 0, 1, 9), (8, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 1, 9), (1, 0.0, 0, 0.0, 3, 0.0, 0, 0, 1, 1, 3),
    (2, 0.0, 1, 0.0, 2, 0.0, 0, 0, 0, 1, 2), (12, 0.1, 4, 0.0, 11, 0.0, 0, 0, 0, 1, 12), (4, 0.0, 12, 0.0, 3, 1.0, 0, 0, 0, 1, 12),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 4), (1, 1.0, 2, 1.0, 3, 0.0, 0, 0, 0, 0, 5), (3, 1.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0, 5),
    (5, 1.0, 4, 0.0, 6, 0.0, 0, 0, 0, 0, 6), (2, 1.0, 14, 0.0, 1, 1.0, 0, 0, 0, 0, 14), (6, 0.8, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 9),
    # the only text of a page
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 9), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1, 3),
    (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 30), (4, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    # pages without marked articles: long text with few links stays
    (55, 0.0, 4, 0.0, 60, 0.0, 0, 0, 0, 1), (35, 0.1, 40, 0.0, 25, 0.0, 0, 0, 0, 1), (90, 0.05, 3, 1.0, 50, 0.0, 0, 0, 0, 1),
    (20, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 1), (12, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1), (18, 0.0, 80, 0.0, 4, 1.0, 0, 0, 0, 1),
    (6, 0.0, 70, 0.0, 60, 0.0, 0, 0, 0, 1), (30, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 1),
    (5, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1, 1), (3, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1), (2, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1),
    # ... text among links and linked text goes, short text among text stays
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (20, 0.9, 40, 0.0, 18, 0.9, 0, 0, 0, 0),
    (6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (3, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0, 1), (30, 0.8, 25, 0.7, 50, 0.0, 0, 0, 0, 0),
    (8, 0.5, 5, 0.0, 6, 1.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (7, 0.0, 12, 0.6, 4, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0), (10, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (4, 0.0, 5, 0.0, 3, 0.0, 0, 0, 1, 1),
    (2, 1.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0), (1, 1.0, 80, 0.0, 60, 0.0, 0, 0, 0, 0), (3, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (6, 1.0, 0, 0.0, 70, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 50, 0.0, 0, 0, 1, 0), (25, 1.0, 70, 0.0, 70, 0.0, 0, 0, 0, 0),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 1), (2, 0.0, 90, 0.0, 2, 0.0, 0, 0, 0, 1), (1, 0.0, 3, 0.0, 70, 0.0, 0, 0, 0, 1),
    (8, 0.0, 9, 0.0, 10, 0.0, 0, 0, 0, 1), (15, 0.0, 8, 0.0, 4, 0.0, 0, 0, 0, 1), (1, 0.0, 1, 0.0, 5, 0.0, 0, 0, 0, 1),
    (13, 0.0, 31, 0.0, 1, 0.0, 0, 0, 0, 1), (7, 0.0, 250, 0.0, 4, 0.0, 0, 0, 0, 1), (11, 0.0, 19, 0.0, 36, 0.0, 0, 0, 0, 1),
    (10, 0.0, 140, 0.0, 25, 0.0, 0, 0, 0, 1), (14, 0.0, 7, 0.0, 90, 0.0, 0, 0, 0, 1), (9, 0.0, 44, 0.0, 130, 0.0, 0, 0, 0, 1),
    (31, 0.0, 5, 0.0, 1, 0.0, 0, 0, 0, 1), (13, 0.0, 4, 0.0, 1, 0.0, 0, 0, 0, 1), (118, 0.0, 1, 0.0, 4, 0.0, 0, 0, 0, 1),
    (8, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 1), (42, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 1), (6, 0.0, 2, 0.0, 1, 0.0, 0, 0, 0, 1),
    (3, 0.0, 100, 0.0, 4, 1.0, 0, 0, 0, 1), (2, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 1), (13, 0.0, 5, 0.0, 12, 0.0, 0, 0, 0, 1),
    # ... the last of some paragraphs stays
    (24, 0.0, 28, 0.0, 0, 0.0, 0, 0, 0, 1), (25, 0.0, 25, 0.0, 3, 1.0, 0, 0, 0, 1), (21, 0.0, 23, 0.0, 5, 0.0, 0, 0, 0, 1),
    (24, 0.1, 26, 0.0, 2, 1.0, 0, 1, 0, 1), (23, 0.0, 25, 0.0, 4, 0.0, 0, 2, 0, 1), (22, 0.0, 45, 0.0, 1, 1.0, 0, 2, 0, 1),
    # in an article: paragraphs, list items, headings, quotations, short lines
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (8, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1, 1), (1, 0.0, 70, 0.0, 50, 0.0, 1, 0, 0, 1),
    (2, 0.0, 8, 0.0, 2, 0.0, 1, 0, 0, 1), (45, 0.05, 8, 0.0, 2, 0.0, 1, 0, 0, 1), (120, 0.0, 45, 0.05, 30, 0.2, 1, 0, 0, 1),
    (3, 0.0, 2, 1.0, 14, 0.0, 1, 0, 0, 1), (14, 0.3, 3, 0.0, 2, 0.0, 1, 0, 0, 1), (4, 0.0, 90, 0.0, 10, 1.0, 1, 0, 0, 1),
    (6, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (3, 0.0, 5, 0.0, 6, 0.0, 1, 0, 0, 1), (5, 0.4, 6, 0.0, 4, 0.3, 1, 0, 0, 1),
    (7, 0.0, 40, 0.0, 25, 0.0, 1, 0, 1, 1), (2, 0.0, 3, 1.0, 3, 1.0, 1, 0, 1, 1), (12, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1),
    (4, 1.0, 2, 0.0, 45, 0.0, 1, 0, 1, 1), (9, 0.0, 0, 0.0, 4, 1.0, 1, 0, 0, 1), (30, 0.5, 20, 0.0, 12, 0.4, 1, 0, 0, 1),
    (6, 0.0, 40, 0.0, 3, 1.0, 1, 0, 0, 1), (10, 0.0, 50, 0.0, 45, 0.0, 1, 0, 0, 1), (10, 0.1, 60, 0.0, 5, 0.0, 1, 0, 0, 1),
    (3, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 1), (15, 0.2, 35, 0.0, 4, 0.0, 1, 0, 0, 1), (11, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 1),
    (2, 0.0, 55, 0.0, 2, 1.0, 1, 0, 0, 1), (9, 0.0, 33, 0.0, 60, 0.0, 1, 0, 1, 1), (5, 0.0, 25, 0.0, 12, 0.5, 1, 0, 0, 1),
    (25, 0.0, 25, 0.0, 2, 0.0, 1, 0, 0, 1), (26, 0.0, 24, 0.0, 0, 0.0, 1, 0, 0, 1), (60, 0.0, 70, 0.0, 2, 0.0, 1, 0, 0, 1),
    (3, 0.0, 60, 0.0, 2, 0.0, 1, 0, 0, 1), (8, 0.1, 70, 0.0, 1, 0.0, 1, 0, 0, 1), (30, 0.0, 2, 0.0, 1, 1.0, 1, 0, 0, 1),
    (70, 0.0, 62, 0.0, 3, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0.0, 50, 0.0, 1, 0, 0, 1), (10, 0.0, 80, 0.0, 2, 0.0, 1, 0, 0, 1),
    (17, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 1), (1, 0.0, 26, 0.0, 3, 0.0, 1, 0, 0, 1), (20, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 1),
    # ... but for rows of links: tags, sections, share buttons
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 60, 0.0, 1, 1.0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 1, 0, 0, 0),
    (4, 1.0, 1, 1.0, 0, 0.0, 1, 0, 0, 0), (6, 1.0, 5, 1.0, 3, 1.0, 1, 0, 0, 0),
    # in a form or header element: long texts of few links, and what leads to them, stay
    (40, 0.0, 6, 0.0, 60, 0.0, 0, 1, 0, 1), (80, 0.1, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (28, 0.0, 3, 1.0, 50, 0.0, 0, 1, 0, 1),
    (55, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 1), (15, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1), (5, 0.0, 2, 1.0, 60, 0.0, 0, 1, 1, 1),
    (7, 0.0, 50, 0.0, 45, 0.0, 0, 1, 1, 1), (4, 0.0, 65, 0.0, 50, 0.0, 0, 1, 0, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 0), (1, 0.0, 0, 0.0, 14, 0.0, 0, 1, 1, 0), (14, 0.0, 1, 0.0, 1, 1.0, 0, 1, 0, 0),
    (12, 0.0, 2, 0.0, 3, 1.0, 0, 1, 0, 0), (3, 1.0, 50, 0.0, 2, 1.0, 0, 1, 0, 0), (30, 0.9, 4, 1.0, 40, 0.0, 0, 1, 0, 0),
    (2, 0.0, 10, 0.0, 4, 0.0, 1, 1, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 1, 1, 0), (16, 0.0, 4, 0.0, 6, 0.0, 0, 1, 0, 0),
    # in a container whose name is one of furniture: the same
    (60, 0.0, 5, 0.0, 45, 0.0, 0, 2, 0, 1), (45, 0.1, 60, 0.0, 30, 0.0, 0, 2, 0, 1), (30, 0.0, 2, 1.0, 55, 0.0, 0, 2, 0, 1),
    (90, 0.05, 3, 1.0, 2, 1.0, 0, 2, 0, 1), (18, 0.0, 50, 0.0, 40, 0.0, 0, 2, 0, 1), (6, 0.0, 3, 1.0, 60, 0.0, 0, 2, 1, 1),
    (8, 0.0, 45, 0.0, 50, 0.0, 0, 2, 1, 1), (3, 0.0, 70, 0.0, 60, 0.0, 0, 2, 0, 1), (50, 0.0, 40, 0.0, 60, 0.0, 1, 2, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 0), (2, 0.0, 3, 0.0, 14, 0.0, 1, 2, 0, 0), (13, 0.0, 3, 0.0, 8, 0.0, 0, 2, 0, 0),
    (5, 0.0, 4, 0.0, 6, 0.0, 0, 2, 0, 0), (9, 0.0, 2, 1.0, 50, 0.0, 0, 2, 0, 0), (8, 0.0, 3, 1.0, 9, 0.0, 0, 2, 0, 0),
    (16, 0.0, 6, 1.0, 5, 0.0, 0, 2, 0, 0), (3, 1.0, 60, 0.0, 50, 0.0, 0, 2, 0, 0), (40, 0.9, 30, 0.8, 3, 1.0, 0, 2, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 2, 1, 0), (25, 0.7, 6, 1.0, 40, 0.0, 0, 2, 0, 0), (15, 0.0, 60, 0.0, 4, 1.0, 0, 2, 0, 0),
    (10, 0.0, 6, 0.0, 50, 0.0, 1, 2, 0, 0), (6, 0.0, 60, 0.0, 0, 0.0, 0, 2, 0, 0), (11, 0.0, 1, 1.0, 40, 0.0, 0, 2, 0, 0),
    (24, 0.0, 2, 0.0, 25, 0.0, 0, 2, 0, 1), (25, 0.0, 24, 0.0, 26, 0.0, 0, 2, 0, 1), (22, 0.0, 30, 0.0, 3, 0.0, 0, 2, 0, 1),
    (26, 0.1, 25, 0.0, 3, 1.0, 0, 1, 0, 1), (2, 0.0, 3, 1.0, 24, 0.0, 0, 2, 1, 1), (3, 0.0, 1, 1.0, 22, 0.0, 0, 1, 1, 1),
    (23, 0.0, 4, 0.0, 28, 0.0, 0, 1, 0, 1), (21, 0.0, 24, 0.0, 20, 0.0, 0, 2, 0, 1), (5, 0.0, 26, 0.0, 23, 0.0, 0, 2, 1, 1),
    (5, 0.0, 2, 1.0, 20, 0.0, 0, 2, 0, 0), (7, 0.0, 1, 1.0, 30, 0.0, 0, 2, 0, 0), (2, 0.0, 3, 1.0, 40, 0.0, 0, 2, 0, 0),
    (20, 0.0, 4, 0.0, 6, 0.0, 0, 2, 0, 0), (24, 0.0, 3, 1.0, 2, 1.0, 0, 2, 0, 0), (3, 0.0, 25, 0.0, 1, 1.0, 0, 2, 0, 0),
    (4, 0.0, 26, 0.0, 3, 0.0, 0, 1, 0, 0), (22, 0.0, 5, 0.0, 3, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 24, 0.0, 0, 2, 0, 0),
    # in navigation, asides, footers, dialogs and comments nothing stays
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 3, 0, 0), (60, 0.0, 4, 0.0, 50, 0.0, 0, 3, 0, 0), (90, 0.0, 60, 0.0, 70, 0.0, 1, 3, 0, 0),
    (25, 0.1, 2, 1.0, 30, 0.0, 0, 3, 0, 0), (5, 0.0, 40, 0.0, 50, 0.0, 0, 3, 1, 0), (14, 0.0, 3, 0.0, 2, 0.0, 1, 3, 0, 0),
    (11, 0.0, 2, 1.0, 6, 0.0, 0, 3, 0, 0), (8, 0.0, 13, 0.0, 0, 0.0, 0, 3, 0, 0), (40, 0.9, 8, 0.0, 0, 0.0, 0, 3, 0, 0),
    (50, 0.0, 3, 1.0, 2, 1.0, 1, 3, 0, 0), (70, 0.0, 5, 0.0, 3, 0.0, 0, 3, 0, 0), (38, 0.0, 2, 0.0, 1, 1.0, 0, 3, 0, 0),
    (24, 0.0, 25, 0.0, 25, 0.0, 0, 3, 0, 0), (55, 0.1, 2, 1.0, 4, 0.0, 1, 3, 0, 0), (3, 0.0, 2, 1.0, 24, 0.0, 0, 3, 1, 0),
    (4, 0.0, 60, 0.0, 70, 0.0, 1, 3, 1, 0), (1, 0.0, 0, 0.0, 0, 0.0, 0, 3, 0, 0), (120, 0.0, 90, 0.0, 0, 0.0, 0, 3, 0, 0),
]


def grow(rows: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: a label, or (feature, cut, low, high)."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut), low
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1)


def features(words, linked, b_words, b_linked, a_words, a_linked, article, furniture, heading, longest) -> tuple:
    """What the tree sees of a labelled or found block: the words outside links
    of its neighbours, of the richer and of the poorer one, besides its own, and
    whether it has neighbours at all.  Where it stands is one scale from an
    article to firm furniture; last, the words outside links of the page's longest text."""
    before, after = b_words * (1 - b_linked), a_words * (1 - a_linked)
    return words, linked, words * (1 - linked), before, after, max(before, after), min(before, after), b_words + a_words > 0, 0 if article and not furniture else 1 + furniture, heading, longest


def train(labelled: list[tuple] = LABELLED):
    # a page has longer texts than the labelled ones, unless it is said how long they are
    return grow(np.array([(*features(*row[:9], row[10] if len(row) > 10 else max(60, row[0], row[2], row[4])), row[9]) for row in labelled], float))


def keeps(tree, features) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    none = Block("", 0, 0.0, False, 0, False)
    longest = max((b.words * (1 - b.linked) for b in found if b.furniture <= SOFT), default=0)
    out = []
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        f = features(b.words, b.linked, before.words, before.linked, after.words, after.linked, b.article, b.furniture, b.heading, longest)
        if keeps(tree, f):
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: list[tuple] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    by_value(__name__)
    small_batches(pages.sparkSession)
    tree = train(labelled)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            text = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = lambda c: p.schema[c].dataType.simpleString()
    return p.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
