"""Column functions over HTML and text (cleaning, flat text, patterns).

All of these are built-in Spark expressions (JVM, codegen) so they run
inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

WS = r"[ \t\n\r\f\x0B]"


def _lit_re(s: str) -> str:
    """Escape a literal for use inside a Java regex."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch)
    return "".join(out)


#: White space of a text node besides the blank.
OTHER_WS = r"\t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: References to a no-break space, which cleaning reads as the character.
WS_REFERENCE = r"&(?:nbsp;|#0*160;|#[xX]0*[aA]0;)"
#: White space of a text node, as characters or as such references.
TEXT_WS = rf"(?:[ {OTHER_WS}]|{WS_REFERENCE})"
#: Neither a blank nor a character of any usual text: other white space, controls.
UNUSUAL = (r"[^ -~\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}"
           r"\x{3001}-\x{10FFFF}]")
#: A page with white space that is not one blank may have one of these.
MAY_SQUEEZE = rf"{UNUSUAL}|  "
#: A run of white space that is not one blank, in a page without such references.
PLAIN_RUN = rf"(?=  | ?{UNUSUAL})(?: [ {OTHER_WS}]++|[{OTHER_WS}][ {OTHER_WS}]*+)"
#: A tag (quoted values may hold ``>``), a run of text, or a stray ``<``.
TOKEN = r"""</?[a-zA-Z!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
KEEP = "|".join(fixed.WHITESPACE_KEEP_PARENTS)
#: An element whose own text keeps its white space, up to its end tag.
KEPT_ELEMENT = rf"(?is)<({KEEP})\b[^>]*>.*?</\1{WS}*>"

#: A tag with blanks that whole-page replacements would touch, an angle bracket
#: in a quoted value, or a stray ``<``.
TRICKY_TAG = rf"""<[a-zA-Z/!?][^<>]*(?:{TEXT_WS}{{2}}|[\t\n\r\f\x0B\x{{A0}}]|&nbsp;)|=["'][^"'<>]*[<>]|={WS}*["']{WS}|<(?![a-zA-Z/!?])|{WS}["'][^<>]*>"""


#: The same in a page without references to a no-break space (within a tag, a
#: blank of ``_LONE`` matters only beside another), and in one with lone blanks only.
_IN_TAG = rf"[!-;=?-~[^ {OTHER_WS}<>]]*+"
_LONE = r"[ \x{1C}-\x{1F}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRICKY_LONE = r"""(?=[<= ])(?:<(?![a-zA-Z/!?])|=["'][^"'<>]*+[<>]|= *["'] | ["'][^<>]*+>)"""
TRICKY_PLAIN = (rf"""(?=[<= \t\n\r\f\x0B])(?:<(?:[a-zA-Z/!?]{_IN_TAG}(?:{_LONE}(?![ {OTHER_WS}]){_IN_TAG})*+[ {OTHER_WS}]|(?![a-zA-Z/!?]))"""
                rf"""|=["'][^"'<>]*+[<>]|={WS}*["']{WS}|{WS}["'][^<>]*+>)""")
#: Markup that cleaning may drop.
MAY_DROP = "(?i)<(?:" + "|".join([*fixed.CLEAN_DROP_WITH_CONTENT, *fixed.CLEAN_DROP_VOID, "!--"]) + ")"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often
    ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def _one_blank(s: Column, run: str) -> Column:
    """Runs of blanks become one space, outer ones go."""
    return F.trim(F.regexp_replace(s, run, " "))


def _squeeze_text(tok: Column, run: str = TEXT_WS + "+") -> Column:
    """A text token as cleaning leaves it: trimmed, runs of blanks one space."""
    return _one_blank(tok, run)


def _squeeze_between_tags(part: Column, run: str = TEXT_WS + "+") -> Column:
    """Every text token squeezed; tags, and so attribute values, stay as they are."""
    toks = F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(toks, lambda t: F.when(F.startswith(t, F.lit("<")), t).otherwise(_squeeze_text(t, run))), "")


def _squeeze_inside(block: Column) -> Column:
    """A kept element: its direct text stays, text of elements in it is
    squeezed.  The depth of a token follows from the tags before it."""
    toks = F.regexp_extract_all(block, F.lit(TOKEN), F.lit(0))
    void = r"(?i)^<(?:" + "|".join(fixed.VOID_TAGS) + r")\b|/>$|^<[!?]"
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        tag = F.startswith(t, F.lit("<")) & (F.length(t) > 1)
        move = F.when(~tag | F.regexp_like(t, F.lit(void)), 0).when(F.startswith(t, F.lit("</")), -1).otherwise(1)
        text = F.when(tag | (acc["depth"] <= 1), t).otherwise(_squeeze_text(t))
        return F.struct((acc["depth"] + move).alias("depth"), F.concat(acc["out"], F.array(text)).alias("out"))

    return F.array_join(F.aggregate(toks, start, step)["out"], "")


def clean_html(html: Column) -> Column:
    """Drop script/style/noscript (with content), comments and
    meta/link/base, then normalise the white space of every text: trimmed, runs
    of blanks one space.  Text directly under pre/code/textarea and attribute
    values stay as they are.  Blank input gives ``""``.
    """
    whole = F.coalesce(html, F.lit(""))
    out = whole
    for tag in fixed.CLEAN_DROP_WITH_CONTENT:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}{WS}*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(?:" + "|".join(fixed.CLEAN_DROP_VOID) + r")\b[^>]*>", "")
    return let(F.when(F.regexp_like(whole, F.lit(MAY_DROP)), out).otherwise(whole), _squeeze_page)


def _squeeze_page(out: Column) -> Column:
    # Without blanks or angle brackets to protect, whole-page replacements do.
    def plain(text):
        return F.trim(F.replace(F.replace(text, F.lit(" <"), F.lit("<")), F.lit("> "), F.lit(">")))

    def squeezed(tricky, run):
        return F.when(F.regexp_like(out, F.lit(tricky)), _squeeze_between_tags(out, run)).otherwise(plain(F.regexp_replace(out, run, " ")))

    lone = F.when(F.regexp_like(out, F.lit(TRICKY_LONE)), _squeeze_between_tags(out, PLAIN_RUN)).otherwise(plain(out))
    # Kept elements alternate with the rest of the page.
    rest, kept = F.split(out, KEPT_ELEMENT), F.regexp_extract_all(out, F.lit(KEPT_ELEMENT), F.lit(0))
    both = F.arrays_zip(rest.alias("rest"), kept.alias("kept"))
    parts = F.transform(both, lambda x: F.concat(_squeeze_between_tags(x["rest"]), F.coalesce(_squeeze_inside(x["kept"]), F.lit(""))))
    return (F.when(F.regexp_like(out, F.lit(rf"(?i)<(?:{KEEP})\b")), F.array_join(parts, ""))
            .when(F.regexp_like(out, F.lit(WS_REFERENCE)), squeezed(TRICKY_TAG, TEXT_WS + "+"))
            .when(F.regexp_like(out, F.lit(MAY_SQUEEZE)), squeezed(TRICKY_PLAIN, PLAIN_RUN)).otherwise(lone))


#: References that need no semicolon, longest first.
_BARE = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE}))"


#: Every named reference and its text, as one searchable string.
_NAMED = "\x01" + "".join(f"{name}\x02{text}\x01" for name, text in sorted(html.entities.html5.items()))
#: Looked at before the long string: the references of usual pages.
_USUAL = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "hellip;", "mdash;", "ndash;", "rsquo;", "lsquo;", "euro;"]


def _named(name: Column) -> Column:
    """The text of a named reference (without ``&``), null if there is none."""
    at = F.instr(F.lit(_NAMED), F.concat(F.lit("\x01"), name, F.lit("\x02")))
    rest = F.substring(F.lit(_NAMED), at + F.length(name) + 2, F.lit(4))
    return F.when(at > 0, F.substring_index(rest, "\x01", 1))


def _decode_reference(ref: Column) -> Column:
    body = F.regexp_replace(ref, "^&|;$", "")
    number = F.when(F.startswith(body, F.lit("#x")) | F.startswith(body, F.lit("#X")),
                    F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8)).cast("int")
    char = F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    bare = F.regexp_extract(ref, rf"^&({_BARE})", 1)  # an unknown name may begin with a known one
    out = F.when(F.startswith(body, F.lit("#")), char)
    for name in _USUAL:
        out = out.when(ref == "&" + name, html.entities.html5[name])
    return out.otherwise(F.coalesce(_named(F.substring(ref, 2, 64)), F.concat(
        _named(bare), F.substring(ref, F.length(bare) + 2, F.length(ref))), ref))


def decode_entities(s: Column) -> Column:
    """Decode every HTML5 character reference once, named or numeric."""
    def decode(t):
        both = F.arrays_zip(F.split(t, REFERENCE).alias("text"), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)).alias("ref"))
        out = F.transform(both, lambda x: F.concat(x["text"], F.coalesce(_decode_reference(x["ref"]), F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(out, "")).otherwise(t)

    return let(s, decode)


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, WS + "+", " "))


def page_text(html_clean: Column) -> Column:
    """Flat text of a cleaned page: tags become blanks, references are
    decoded, whitespace is squeezed."""
    return squeeze(decode_entities(F.regexp_replace(html_clean, r"<[^>]*>", " ")))


def contains_any(s: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(s, F.lit(n))
    return F.coalesce(cond, F.lit(False))


def char_pattern_v1(s: Column, width: int = 20) -> Column:
    """Phase-one code: digits -> D, then ASCII letters (D included) -> L,
    then anything not a word character or blank -> S; first ``width``."""
    head = F.substring(s, 1, width)
    out = F.regexp_replace(head, r"\p{Nd}", "D")
    out = F.regexp_replace(out, r"[A-Za-z]", "L")
    return F.regexp_replace(out, r"[^\p{L}\p{Nd}_ \t\n\r\f\x0B]", "S")


def ascii_word_boundary(regex: str) -> str:
    """Rewrite ``\\b`` to an ASCII word boundary (what RE2 means by it)."""
    w = "[A-Za-z0-9_]"
    b = f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))"
    return regex.replace(r"\b", b)


def content_regex(kind: str) -> str:
    return {
        "prices": fixed.PRICE_RE,
        "emails": ascii_word_boundary(fixed.EMAIL_RE),
        "urls": fixed.URL_RE,
        "dates": ascii_word_boundary(fixed.DATE_RE),
    }[kind]
