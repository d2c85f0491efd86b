"""Page profiles.

Two forms:

* token form (D2): start tags and text segments pulled out of the cleaned
  HTML with ``regexp_extract_all`` + ``posexplode`` — pure column work that
  a SQL engine can mirror exactly;
* node form: aggregates over ``dom_nodes`` where the tree matters (depth,
  element children, subtree text).

All outputs are long tables keyed by page_id (top-k lists are a
``row_number`` window per page, which Spark plans as a group limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import text as T
from ..session import bucketed, dealt
from . import dom

TAG_RE = r"<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
SEGMENT_RE = r">([^<]+)<"
CLASS_ATTR_RE = r"(?i)[ \t\n\r\f]class[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f>]+))"
HAS_CLASS_RE = r"(?i)[ \t\n\r\f]class[ \t\n\r\f]*="
HAS_ID_RE = r"(?i)[ \t\n\r\f]id[ \t\n\r\f]*="
HAS_HREF_RE = r"(?i)[ \t\n\r\f]href[ \t\n\r\f]*="
STRIP_RE = r"^[ \t\n\r\f\x0B\x{A0}]+|[ \t\n\r\f\x0B\x{A0}]+$"
#: What ``STRIP_RE`` strips, and the line ends before which its ``$`` may match.
_STRIPPED = " \t\n\r\f\x0b\xa0\x85\u2028\u2029"


def _strip(text: Column) -> Column:
    """``STRIP_RE`` removed; most texts of a cleaned page have nothing to strip."""
    return T.let(text, lambda t: F.when(F.btrim(t, F.lit(_STRIPPED)) == t, t).otherwise(F.regexp_replace(t, STRIP_RE, "")))


def with_clean(pages: DataFrame) -> DataFrame:
    """pages + html_clean."""
    return pages.withColumn("html_clean", T.clean_html(F.col("html")))


def stored_clean(pages: DataFrame) -> DataFrame:
    """:func:`with_clean` written once, bucketed by ``page_id``, for the operators that share
    it.  Pages are dealt out before they are cleaned, so one large file is no one task."""
    return bucketed(with_clean(dealt(pages, "page_id")).drop("html"), "page_id")


def tag_tokens(pages_clean: DataFrame, html_col: str = "html_clean", carry: tuple = ()) -> DataFrame:
    """(page_id, pos, tag, attrs, cls, has_class, has_id, has_href) and the
    page columns to ``carry`` along."""
    toks = pages_clean.select(
        "page_id", *carry, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(TAG_RE), 0)).alias("pos", "tok")
    )
    # A tag's name holds no blank, so attributes are found in the whole tag.
    value = F.regexp_extract("tok", CLASS_ATTR_RE, 0)
    cls = F.regexp_replace(value, r"""(?s)^[^=]*=[ \t\n\r\f]*(?:"(.*)"|'(.*)'|(.*))$""", "$1$2$3")
    named = F.contains("tok", F.lit("="))
    has_class = named & F.regexp_like("tok", F.lit(HAS_CLASS_RE))
    return toks.select(
        "page_id", *carry, (F.col("pos") + 1).alias("pos"),
        F.lower(F.regexp_extract(F.col("tok"), TAG_RE, 1)).alias("tag"),
        F.regexp_extract("tok", TAG_RE, 2).alias("attrs"),
        F.when(has_class, cls).alias("cls"),
        has_class.alias("has_class"),
        (named & F.regexp_like("tok", F.lit(HAS_ID_RE))).alias("has_id"),
        (named & F.regexp_like("tok", F.lit(HAS_HREF_RE))).alias("has_href"),
    )


def text_segments(pages_clean: DataFrame, html_col: str = "html_clean") -> DataFrame:
    """(page_id, seg_pos, text): decoded, stripped, non-blank text between tags."""
    segs = pages_clean.select(
        "page_id", F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(SEGMENT_RE), 1)).alias("seg_pos", "raw")
    )
    t = _strip(T.decode_entities(F.col("raw")))
    return segs.select("page_id", (F.col("seg_pos") + 1).alias("seg_pos"), t.alias("text")).filter(F.col("text") != "")


def _page_arrays(pages_clean: DataFrame) -> DataFrame:
    """(page_id, tags, attrs, texts): the tokens and segments of a page as
    arrays of its row, so that counts are one projection without a shuffle."""
    strip = lambda t: _strip(T.decode_entities(t))
    return pages_clean.select(
        "page_id",
        F.transform(F.regexp_extract_all("html_clean", F.lit(TAG_RE), F.lit(1)), F.lower).alias("tags"),
        F.regexp_extract_all("html_clean", F.lit(TAG_RE), F.lit(2)).alias("attrs"),
        F.filter(F.transform(F.regexp_extract_all("html_clean", F.lit(SEGMENT_RE), F.lit(1)), strip), lambda t: t != "").alias("texts"))


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("bigint")


def structure_info(pages_clean: DataFrame) -> DataFrame:
    """C4: tag_count, class_count, has_classes, text_length per page."""
    classes = _count(F.col("attrs"), lambda a: F.regexp_like(a, F.lit(HAS_CLASS_RE)))
    chars = F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, t: n + F.length(t))
    return _page_arrays(pages_clean).select(
        "page_id", F.size("tags").cast("bigint").alias("tag_count"), classes.alias("class_count"), chars.alias("text_length")).withColumn(
        "has_classes", F.col("class_count") > 0)


def basic_stats(pages_clean: DataFrame) -> DataFrame:
    """D3 (token form): element, class, id, link, image and text counts."""
    has = lambda t, rx: F.regexp_like(t, F.lit(rx))
    strip = lambda t: _strip(T.decode_entities(t))
    # Attributes are found in the whole tag, as in tag_tokens, and only in a tag that holds a "=".
    arrays = pages_clean.select(
        "page_id", F.regexp_extract_all("html_clean", F.lit(TAG_RE), F.lit(0)).alias("toks"),
        F.regexp_extract_all("html_clean", F.lit(SEGMENT_RE), F.lit(1)).alias("segs"))
    arrays = arrays.withColumn("named", F.filter("toks", lambda t: F.contains(t, F.lit("="))))
    return arrays.select(
        "page_id", F.size("toks").cast("bigint").alias("total_elements"),
        _count(F.col("named"), lambda t: has(t, HAS_CLASS_RE)).alias("elements_with_classes"),
        _count(F.col("named"), lambda t: has(t, HAS_ID_RE)).alias("elements_with_ids"),
        _count(F.col("named"), lambda t: has(t, r"(?i)^<a(?![a-zA-Z0-9])") & has(t, HAS_HREF_RE)).alias("links"),
        _count(F.col("toks"), lambda t: (F.lower(F.substring(t, 2, 3)) == "img") & has(t, r"^.{4}(?![a-zA-Z0-9])")).alias("images"),
        _count(F.col("segs"), lambda t: strip(t) != "").alias("text_nodes"))


def max_depth(nodes: DataFrame) -> DataFrame:
    """D3 depth: longest element path below the root."""
    return dom.elements(nodes).groupBy("page_id").agg(F.max("depth").cast("bigint").alias("max_depth"))


def _top_k(df: DataFrame, part: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def _tokens(pages_clean: DataFrame, tokens: DataFrame | None) -> DataFrame:
    return tag_tokens(pages_clean) if tokens is None else tokens


def element_distribution(pages_clean: DataFrame, k: int = fixed.ELEMENT_DISTRIBUTION_TOP, tokens: DataFrame | None = None) -> DataFrame:
    """(page_id, rank, tag, n) — top k tags, ties by first appearance.

    ``tokens``, here and below: :func:`tag_tokens` of the pages, if they are there already."""
    c = _tokens(pages_clean, tokens).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return _top_k(c, ["page_id"], [F.desc("n"), F.asc("first_pos")], k).select(
        "page_id", F.col("rank").cast("bigint").alias("rank"), "tag", F.col("n").cast("bigint").alias("n")
    )


def class_tokens(pages_clean: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    toks = _tokens(pages_clean, tokens).filter(F.col("has_class"))
    return toks.select(
        "page_id", "pos", F.posexplode(F.split(F.trim(F.col("cls")), r"[ \t\n\r\f]+")).alias("k", "class_name")
    ).filter(F.col("class_name") != "")


def class_patterns(pages_clean: DataFrame, k: int = fixed.CLASS_TOP, tokens: DataFrame | None = None) -> DataFrame:
    """(page_id, total_classes, rank, class_name, n) — top k class tokens."""
    ct = class_tokens(pages_clean, tokens)
    c = ct.groupBy("page_id", "class_name").agg(
        F.count("*").alias("n"), F.min(F.col("pos").cast("bigint") * F.lit(1 << 32) + F.col("k")).alias("first")
    )
    c = c.withColumn("total_classes", F.count("*").over(Window.partitionBy("page_id")))
    return _top_k(c, ["page_id"], [F.desc("n"), F.asc("first")], k).select(
        "page_id", F.col("total_classes").cast("bigint").alias("total_classes"),
        F.col("rank").cast("bigint").alias("rank"), "class_name", F.col("n").cast("bigint").alias("n"),
    )


def semantic_classes(pages_clean: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(page_id, category, class_name) for each distinct class token."""
    ct = class_tokens(pages_clean, tokens).select("page_id", "class_name").distinct()
    cats = F.array(*[
        F.when(F.regexp_like(F.col("class_name"), F.lit("(?i)" + pat)), F.lit(name)) for name, pat in fixed.SEMANTIC_CLASSES
    ])
    return ct.select("page_id", F.explode(F.filter(cats, lambda x: x.isNotNull())).alias("category"), "class_name")


def repeated_classes(pages_clean: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Full class values used >= 3 times; first 5 by first appearance."""
    t = _tokens(pages_clean, tokens).filter(F.col("has_class"))
    c = t.groupBy("page_id", "cls").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).filter(
        F.col("n") >= fixed.REPEATED_CLASS_MIN
    )
    return _top_k(c, ["page_id"], [F.asc("first_pos")], fixed.REPEATED_CLASS_TOP).select(
        "page_id", F.col("rank").cast("bigint").alias("rank"), F.col("cls").alias("class_value"),
        F.col("n").cast("bigint").alias("n"),
    )


def _first_k_distinct(matches: DataFrame, part: list[str], order_cols: list[str], k: int) -> DataFrame:
    # order columns packed into one bigint (each < 2^31): hash-aggregated
    key = F.lit(0).cast("bigint")
    for c in order_cols:
        key = key * F.lit(1 << 32) + F.col(c).cast("bigint")
    first = matches.groupBy(*part, "value").agg(F.min(key).alias("first"))
    return _top_k(first, part, [F.asc("first")], k).select(*part, F.col("rank").cast("bigint").alias("rank"), "value")


def price_patterns(pages_clean: DataFrame, k: int = fixed.PATTERN_TOP) -> DataFrame:
    """Distinct price-like matches in text segments; first k by first
    occurrence (a deterministic choice where the original used set order)."""
    seg = text_segments(pages_clean).filter(F.regexp_like("text", F.lit("[0-9]")))  # a price has a digit
    m = seg.select(
        "page_id", "seg_pos",
        F.posexplode(F.regexp_extract_all(F.col("text"), F.lit("(?i)" + fixed.PRICE_RE), 0)).alias("m_pos", "value"),
    )
    return _first_k_distinct(m, ["page_id"], ["seg_pos", "m_pos"], k)


def content_patterns(df: DataFrame, id_col: str, text_col: str, k: int = fixed.PATTERN_TOP) -> DataFrame:
    """(id, kind, rank, value): distinct prices / emails / urls / dates
    found in raw text, first k per kind by first occurrence; kinds with no
    match produce no rows."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text_col), F.lit(T.content_regex(kind)), F.lit(0)).alias("l"))
                      for kind in fixed.CONTENT_KINDS])
    m = df.select(F.col(id_col), F.explode(found).alias("x")).select(id_col, "x.kind", F.posexplode("x.l").alias("m_pos", "value"))
    return _first_k_distinct(m, [id_col, "kind"], ["m_pos"], k)


def task_patterns(nodes: DataFrame, tasks: list[str]) -> DataFrame:
    """(page_id, task, patterns) structural + task-word pattern tags."""
    e = dom.elements(nodes)
    cls = F.lower(F.coalesce(F.col("cls"), F.lit("")))
    flags = e.groupBy("page_id").agg(
        F.bool_or(F.col("tag").isin("ul", "ol") | ((F.col("tag") == "div") & (F.col("n_elem") > 2))).alias("list_structure"),
        F.bool_or((F.col("tag") == "table") | ((F.col("tag") == "div") & F.contains(cls, F.lit("table")))).alias("table_structure"),
        F.bool_or(F.contains(cls, F.lit("card")) | F.contains(cls, F.lit("item"))).alias("card_structure"),
    )
    t = flags.select("*", F.explode(F.array(*[F.lit(x) for x in tasks])).alias("task"))
    low = F.lower(F.col("task"))
    tags = [
        F.when(F.col("list_structure"), F.lit("list_structure")),
        F.when(F.col("table_structure"), F.lit("table_structure")),
        F.when(F.col("card_structure"), F.lit("card_structure")),
    ]
    for name, words in fixed.TASK_PATTERN_WORDS:
        tags.append(F.when(T.contains_any(low, words), F.lit(name)))
    return t.select("page_id", "task", F.filter(F.array(*tags), lambda x: x.isNotNull()).alias("patterns"))


def dynamic_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """A2: (page_id, is_dynamic, reason, reasons): ``reasons`` are all checks
    that a page fails, in the order of checking, ``reason`` the first.

    Needs the node table (of the *raw* page) for body text, script text and
    content elements; the html itself is reduced to flags before any join."""
    low = F.lower(F.coalesce("html", F.lit("")))
    flags = pages.select(
        "page_id", (F.length(F.trim(F.coalesce("html", F.lit("")))) < fixed.DYNAMIC_MIN_HTML).alias("short"),
        T.contains_any(low, fixed.DYNAMIC_FRAMEWORK_MARKERS).alias("framework"))
    # Scripts, style sheets and templates hold no text of the page.
    stripped = F.when(F.col("ptag").isin("script", "style", "template"), "").otherwise(F.regexp_replace("text", STRIP_RE, ""))
    w = Window.partitionBy("page_id").orderBy("t_from")
    texts = dom.text_nodes(nodes).select("page_id", "t_from", "ptag", F.length("text").alias("rlen"), stripped.alias("t")).withColumn(
        "upto", F.sum(F.length("t")).over(w))
    # Text below an element: a difference of running sums at its first and last text.
    first = texts.select("page_id", "t_from", (F.col("upto") - F.length("t")).alias("before"))
    last = texts.select("page_id", F.col("t_from").alias("t_last"), "upto")
    el = dom.elements(nodes).filter(F.col("tag").isin(*fixed.DYNAMIC_CONTENT_TAGS, "body")).select(
        "page_id", "pre", "tag", "t_from", "t_count", (F.col("t_from") + F.col("t_count") - 1).alias("t_last"))
    el = el.filter("t_count > 0").join(first, ["page_id", "t_from"]).join(last, ["page_id", "t_last"]).withColumn(
        "below", F.col("upto") - F.col("before"))
    body_row = F.when(F.col("tag") == "body", F.struct("pre", "below", "t_from", "t_last"))
    sums = el.groupBy("page_id").agg(
        F.min(body_row).alias("b"),
        F.sum(((F.col("tag") != "body") & (F.col("below") > fixed.DYNAMIC_CONTENT_MIN_TEXT)).cast("int")).alias("meaningful"))
    has_body = dom.elements(nodes).filter(F.col("tag") == "body").select("page_id").distinct().withColumn("has_body", F.lit(True))
    script = texts.filter(F.col("ptag") == "script").groupBy("page_id").agg(F.sum("rlen").alias("script_len"))
    loading = texts.join(sums.select("page_id", "b"), "page_id").filter(F.col("t_from").between(F.col("b.t_from"), F.col("b.t_last"))).groupBy(
        "page_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_from", "t"))), lambda s: s["t"]), "")).alias("body_text"))
    loading = loading.select("page_id", T.contains_any(F.col("body_text"), fixed.DYNAMIC_LOADING_MARKERS).alias("loading"))
    j = (flags.join(sums, "page_id", "left").join(has_body, "page_id", "left").join(script, "page_id", "left").join(loading, "page_id", "left"))
    body_len, script_len = F.coalesce("b.below", F.lit(0)), F.coalesce("script_len", F.lit(0))
    checks = [
        (F.col("short"), "short_html"), (F.col("has_body").isNull(), "no_body"), (body_len < fixed.DYNAMIC_MIN_BODY_TEXT, "little_body_text"),
        (script_len > body_len * fixed.DYNAMIC_SCRIPT_RATIO, "script_heavy"), (F.col("framework"), "framework_marker"),
        (F.coalesce("meaningful", F.lit(0)) < fixed.DYNAMIC_MIN_CONTENT_ELEMENTS, "few_content_elements"),
        (F.coalesce("loading", F.lit(False)), "loading_marker")]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda r: r.isNotNull())
    return j.select("page_id", reasons.alias("reasons")).select(
        "page_id", (F.size("reasons") > 0).alias("is_dynamic"), F.get("reasons", F.lit(0)).alias("reason"), "reasons")


def full_profile(pages_clean: DataFrame, nodes: DataFrame) -> DataFrame:
    """One nested report per page (also for pages that cannot be parsed):
    counts, depth, top tags, classes by category, repeated classes, prices.
    The tag tokens, which four parts count, are written once."""
    tokens = bucketed(tag_tokens(dealt(pages_clean.select("page_id", "html_clean"), "page_id")).drop("attrs"), "page_id")

    def listed(df, name, *cols):
        order = F.col("rank") if "rank" in df.columns else F.col(cols[0])
        return df.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*cols).alias("v")))),
                                                     lambda x: x["v"]).alias(name))

    semantic = semantic_classes(pages_clean, tokens).groupBy("page_id", "category").agg(F.sort_array(F.collect_set("class_name")).alias("classes"))
    parts = [
        max_depth(nodes), listed(element_distribution(pages_clean, tokens=tokens), "top_tags", "tag", "n"),
        listed(class_patterns(pages_clean, tokens=tokens), "top_classes", "class_name", "n"), listed(semantic, "semantic_classes", "category", "classes"),
        listed(repeated_classes(pages_clean, tokens), "repeated_classes", "class_value", "n"), listed(price_patterns(pages_clean), "price_patterns", "value")]
    out = basic_stats(pages_clean)
    for p in parts:
        out = out.join(p, "page_id", "left")
    return out.withColumn("max_depth", F.coalesce("max_depth", F.lit(0)).cast("bigint"))


def route_pages(pages: DataFrame, dyn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: (static pages kept, pages that need rendering)."""
    j = pages.join(dyn.select("page_id", "is_dynamic", "reasons"), "page_id")
    return j.filter(~F.col("is_dynamic")).drop("is_dynamic", "reasons"), j.filter(F.col("is_dynamic"))
