"""Group a rule's extracted values into records.

Everything is keyed by (page_id, sequence_id): one rule's results on one page.

* F1  sources are the exact elements the values came from (provenance from the
  selector join), in discovery order, from steps that succeeded;
  ``text_lookup=True`` finds them again by the heads of their texts instead: the
  first 5 elements that hold a text result's, and the first 3 that hold one of the first
  10 values' (a head with an apostrophe finds nothing, as there);
* F2  containers are ancestors (within 5 levels) shared by two sources or
  more; one is skipped if a container discovered earlier is its ancestor.
  ``compat=True`` keeps one ancestor per (tag, level) instead;
* F7  without containers: product-like elements, F8 without those either:
  direct parents, else one record per source;
* F3  a container takes every source within it: sources and container bounds
  are swept in document order by a window, so each container knows its range of
  source ordinals and meets its members by an equi-join;
* F4-F6 field names, navigation filter, one value per field, records that look
  like items;
* F9/F10 if fewer than 30 % of the values became records, prices take the first
  unused related title; this wins if it gives more records.

Work is linear in sources and memberships; groups are one rule's values on one
page, which execution bounds.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import text as T
from ..session import any_row, kept
from . import dom
from . import select as S

KEY = ["page_id", "sequence_id"]


def _has_currency(v: Column) -> Column:
    return T.contains_any(v, fixed.CURRENCY_MARKS)


def _field(price: Column, title: Column, n: Column, cls: Column, tag: Column, has_href: Column) -> Column:
    """F4 from what the full text says (a price, a brand or product, its length)."""
    words = F.struct(F.lower(F.coalesce(cls, F.lit(""))).alias("c"), F.lower(tag).alias("t"))  # once each
    return T.let(words, lambda w: _field_by(price, title, n, w["c"], w["t"], has_href))


def _field_by(price: Column, title: Column, n: Column, c: Column, t: Column, has_href: Column) -> Column:
    out = F.when(price, F.lit("price")).when(title, F.lit("title"))
    for name, words in fixed.CLASS_FIELDS:
        out = out.when((c != "") & T.contains_any(c, words), F.lit(name))
    out = out.when(t.isin(*fixed.HEADING_TAGS), F.lit("title"))
    out = out.when((t == "a") & has_href, F.lit("link")).when(t == "a", F.lit("title"))
    blk = t.isin(*fixed.BLOCK_TEXT_TAGS)
    out = out.when(blk & (n > 100), F.lit("description")).when(blk & (n > 20), F.lit("title")).when(blk, F.lit("text"))
    out = out.when(t == "time", F.lit("date")).when(t == "img", F.lit("image"))
    out = out.when(n > 100, F.lit("description")).when((n > 10) & (n <= 100), F.lit("title"))
    return out.otherwise(F.lit("code"))


def field_name(text: Column, cls: Column, tag: Column, has_href: Column) -> Column:
    """field name of an element from its full text, class and tag."""
    return T.let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda t: _field_of(t["text"], t["low"], cls, tag, has_href))


def _field_of(text: Column, low: Column, cls: Column, tag: Column, has_href: Column) -> Column:
    price = _has_currency(text) | F.contains(low, F.lit("price"))
    title = T.contains_any(text, fixed.BRANDS) | T.contains_any(low, fixed.PRODUCT_TERMS)
    return _field(price, title, F.length(text), cls, tag, has_href)


def is_navigation(text: Column) -> Column:
    """navigation / UI text."""
    return T.let(F.lower(F.trim(text)), lambda low: _navigates(text, low))


def _navigates(text: Column, low: Column) -> Column:
    upper_only = (F.upper(text) == text) & (F.lower(text) != text)
    return (
        low.isin(*fixed.NAV_TERMS)
        | ((F.length(low) <= 4) & ~low.isin(*fixed.NAV_SHORT_ALLOWED))
        | (upper_only & (F.length(text) < 20) & ~F.contains(text, F.lit(fixed.NAV_UPPER_ALLOWED)))
        | low.isin(*fixed.CATEGORY_TERMS)
    )


def field_names(nodes: DataFrame, with_text: bool = False) -> DataFrame:
    """F4 for every element, void ones included, by its full text:
    (page_id, pre, tag, n_elem, n_chars, field).  Linear in nodes, unless the
    texts themselves are asked for, which are read once per enclosing element."""
    e = dom.elements(nodes).select("page_id", "pre", "tag", "cls", "href", "n_elem")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    reach = max(map(len, [*fixed.CURRENCY_MARKS, *fixed.BRANDS, *fixed.PRODUCT_TERMS, "price"])) - 1
    # Text as it is and in lower case, which differ in length for a few characters: two searches.
    facts = dom.text_facts(nodes, {"currency": words(*fixed.CURRENCY_MARKS), "brand": words(*fixed.BRANDS)}, reach, F.col("text"))
    low = dom.text_facts(nodes, {"price": words("price"), "product": words(*fixed.PRODUCT_TERMS)}, reach, F.lower("text")).drop("n_chars")
    named = e.join(facts, ["page_id", "pre"]).join(low, ["page_id", "pre"]).select(
        "page_id", "pre", "tag", "n_elem", "n_chars",
        _field(F.col("currency") | F.col("price"), F.col("brand") | F.col("product"), F.col("n_chars"), F.col("cls"), F.col("tag"),
               F.col("href").isNotNull()).alias("field"))
    if not with_text:
        return named
    texts = dom.element_text(nodes, e.select("page_id", "pre"), []).select("page_id", "pre", S.strip_ws(F.col("text_content")).alias("text"))
    return named.join(texts, ["page_id", "pre"])


def _records(members: DataFrame) -> DataFrame:
    """F6 over (page_id, sequence_id, container, co, pre, o, field, text) ->
    (page_id, sequence_id, co, record map) for groups that look like items;
    ``co`` orders a rule's containers."""
    group = [*KEY, "container", "co"]
    s = members.filter((F.length(F.trim("text")) >= 3) & ~is_navigation(F.col("text")))
    # a repeated text counts once, in its first place
    s = s.groupBy(*group, "text").agg(F.min(F.struct("o", "field")).alias("f")).select(*group, "text", "f.o", "f.field")
    cur = _has_currency(F.col("text"))
    per = s.groupBy(*group, "field").agg(
        F.min_by("text", "o").alias("first"), F.min("o").alias("fo"),
        F.min_by(F.when(cur, F.col("text")), F.when(cur, F.col("o"))).alias("first_cur"),
        F.max_by("text", F.struct(F.length("text"), -F.col("o"))).alias("longest"),
    )
    val = (F.when(F.col("field") == "price", F.coalesce("first_cur", "first"))
           .when(F.col("field") == "title", F.col("longest")).otherwise(F.col("first")))
    rec = per.select(*group, "field", "fo", val.alias("value"))
    item = (((F.col("field") == "price") & _has_currency(F.col("value")))
            | ((F.col("field") == "title") & ((F.length("value") > 5) | T.contains_any(F.col("value"), fixed.TITLE_BRANDS))))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("fo", "field", "value"))), lambda x: F.struct(x["field"], x["value"]))
    return rec.groupBy(*group).agg(F.map_from_entries(fields).alias("record"), F.bool_or(item).alias("keep")).filter("keep").drop(
        "keep", "container")


#: Positions of a text that are indexed at once.
LOOKUP_BLOCK = 4096
#: A page is searched for one needle after the other up to so many characters times needles; beyond,
#: its windows are looked up among the needles.
LOOKUP_SEARCH = 1 << 22


def head(text: Column, chars: int) -> Column:
    """What is looked up of ``text``: its first characters, apostrophes escaped;
    null where that leaves one (no element is found then)."""
    cut = F.substring(F.replace(text, F.lit("'"), F.lit("\\'")), 1, chars)
    return F.when(~F.contains(cut, F.lit("'")) & (cut != ""), cut)


def _searched(whole: str, starts: list, needle: str):
    """Places of the texts that hold ``needle``; ``whole`` is the texts with a character
    between them, ``starts`` where each begins and the next one would."""
    at = whole.find(needle)
    while at >= 0:
        i = bisect_right(starts, at) - 1
        if at + len(needle) < starts[i + 1]:
            yield i
            at = starts[i + 1]
        else:  # it runs into the next text
            at += 1
        at = whole.find(needle, at)


def _indexed(texts: list, needles: list):
    """(needle, place) of every text that holds a needle, by place: the texts' windows of the
    needles' lengths are looked up."""
    of: dict = {}
    for n in needles:
        of.setdefault(len(n), set()).add(n)
    for i, t in enumerate(texts):
        for size, wanted in of.items():
            held = set()
            for at in range(0, len(t) - size + 1, LOOKUP_BLOCK):
                part = t[at : at + size + LOOKUP_BLOCK - 1]
                held |= wanted & {part[k : k + size] for k in range(len(part) - size + 1)}
            for n in held:
                yield n, i


def holders(pres: list, texts: list, needles: list, limit: int | None) -> dict:
    """{needle: the first ``limit`` of ``pres`` whose text holds it} for one page in document
    order.  Linear in the texts, times the number of the needles' lengths at most."""
    found: dict = {n: [] for n in needles}

    def add(n, i) -> bool:
        """Whether ``n`` needs more."""
        of = found[n]
        if (limit is None or len(of) < limit) and (not of or of[-1] != pres[i]):
            of.append(pres[i])
        return limit is None or len(of) < limit

    starts = [0, *accumulate(len(t) + 1 for t in texts)]
    if starts[-1] * len(needles) <= LOOKUP_SEARCH:
        whole = "\n".join(texts)
        for n in needles:
            for i in _searched(whole, starts, n):
                if not add(n, i):
                    break
    else:
        for n, i in _indexed(texts, needles):
            add(n, i)
    return found


def text_lookup(nodes: DataFrame, needles: DataFrame, limit: int | None = None, normalized: bool = False) -> DataFrame:
    """Elements whose first text holds a needle: (page_id, needle, pre, r), by
    document order, the first ``limit`` of each (page_id, needle).

    A page's first texts meet its needles in one row and are searched there
    (:func:`holders`): nothing is made for a text or window that holds no needle.
    """
    import pyarrow as pa

    asked = needles.filter(F.col("needle").isNotNull()).groupBy("page_id").agg(F.collect_set("needle").alias("needles"))
    text = F.col("first_text")
    if normalized:
        text = F.trim(F.regexp_replace(text, S.XML_WS + "+", " "))
    e = dom.elements(nodes).filter("first_text IS NOT NULL").groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pre", text.alias("t")))).alias("e"))
    pages = e.join(asked, "page_id").select("page_id", F.col("e.pre").alias("pres"), F.col("e.t").alias("texts"), "needles")
    schema = pa.schema([("page_id", pa.int64()), ("needle", pa.string()), ("pre", pa.int32()), ("r", pa.int32())])
    dom.ship(__name__)

    def run(batches):
        for b in batches:
            rows = [[], [], [], []]
            for k, page in enumerate(b.column("page_id").to_pylist()):
                of = holders(*(b.column(c)[k].values.to_pylist() for c in ("pres", "texts", "needles")), limit)
                for needle, pres in of.items():
                    rows[0].extend([page] * len(pres))
                    rows[1].extend([needle] * len(pres))
                    rows[2].extend(pres)
                    rows[3].extend(range(1, len(pres) + 1))
                if len(rows[0]) >= 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows = [[], [], [], []]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return pages.mapInArrow(run, "page_id bigint, needle string, pre int, r int")


def _looked_up(nodes: DataFrame, found: DataFrame, extracted: DataFrame) -> DataFrame:
    """(page_id, sequence_id, o, pre) of sources by text; ``found`` has each
    result's node, kind, text and order ``o``."""
    text = found.filter("i_kind <> 'elem'").select(*KEY, "o", head(F.col("i_text"), fixed.LOOKUP_CHARS).alias("needle"))
    by_text = text.join(text_lookup(nodes, text, fixed.LOOKUP_ELEMENTS), ["page_id", "needle"]).select(*KEY, (F.col("o") * 8 + F.col("r")).alias("o"), "pre")
    some = extracted.filter((F.col("idx") <= fixed.LOOKUP_VALUES) & (F.length(F.trim("value")) > fixed.LOOKUP_MIN_LEN)).select(
        *KEY, "idx", head(F.col("value"), fixed.LOOKUP_CHARS).alias("needle"))
    late = F.lit(1 << 55) + F.col("idx") * 8 + F.col("r")  # after what the results lead to
    by_value = some.join(text_lookup(nodes, some, fixed.LOOKUP_VALUE_ELEMENTS, normalized=True), ["page_id", "needle"]).select(*KEY, late.alias("o"), "pre")
    own = found.filter("i_kind = 'elem'").select(*KEY, (F.col("o") * 8).alias("o"), F.col("node").alias("pre"))
    return own.unionByName(by_text).unionByName(by_value)


def sources(nodes: DataFrame, values: DataFrame, step_status: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """F1 with F4: (page_id, sequence_id, pre, o, up, parent, text, field);
    ``o`` is the order of discovery, ``up`` the nearest ancestors.  With
    ``extracted`` sources are looked up by text."""
    ok = step_status.filter(F.col("status") == "success").select(*KEY, "step_index")
    info = nodes.filter(F.col("kind") != "error").select(
        F.col("page_id").alias("i_page"), F.col("pre").alias("i_pre"), F.col("kind").alias("i_kind"),
        F.col("parent").alias("i_parent"), F.col("text").alias("i_text"))
    v = values.join(ok, [*KEY, "step_index"], "left_semi")
    v = v.join(info, (F.col("page_id") == F.col("i_page")) & (F.col("node") == F.col("i_pre")))
    elem = F.col("i_kind") == "elem"  # else the parent of a text result
    o = F.col("step_index").cast("bigint") * F.lit(1 << 32) + F.col("ord")
    if extracted is not None:
        src = _looked_up(nodes, v.select(*KEY, "node", "i_kind", "i_text", o.alias("o")), extracted)
    else:
        src = v.select(*KEY, o.alias("o"), F.when(elem, F.col("node")).otherwise(F.col("i_parent")).alias("pre"))
    src = src.groupBy(*KEY, "pre").agg(F.min("o").alias("o"))
    one = src.select("page_id", "pre").distinct()
    e = dom.elements(nodes).select("page_id", "pre", "tag", "cls", "href", "up", "parent").join(one, ["page_id", "pre"], "left_semi")
    # the outer white space is taken off once, not for every word that is looked for
    full = e.join(dom.element_text(nodes, one, []), ["page_id", "pre"]).withColumn("full", S.strip_ws(F.col("text_content")))
    named = full.select(
        "page_id", "pre", "up", "parent", S.one_blank(F.col("full")).alias("text"),
        field_name(F.col("full"), F.col("cls"), F.col("tag"), F.col("href").isNotNull()).alias("field"))
    return src.join(named, ["page_id", "pre"])


def containers(nodes: DataFrame, src: DataFrame, compat: bool = False) -> DataFrame:
    """(page_id, sequence_id, container, last, co); ``co`` is the order of
    discovery."""
    bounds = dom.elements(nodes).select("page_id", F.col("pre").alias("container"), "last", F.col("tag").alias("c_tag"))
    up = src.select(*KEY, "pre", "o", F.posexplode(F.slice("up", 1, fixed.CONTAINER_MAX_LEVELS)).alias("lvl", "container"))
    seen = F.col("o") * F.lit(8) + F.col("lvl")
    if compat:
        bucket = up.join(bounds, ["page_id", "container"]).groupBy(*KEY, "c_tag", "lvl").agg(
            F.count_distinct("pre").alias("n"), F.min_by("container", "o").alias("container"), F.min(seen).alias("co"))
        found = bucket.filter("n >= 2").groupBy(*KEY, "container").agg(F.min("co").alias("co"))
    else:
        # a source has each ancestor once, so counting rows counts sources
        found = up.groupBy(*KEY, "container").agg(F.count("*").alias("n"), F.min(seen).alias("co")).filter("n >= 2")
    found = found.join(bounds.drop("c_tag"), ["page_id", "container"])
    # Containers of one rule and page in document order, with the enclosing
    # ones on a stack: one is skipped if an enclosing one was found earlier.
    item = F.struct(F.col("container").alias("pre"), "last", "co")
    start = F.struct(F.array().cast("array<struct<last:int,co:bigint>>").alias("open"),
                     F.array().cast("array<struct<pre:int,last:int,co:bigint>>").alias("keep"))

    def step(acc, c):
        open_ = F.filter(acc["open"], lambda s: s["last"] >= c["pre"])
        hidden = F.exists(open_, lambda s: s["co"] < c["co"])
        return F.struct(F.concat(open_, F.array(F.struct(c["last"].alias("last"), c["co"].alias("co")))).alias("open"),
                        F.when(hidden, acc["keep"]).otherwise(F.concat(acc["keep"], F.array(c))).alias("keep"))

    kept = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("c")).select(
        *KEY, F.explode(F.aggregate("c", start, step)["keep"]).alias("k"))
    return kept.select(*KEY, F.col("k.pre").alias("container"), F.col("k.last").alias("last"), F.col("k.co").alias("co"))


def members(src: DataFrame, cont: DataFrame) -> DataFrame:
    """every source with each container it is or lies in."""
    w = Window.partitionBy(*KEY).orderBy("at", "kind")
    none = F.lit(None)
    ev = src.select(*KEY, F.col("pre").alias("at"), F.lit(1).alias("kind"), none.cast("int").alias("container"), none.cast("bigint").alias("co"))
    for kind, at in ((0, "container"), (2, "last")):
        ev = ev.unionByName(cont.select(*KEY, F.col(at).alias("at"), F.lit(kind).alias("kind"), "container", "co"))
    ev = ev.withColumn("n", F.sum((F.col("kind") == 1).cast("int")).over(w))
    ranges = ev.filter("kind <> 1").groupBy(*KEY, "container", "co").agg(
        F.min("n").alias("a"), F.max("n").alias("b")).filter("b > a")
    numbered = src.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("pre")))
    return ranges.select(*KEY, "container", "co", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("n")).join(numbered, [*KEY, "n"])


def product_containers(nodes: DataFrame, src: DataFrame, extracted: DataFrame, by_text: bool = False) -> DataFrame:
    """F7 for the rules and pages of ``src``: ancestors (up to 4 levels) of the
    first 5 price values whose text is over 1.5 times as long as the price, then
    elements with a product-like class (or ``article``) whose text has a price or
    brand mark; the first 10.  Columns as of :func:`containers`.  ``by_text``:
    a price's elements are all whose first text holds its head."""
    keys = src.select(*KEY).distinct()
    w = Window.partitionBy(*KEY).orderBy("idx")
    prices = extracted.join(keys, KEY, "left_semi").filter(T.contains_any(F.col("value"), fixed.CURRENCY_MARKS))
    prices = prices.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fixed.CONTAINER_SOURCE_LIMIT)
    el = dom.elements(nodes).select("page_id", "pre", "last", "text_len", "tag", "cls")
    near = nodes.filter(F.col("kind") != "error").select("page_id", F.col("pre").alias("node"), F.col("kind").alias("n_kind"), F.col("up").alias("n_up"))
    up = F.when(F.col("n_kind") == "elem", F.col("n_up")).otherwise(F.slice("n_up", 2, dom.NEAR))
    if by_text:
        asked = prices.select(*KEY, F.col("r").alias("price"), "value", head(F.col("value"), fixed.LOOKUP_PRICE_CHARS).alias("needle"))
        hit = text_lookup(nodes, asked).join(dom.elements(nodes).select("page_id", "pre", "up"), ["page_id", "pre"])
        at = (F.col("price").cast("bigint") * F.lit(1 << 28) + F.col("r")).alias("r")
        s1 = asked.join(hit, ["page_id", "needle"]).select(*KEY, at, F.length("value").alias("n"), F.posexplode(F.slice("up", 1, 4)).alias("lvl", "pre"))
    else:
        s1 = prices.join(near, ["page_id", "node"]).select(
            *KEY, F.col("r").cast("bigint").alias("r"), F.length("value").alias("n"), F.posexplode(F.slice(up, 1, 4)).alias("lvl", "pre"))
    s1 = s1.join(el, ["page_id", "pre"]).filter(F.col("text_len") > F.col("n") * 1.5).select(
        *KEY, "pre", "last", (F.col("r") * 8 + F.col("lvl")).alias("co"))
    low = F.coalesce(F.col("cls"), F.lit(""))
    kind = F.lit(None).cast("int")
    for i, word in reversed(list(enumerate(fixed.CONTAINER_PRODUCT_CLASSES))):
        hit = (F.col("tag") == "article") if word == "article" else F.contains(low, F.lit(word))
        kind = F.when(hit, F.lit(i)).otherwise(kind)
    cand = el.join(keys.select("page_id").distinct(), "page_id", "left_semi").withColumn("k", kind).filter("k IS NOT NULL")
    tc = dom.element_text(nodes, cand.select("page_id", "pre"), [])
    marked = cand.join(tc.filter(T.contains_any(F.col("text_content"), fixed.CONTAINER_PRODUCT_MARKS)), ["page_id", "pre"], "left_semi")
    s2 = marked.join(keys, "page_id").select(
        *KEY, "pre", "last", (F.lit(1 << 50) + F.col("k").cast("bigint") * F.lit(1 << 32) + F.col("pre")).alias("co"))
    both = s1.unionByName(s2).groupBy(*KEY, "pre", "last").agg(F.min("co").alias("co"))
    w2 = Window.partitionBy(*KEY).orderBy("co")
    return both.withColumn("r", F.row_number().over(w2)).filter(F.col("r") <= fixed.CONTAINER_TOP).select(
        *KEY, F.col("pre").alias("container"), "last", "co")


def pair_up(prices: list, titles: list) -> list[dict]:
    """each price (value, ancestors-or-self) in order takes the first
    unused title that shares one; titles left over are records of their own.
    Linear: an ancestor's titles are walked once."""
    under: dict = {}
    for i, (_, chain) in enumerate(titles):
        for a in chain:
            under.setdefault(a, []).append(i)
    at, used, out = dict.fromkeys(under, 0), set(), []
    for price, chain in prices:
        best = None
        for a in chain:
            if a in under:
                while at[a] < len(under[a]) and under[a][at[a]] in used:
                    at[a] += 1
                if at[a] < len(under[a]) and (best is None or under[a][at[a]] < best):
                    best = under[a][at[a]]
        if best is None:
            out.append({"price": price})
        else:
            used.add(best)
            out.append({"title": titles[best][0], "price": price})
    return out + [{"title": t} for i, (t, _) in enumerate(titles) if i not in used]


def pair_records(nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    """F9 over de-duplicated values (page_id, sequence_id, idx, value, node) ->
    (page_id, sequence_id, co, record)."""
    near = nodes.filter(F.col("kind") != "error").select("page_id", F.col("pre").alias("node"), F.col("kind").alias("n_kind"), F.col("up").alias("n_up"))
    text = F.col("n_kind") != "elem"
    chain = F.slice(F.when(text, F.col("n_up")).otherwise(F.concat(F.array("node"), F.col("n_up"))), 1, fixed.RELATED_MAX_DISTANCE)
    cur = T.contains_any(F.col("value"), fixed.CURRENCY_MARKS)
    n = F.length("value")
    title = ~cur & (F.contains(F.col("value"), F.lit(fixed.PAIR_TITLE_MARK)) | ((n > 15) & (n < 100)))
    item = F.struct("idx", "value", chain.alias("chain"))
    per = extracted.join(near, ["page_id", "node"]).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(cur, item))).alias("prices"),
        F.array_sort(F.collect_list(F.when(title, item))).alias("titles")).filter("size(prices) + size(titles) > 0")
    dom.ship(__name__)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            recs = [pair_up([(x["value"], x["chain"]) for x in p], [(x["value"], x["chain"]) for x in t])
                    for p, t in zip(b.column("prices").to_pylist(), b.column("titles").to_pylist())]
            kind = pa.list_(pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sequence_id"),
                                              pa.array([[list(r.items()) for r in rs] for rs in recs], kind)], [*KEY, "r"])

    out = per.mapInArrow(run, "page_id bigint, sequence_id string, r array<map<string,string>>")
    return out.select(*KEY, F.posexplode("r").alias("co", "record")).withColumn("co", F.col("co").cast("bigint"))


def structure(nodes: DataFrame, values: DataFrame, step_status: DataFrame, extracted: DataFrame, compat: bool = False,
              by_text: bool = False) -> DataFrame:
    """the final data of every rule and page,
    (page_id, sequence_id, idx, value, record, strategy).

    ``strategy`` is container / product / parent / pair (``record`` is set) or
    flat (``value`` is set)."""
    flat = kept(extracted.select(*KEY, "idx", "value", "node"))
    src = kept(sources(nodes, values, step_status, flat if by_text else None))  # every branch below starts here
    keys = src.select(*KEY).distinct()
    cont = kept(containers(nodes, src, compat).withColumn("strategy", F.lit("container")))
    # Branches that no page needs are not planned.
    without = keys.join(cont.select(*KEY).distinct(), KEY, "left_anti")
    if any_row(without):
        broad = product_containers(nodes, src.join(without, KEY, "left_semi"), flat, by_text).withColumn("strategy", F.lit("product"))
        cont = kept(cont.unionByName(broad))
    of = cont.select(*KEY, "strategy").distinct()
    recs = _records(members(src, cont)).join(of, KEY)
    rest = src.join(of, KEY, "left_anti")
    if any_row(rest):  # F8: no containers at all
        parents = rest.groupBy(*KEY, "parent").agg(F.min("o").alias("co"))
        by_parent = _records(rest.join(parents, [*KEY, "parent"]).withColumn("container", F.col("parent"))).withColumn("strategy", F.lit("parent"))
        single = rest.join(by_parent.select(*KEY).distinct(), KEY, "left_anti").filter(F.length("text") > 0).select(
            *KEY, F.col("o").alias("co"), F.create_map("field", "text").alias("record"), F.lit("parent").alias("strategy"))
        recs = recs.unionByName(by_parent).unionByName(single)
    recs = kept(recs)
    # F9 where containers gave records for fewer than 30 % of the values
    counts = flat.groupBy(*KEY).agg(F.count("*").alias("n_values")).join(of, KEY).join(
        recs.groupBy(*KEY).agg(F.count("*").alias("n_records")), KEY, "left").fillna(0, ["n_records"])
    poor = counts.filter(F.col("n_records") < F.col("n_values") * fixed.STRUCTURED_SHARE)
    if any_row(poor):
        pairs = kept(pair_records(nodes, flat.join(poor.select(*KEY), KEY, "left_semi")))
        more = pairs.groupBy(*KEY).agg(F.count("*").alias("n_pairs")).join(poor, KEY).filter("n_pairs > n_records").select(*KEY)
        pairs = pairs.join(more, KEY, "left_semi").withColumn("strategy", F.lit("pair"))
        recs = recs.join(more, KEY, "left_anti").unionByName(pairs)
    w = Window.partitionBy(*KEY).orderBy("co", "strategy")
    recs = recs.select(*KEY, F.row_number().over(w).alias("idx"), F.lit(None).cast("string").alias("value"), "record", "strategy")
    left = flat.join(recs.select(*KEY).distinct().hint("merge"), KEY, "left_anti").select(
        *KEY, "idx", "value", F.lit(None).cast("map<string,string>").alias("record"), F.lit("flat").alias("strategy"))
    return recs.unionByName(left)
