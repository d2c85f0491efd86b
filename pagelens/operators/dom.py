"""Pages -> ``dom_nodes``, the relational form of every page's tree.

This is the only Python step of the engine.  Each page is parsed once by a
small tree builder on top of the standard library's ``html.parser`` inside
``mapInArrow`` (Arrow batches in and out); every later operator (selection,
profiles, structuring, validation) is a join/aggregate over the node table.

Node numbering is pre-order over elements *and* text nodes, so:

* child(c, p):       c.page_id = p.page_id AND c.parent = p.pre
* subtree(a):        a.pre < d.pre <= a.last
* texts below a:     the text nodes with the ordinals ``t_from`` to
  ``t_from + t_count - 1`` of the page, so they meet a selected element by an
  equi-join on (page_id, ordinal); work is linear in what is selected
* ``up``:            the nearest ancestors, nearest first, ``NEAR`` at most

A page's rows take memory and time in proportion to its length, however long
it is and however deep its elements are nested.  Pages that cannot be parsed
become one ``kind='error'`` row (never a job failure, never a silent drop);
:func:`node_errors` splits them out and rule execution reports them.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..session import bucketed, dealt

NODE_DDL = (
    "page_id bigint, pre int, last int, parent int, depth int, kind string, tag string, "
    "ptag string, cls string, elem_id string, href string, attr_names array<string>, "
    "attr_values array<string>, text string, first_text string, "
    "n_text int, n_elem int, next_sib int, text_len int, t_from int, t_count int, up array<int>, "
    "src_start int, src_end int, tail_end int"
)

#: Ancestors kept in ``up``: what relatedness and containers look at.
NEAR = max(fixed.CONTAINER_MAX_LEVELS, fixed.RELATED_MAX_DISTANCE) + 1

_VOID = frozenset(fixed.VOID_TAGS)
_CLOSES_P = frozenset(fixed.CLOSES_P)
_P_SCOPE_STOP = frozenset(["table", "td", "th", "caption", "button", "html", "body"])
_LIST_STOP = frozenset(["ul", "ol", "table", "body", "html"])
_DL_STOP = frozenset(["dl", "table", "body", "html"])
_ROW_STOP = frozenset(["table", "tbody", "thead", "tfoot", "body", "html"])
_CELL_STOP = frozenset(["tr", "table", "body", "html"])
_NEVER_CLOSED = frozenset(["html", "body"])
_BLANK_SKIP_PARENTS = frozenset(["html", "head"])


class _TreeBuilder(HTMLParser):
    """Builds the node list in document (pre) order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.src = html
        self.at = 0
        self.kind: list[str] = []
        self.tag: list[str | None] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.attrs: list[list[tuple[str, str]] | None] = []
        self.text: list[list[str] | None] = []  # pieces of a text node
        self.start: list[int] = []
        self.end: list[int] = []
        self.last: list[int] = []
        self.first_text: list[int] = []
        self.n_text: list[int] = []
        self.n_elem: list[int] = []
        self.next_sib: list[int] = []
        self.last_elem_child: list[int] = []
        # Texts and characters before a node when it opens, within it after.
        self.t_from: list[int] = []
        self.t_count: list[int] = []
        self.text_len: list[int] = []
        self.n_texts = 0
        self.n_chars = 0
        self.stack: list[int] = []
        self.open_at: dict[str, list[int]] = {}  # tag -> its places in the stack
        self.last_child_text = -1  # index of the text node that may absorb more data
        # Where the text behind an element ends: the next markup.
        self.tail_end: list[int] = []
        self.tailing = -1  # the element that ended last, until then

    # -- helpers ---------------------------------------------------------
    def updatepos(self, i, j):
        """Offsets instead of lines and columns, for which the parser would count
        the line feeds of every token."""
        if i < j:
            self.at += j - i
        return j

    def _offset(self) -> int:
        return self.at

    def _new(self, kind, tag, attrs, text, start) -> int:
        idx = len(self.kind)
        par = self.stack[-1] if self.stack else -1
        self.kind.append(kind)
        self.tag.append(tag)
        self.parent.append(par)
        self.depth.append(len(self.stack))
        self.attrs.append(attrs)
        self.text.append(text)
        self.start.append(start)
        self.end.append(start)
        self.tail_end.append(start)
        self.last.append(idx)
        self.first_text.append(-1)
        self.n_text.append(0)
        self.n_elem.append(0)
        self.next_sib.append(-1)
        self.last_elem_child.append(-1)
        self.t_from.append(self.n_texts)
        self.t_count.append(0)
        self.text_len.append(self.n_chars)
        return idx

    def _push(self, idx: int) -> None:
        self.open_at.setdefault(self.tag[idx], []).append(len(self.stack))
        self.stack.append(idx)

    def _close_top(self, end: int) -> None:
        idx = self.stack.pop()
        self.open_at[self.tag[idx]].pop()
        self.last[idx] = len(self.kind) - 1
        self.end[idx] = self.tail_end[idx] = end
        self.t_count[idx] = self.n_texts - self.t_from[idx]
        self.text_len[idx] = self.n_chars - self.text_len[idx]
        self.last_child_text = -1

    def _close_through(self, pos_in_stack: int, end: int) -> None:
        while len(self.stack) > pos_in_stack:
            self._close_top(end)

    def _innermost(self, names) -> int:
        at = -1
        for t in names:
            places = self.open_at.get(t)
            if places and places[-1] > at:
                at = places[-1]
        return at

    def _find_open(self, names, stops) -> int:
        """Place of the innermost open element of ``names``, unless one of
        ``stops`` lies within it."""
        at = self._innermost(names)
        return at if at >= 0 and at > self._innermost(stops) else -1

    def _ensure_root(self, start: int) -> None:
        if not self.stack:
            self._push(self._new("elem", "html", [], None, start))

    # -- parser callbacks --------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, self_closing=False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, self_closing=True)

    def _markup(self) -> int:
        """Place of the markup that is being read; ends the text before it."""
        start = self._offset()
        if self.tailing >= 0:
            self.tail_end[self.tailing] = start
            self.tailing = -1
        return start

    def _open(self, tag, attrs, self_closing):
        start = self._markup()
        if tag == "html" and not self.kind:
            self._push(self._new("elem", "html", _dedup_attrs(attrs), None, start))
            return
        if tag == "html":
            return
        self._ensure_root(start)
        if tag in _CLOSES_P:
            i = self._find_open(("p",), _P_SCOPE_STOP)
            if i >= 0:
                self._close_through(i, start)
        if tag == "li":
            i = self._find_open(("li",), _LIST_STOP)
            if i >= 0:
                self._close_through(i, start)
        elif tag in ("dt", "dd"):
            i = self._find_open(("dt", "dd"), _DL_STOP)
            if i >= 0:
                self._close_through(i, start)
        elif tag == "tr":
            i = self._find_open(("tr",), _ROW_STOP)
            if i >= 0:
                self._close_through(i, start)
        elif tag in ("td", "th"):
            i = self._find_open(("td", "th"), _CELL_STOP)
            if i >= 0:
                self._close_through(i, start)
        elif tag == "option":
            i = self._find_open(("option",), ("select", "body", "html"))
            if i >= 0:
                self._close_through(i, start)
        par = self.stack[-1]
        idx = self._new("elem", tag, _dedup_attrs(attrs), None, start)
        self.n_elem[par] += 1
        prev = self.last_elem_child[par]
        if prev >= 0:
            self.next_sib[prev] = idx
        self.last_elem_child[par] = idx
        self._push(idx)
        self.last_child_text = -1
        if tag in _VOID or self_closing:
            raw = self.get_starttag_text() or ""
            self._close_top(start + len(raw))
            self.tailing = idx

    def handle_endtag(self, tag):
        start = self._markup()
        if tag in _NEVER_CLOSED:
            return
        i = self._innermost((tag,))
        if i >= 0:
            close = self.src.find(">", start)
            self._close_through(i + 1, start)  # what is still open in it has no end tag
            self.tailing = self.stack[i]
            self._close_top((close + 1) if close >= 0 else len(self.src))

    def handle_data(self, data):
        if not data:
            return
        if self.last_child_text >= 0:
            self.text[self.last_child_text].append(data)
            self.n_chars += len(data)
            return
        if not self.stack:
            if not data.strip():
                return
            self._ensure_root(self._offset())
        par = self.stack[-1]
        if self.tag[par] in _BLANK_SKIP_PARENTS and not data.strip():
            return
        idx = self._new("text", None, None, [data], self._offset())
        self.last[idx] = idx
        self.n_texts += 1
        self.t_count[idx] = 1
        self.n_chars += len(data)
        self.n_text[par] += 1
        if self.first_text[par] < 0:
            self.first_text[par] = idx
        self.last_child_text = idx

    def handle_comment(self, data):
        self._markup()
        self.last_child_text = -1

    def handle_decl(self, decl):
        self._markup()

    def handle_pi(self, data):
        self._markup()

    def unknown_decl(self, data):
        self._markup()

    def finish(self):
        self.close()
        end = len(self.src)
        if self.tailing >= 0:
            self.tail_end[self.tailing] = end
        while self.stack:
            self._close_top(end)


def _dedup_attrs(attrs):
    seen = set()
    out = []
    for k, v in attrs:
        if k in seen:
            continue
        seen.add(k)
        out.append((k, v if v is not None else ""))
    return out


def parse_page(html: str):
    """Parse one page; returns the builder (node columns as lists)."""
    b = _TreeBuilder(html)
    b.feed(html)
    b.finish()
    return b


def _page_rows(page_id, html, cols):
    if html is None or not html.strip():
        _error_row(cols, page_id, "HTML parsing failed: empty document")
        return
    try:
        b = parse_page(html)
    except Exception as exc:  # the page becomes an error row
        _error_row(cols, page_id, f"HTML parsing failed: {exc}")
        return
    n = len(b.kind)
    tags = b.tag
    texts = ["".join(t) if t is not None else None for t in b.text]
    near: list[list[int]] = []  # a parent comes before its children
    for par in b.parent:
        near.append([par, *near[par][:NEAR - 1]] if par >= 0 else [])
    given = [dict(a) if a else {} for a in b.attrs]
    rows = {
        "page_id": [page_id] * n, "pre": range(n), "last": b.last, "parent": b.parent, "depth": b.depth, "kind": b.kind, "tag": tags,
        "ptag": [tags[par] if par >= 0 else None for par in b.parent],
        "cls": [d.get("class") for d in given], "elem_id": [d.get("id") for d in given], "href": [d.get("href") for d in given],
        "attr_names": [list(d) for d in given], "attr_values": [list(d.values()) for d in given],
        "text": texts, "first_text": [texts[t] if t >= 0 else None for t in b.first_text],
        "n_text": b.n_text, "n_elem": b.n_elem, "next_sib": b.next_sib,
        "text_len": [n_chars if t is None else len(t) for n_chars, t in zip(b.text_len, texts)],
        "t_from": b.t_from, "t_count": b.t_count, "up": near, "src_start": b.start, "src_end": b.end, "tail_end": b.tail_end}
    for name, values in rows.items():
        cols[name].extend(values)


def _error_row(cols, page_id, message):
    for k in cols:
        cols[k].append(None)
    cols["page_id"][-1] = page_id
    cols["pre"][-1] = -1
    cols["kind"][-1] = "error"
    cols["text"][-1] = message
    cols["up"][-1] = []
    cols["attr_names"][-1] = []
    cols["attr_values"][-1] = []


_NAMES = [f.strip().split(" ")[0] for f in NODE_DDL.split(", ")]


def _arrow_schema():
    import pyarrow as pa

    t = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
        "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
    }
    fields = []
    for f in NODE_DDL.split(", "):
        name, typ = f.strip().split(" ", 1)
        fields.append(pa.field(name, t[typ]))
    return pa.schema(fields)


def _parse_batches():
    def run(batches):
        import pyarrow as pa

        schema = _arrow_schema()
        for batch in batches:
            ids = batch.column("page_id").to_pylist()
            htmls = batch.column("html").to_pylist()
            cols = {k: [] for k in _NAMES}
            for pid, html in zip(ids, htmls):
                _page_rows(pid, html, cols)
                if len(cols["pre"]) >= 65536:
                    yield pa.RecordBatch.from_pydict(cols, schema=schema)
                    cols = {k: [] for k in _NAMES}
            if cols["pre"]:
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return run


def ship(module: str) -> None:
    """Pickle a module's functions by value so executors need no installed
    copy of the package (the same effect as shipping it with --py-files)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


def parse_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages(page_id, html) -> raw node rows (including error rows)."""
    ship(__name__)
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col(html_col).alias("html"))
    raw = src.mapInArrow(_parse_batches(), NODE_DDL)
    return raw.withColumn("attrs", F.map_from_arrays(F.col("attr_names"), F.col("attr_values"))).drop("attr_names", "attr_values")


def dom_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Node table (with error rows), written once for the operators that share
    it: Parquet in the shared folder, bucketed by ``page_id``.  Pages are dealt to
    the buckets before they are parsed, so their rows, not their nodes, are
    shuffled; every later (page_id, ...) join and aggregate reads only its
    columns and needs no exchange."""
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col(html_col).alias("html"))
    return bucketed(parse_nodes(dealt(src, "page_id")), "page_id")


def good_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") != "error")


def node_errors(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "error").select("page_id", F.col("text").alias("error_message"))


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "elem")


def text_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "text")


def first_descendant_text(nodes: DataFrame, elems: DataFrame) -> DataFrame:
    """``elems`` (page_id, t_from, t_count, ...) with ``first_desc_text``, the
    first text below each element (null if there is none)."""
    t = text_nodes(nodes).select(F.col("page_id").alias("f_page"), F.col("t_from").alias("f_at"), F.col("text").alias("first_desc_text"))
    on = (F.col("page_id") == F.col("f_page")) & (F.col("t_from") == F.col("f_at")) & (F.col("t_count") > 0)
    return elems.join(t, on, "left").drop("f_page", "f_at")


def texts_below(nodes: DataFrame, elems: DataFrame) -> DataFrame:
    """Each of ``elems`` (page_id, t_from, t_count, other columns) with every
    text node below it: adds (tpre, ttext)."""
    t = text_nodes(nodes).select(F.col("page_id").alias("d_page"), F.col("t_from").alias("d_at"), F.col("pre").alias("tpre"),
                                 F.col("text").alias("ttext"))
    e = elems.filter(F.col("t_count") > 0).withColumn("t_at", F.explode(F.sequence("t_from", F.col("t_from") + F.col("t_count") - 1)))
    return e.join(t, (F.col("page_id") == F.col("d_page")) & (F.col("t_at") == F.col("d_at"))).drop("d_page", "d_at", "t_at")


def text_facts(nodes: DataFrame, needles: dict[str, Column], reach: int, text: Column) -> DataFrame:
    """Facts about every element's full text without putting it together:
    (page_id, pre, n_chars, one boolean for each of ``needles``).

    ``needles`` maps a name to an array of strings, none longer than
    ``reach + 1``; ``text`` is the text to search, an expression over ``text``
    (as in lower case).  ``n_chars`` is the length without outer white space.

    A text node's event for a name is the last text at or before it in which an
    occurrence begins that ends no later than in this node: itself if it holds one,
    else found in the ``reach`` characters before it joined to its head.  An
    element over the texts a to b holds an occurrence if the greatest event up
    to b is not before a.  Lengths come from running sums.  So each text is read
    once, however deep its elements are nested.
    """
    w = Window.partitionBy("page_id").orderBy("i")
    before = w.rowsBetween(-reach, -1)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("page_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    blank = r"(?U)^\s+"
    t = text_nodes(nodes).select(
        "page_id", F.col("t_from").alias("i"), text.alias("s"), F.length("text").alias("n"),
        F.length(F.regexp_extract("text", blank, 0)).alias("lead"), F.length(F.regexp_extract(F.reverse("text"), blank, 0)).alias("trail"))
    t = t.withColumn("tails", F.collect_list(F.right("s", F.lit(reach))).over(before)).withColumn("cum", F.sum("n").over(up))
    head = F.left("s", F.lit(reach))

    def behind(k):  # the last ``reach`` characters of the k texts before
        return F.right(F.array_join(F.slice("tails", -k, k), ""), F.lit(reach))

    def event(words):
        holds = lambda x: F.exists(words, lambda y: F.contains(x, y))
        n = F.size("tails")
        back = F.filter(F.sequence(F.lit(1), n), lambda k: holds(F.concat(behind(k), head)))
        return F.when(holds(F.col("s")), F.col("i")).when((n > 0) & holds(F.concat(behind(n), head)), F.col("i") - back[0])

    found = {name: event(words) for name, words in needles.items()}
    t = t.select("page_id", "i", *[F.max(e).over(up).alias(f"last_{k}") for k, e in found.items()],
                 F.max(F.when(F.col("lead") < F.col("n"), F.col("cum") - F.col("trail"))).over(up).alias("ends"),
                 F.min(F.when(F.col("lead") < F.col("n"), F.col("cum") - F.col("n") + F.col("lead"))).over(down).alias("begins"))
    e = elements(nodes).select(F.col("page_id").alias("e_page"), "pre", "t_from", (F.col("t_from") + F.col("t_count") - 1).alias("t_to"), "t_count")
    first = t.select(F.col("page_id").alias("f_page"), F.col("i").alias("f_at"), "begins")
    last = t.drop("begins")
    j = e.join(last, (F.col("e_page") == F.col("page_id")) & (F.col("t_to") == F.col("i")) & (F.col("t_count") > 0), "left").drop("page_id")
    j = j.join(first, (F.col("e_page") == F.col("f_page")) & (F.col("t_from") == F.col("f_at")) & (F.col("t_count") > 0), "left")
    return j.select(
        F.col("e_page").alias("page_id"), "pre", F.greatest(F.lit(0), F.coalesce(F.col("ends") - F.col("begins"), F.lit(0))).alias("n_chars"),
        *[F.coalesce(F.col(f"last_{k}") >= F.col("t_from"), F.lit(False)).alias(k) for k in needles])


def element_text(nodes: DataFrame, elems: DataFrame, key_cols: list[str]) -> DataFrame:
    """Full text content (descendant texts in document order) of the
    elements in ``elems`` (columns page_id, pre + key_cols).  Groups are one
    element's subtree, bounded by the page size."""
    span = elements(nodes).select("page_id", "pre", "t_from", "t_count")
    e = elems.select("page_id", "pre", *key_cols).join(span, ["page_id", "pre"])
    j = texts_below(nodes, e).groupBy("page_id", "pre", *key_cols).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("tpre", "ttext"))), lambda s: s["ttext"]), ""
        ).alias("text_content"))
    return e.select("page_id", "pre", *key_cols).join(j, ["page_id", "pre", *key_cols], "left").withColumn(
        "text_content", F.coalesce("text_content", F.lit("")))
