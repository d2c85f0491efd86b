"""URL column functions: split, validate, normalise, metadata, join.

Everything is a Column expression over `regexp_extract`, `lower`,
`replace`, `url_encode`/`try_url_decode` and higher-order array functions,
so URL work stays in the JVM next to the scan.  (`parse_url` is not used:
it returns NULL for URLs with blanks in the path.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# scheme, netloc, path, query, fragment (generic URI syntax split)
_SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SAFE_UNQUOTED = "A-Za-z0-9_.~" + "/:@!$&'()*+,;=" + r"\-"


def _part(url: Column, idx: int) -> Column:
    return F.regexp_extract(url, _SPLIT_RE, idx)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def has_netloc(url: Column) -> Column:
    return F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"))


def domain(url: Column) -> Column:
    """Lower-cased network location, NULL when there is none."""
    return F.nullif(F.lower(netloc(url)), F.lit(""))


def format_ok(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit(fixed.URL_FORMAT_RE)), F.lit(False))


def issues(url: Column) -> Column:
    """All validation issues, in order; empty array = valid."""
    blank = url.isNull() | (url == "")
    net = netloc(url)
    sch = scheme(url)
    checks = [F.when(~format_ok(url), F.lit("Invalid URL format"))]
    for pat in fixed.BLOCKED_HOST_PATTERNS:
        checks.append(
            F.when(F.regexp_like(net, F.lit("(?i)" + pat)), F.lit(f"Blocked domain pattern: {pat}"))
        )
    checks.append(
        F.when(~sch.isin(*fixed.ALLOWED_SCHEMES), F.concat(F.lit("Unsupported scheme: "), sch))
    )
    checks.append(F.when(net == "", F.lit("Missing domain name")))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return F.when(blank, F.array(F.lit("URL is empty or not a string"))).otherwise(found)


def is_valid(url: Column) -> Column:
    return F.size(issues(url)) == 0


def loose_valid(url: Column) -> Column:
    """Loader check: http/https scheme and a network location."""
    return F.coalesce(scheme(url).isin(*fixed.ALLOWED_SCHEMES) & (netloc(url) != ""), F.lit(False))


def _requote_path(p: Column) -> Column:
    """quote(unquote(p), safe) with Spark's URL codec plus fix-ups."""
    needs = F.regexp_like(p, F.lit(f"[^{_SAFE_UNQUOTED}]"))
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    enc = F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20"))
    for ch in "~" + fixed.PATH_SAFE_CHARS:
        enc = F.replace(enc, F.lit("%{:02X}".format(ord(ch))), F.lit(ch))
    return F.when(needs, enc).otherwise(p)


def normalize(url: Column) -> Column:
    """Normalised URL (no validity check; see ``normalized``)."""
    sch = scheme(url)
    net = F.lower(netloc(url))
    net = (
        F.when((sch == "http") & F.contains(net, F.lit(":80")), F.replace(net, F.lit(":80"), F.lit("")))
        .when((sch == "https") & F.contains(net, F.lit(":443")), F.replace(net, F.lit(":443"), F.lit("")))
        .otherwise(net)
    )
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    p = F.when((p != "/") & F.endswith(p, F.lit("/")), F.regexp_replace(p, "/+$", "")).otherwise(p)
    q = query(url)
    return F.concat(sch, F.lit("://"), net, _requote_path(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalized(url: Column) -> Column:
    """Normalised URL when valid, else NULL."""
    return F.when(is_valid(url), normalize(url))


def site_type(url: Column) -> Column:
    host = F.lower(netloc(url))
    out = None
    for name, words in fixed.SITE_TYPES:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(host, F.lit(w))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(fixed.SITE_TYPE_DEFAULT))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":([0-9]+)$", 1).try_cast("int")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def metadata(url: Column) -> Column:
    """Metadata struct for valid URLs (NULL otherwise)."""
    s = F.struct(
        scheme(url).alias("scheme"),
        netloc(url).alias("domain"),
        path(url).alias("path"),
        (query(url) != "").alias("has_query"),
        (fragment(url) != "").alias("has_fragment"),
        (scheme(url) == "https").alias("is_secure"),
        port(url).alias("port"),
        path_segments(url).alias("path_segments"),
        site_type(url).alias("site_type"),
    )
    return F.when(is_valid(url), s)


def verdict(url: Column) -> Column:
    return F.struct(
        is_valid(url).alias("valid"),
        normalized(url).alias("normalized"),
        issues(url).alias("issues"),
        metadata(url).alias("metadata"),
    )


def robots_url(url: Column) -> Column:
    net = netloc(url)
    return F.when(net != "", F.concat(scheme(url), F.lit("://"), net, F.lit("/robots.txt")))


def _remove_dots(p: Column) -> Column:
    segs = F.split(p, "/")
    resolved = F.aggregate(
        F.slice(segs, 2, 1 << 30),
        F.array(F.lit("")),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    return F.array_join(resolved, "/")


def join(base: Column, rel: Column) -> Column:
    """RFC 3986 reference resolution (no validation)."""
    bs, bn, bp, bq = scheme(base), netloc(base), path(base), query(base)
    rs, rn, rp, rq = _part(rel, 1), _part(rel, 2), path(rel), query(rel)
    rel_has_net = F.startswith(F.regexp_replace(rel, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), F.lit("//"))
    rq_part = F.when(F.contains(rel, F.lit("?")), F.concat(F.lit("?"), rq)).otherwise(F.lit(""))
    bq_part = F.when(bq != "", F.concat(F.lit("?"), bq)).otherwise(F.lit(""))
    origin = F.concat(bs, F.lit("://"), bn)
    base_dir = F.regexp_replace(F.when(bp == "", F.lit("/")).otherwise(bp), r"[^/]*$", "")
    return (
        F.when(rel.isNull() | (rel == ""), base)
        .when(rs != "", rel)
        .when(rel_has_net, F.concat(bs, F.lit(":"), rel))
        .when(F.startswith(rp, F.lit("/")), F.concat(origin, _remove_dots(rp), rq_part))
        .when(rp == "", F.concat(origin, bp, F.when(F.contains(rel, F.lit("?")), rq_part).otherwise(bq_part)))
        .otherwise(F.concat(origin, _remove_dots(F.concat(base_dir, rp)), rq_part))
    )


def absolute(base: Column, rel: Column) -> Column:
    """Validate the base, join against its normalised form, validate and
    normalise the result; NULL when either check fails.  (Single-expression
    form; prefer :func:`resolve`, which stages the work in projections.)"""
    joined = join(normalized(base), rel)
    return F.when(is_valid(base), normalized(joined))


def resolve(df, base_col: str, rel_col: str, out_col: str):
    """DataFrame form of :func:`absolute`: each intermediate URL is its own
    projected column, so every regular expression runs once per row instead
    of once per reference."""
    tmp_b, tmp_j = f"__{out_col}_base", f"__{out_col}_joined"
    out = df.withColumn(tmp_b, normalized(F.col(base_col)))
    out = out.withColumn(tmp_j, join(F.col(tmp_b), F.col(rel_col)))
    out = out.withColumn(out_col, F.when(F.col(tmp_b).isNotNull(), normalized(F.col(tmp_j))))
    return out.drop(tmp_b, tmp_j)
