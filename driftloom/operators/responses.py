"""Judging responses: error taxonomy, challenges, size, type, and the decision orders of pages and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Body markers of challenges, in order, with their sources; bytes that are looked at; least visible characters of a page.
MARKERS = (
    ("<title>just a moment", "cloudflare"),
    ("awswafcookiedomainlist", "aws-waf"),
    ("window.gokuprops", "aws-waf"),
    ("cf-mitigated", "cloudflare-header"),
    ("challenges.cloudflare.com", "cloudflare"),
    ("attention required! | cloudflare", "cloudflare"),
    ("checking your browser before accessing", "cloudflare-legacy"),
    ("<title>access denied</title>", "akamai"),
)
SNIFFED, VISIBLE = 4096, 150
MOUNT = r"(?is)<(\w+)[^>]*(?:\sid\s*=\s*[\"']?(?:root|app|__next|__nuxt)(?=[\"'\s>])|data-reactroot)[^>]*>\s*</\1\s*>"


def error_kind(name: Column, code: Column) -> Column:
    """timeout, dns, tls, connection or network, from an error's name and code."""
    code = F.coalesce(code, F.lit(""))
    return (
        F.when(name.isin("AbortError", "TimeoutError"), "timeout")
        .when(code.isin("ENOTFOUND", "EAI_AGAIN"), "dns")
        .when(code.rlike("CERT|TLS|SSL"), "tls")
        .when(code.isin("ECONNRESET", "ECONNREFUSED", "EPIPE"), "connection")
        .otherwise("network")
    )


def error_message(code: Column, message: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", message).otherwise(F.concat(code, F.lit(": "), message))


def is_html(content_type: Column) -> Column:
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(t, F.lit("text/html")) | F.contains(t, F.lit("application/xhtml"))


def is_css(url: Column, content_type: Column) -> Column:
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/css")) | F.lower(path).endswith(".css")


def too_large(body: Column, cap: Column | int) -> Column:
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return (cap > 0) & (F.octet_length(body) > cap)


def header_challenge(headers: Column) -> Column:
    """The source that a response's headers name, or null. Header names are lower-case."""
    said = lambda k: F.lower(F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit(""))) == "challenge"
    return F.when(said("cf-mitigated"), "cloudflare-header").when(said("x-amzn-waf-action"), "aws-waf-header")


def body_challenge(body: Column) -> Column:
    """The source of the first marker in the first bytes of a body, or null."""
    head = F.lower(F.decode(F.substring(body, 1, SNIFFED), "ISO-8859-1"))
    return F.coalesce(*(F.when(F.contains(head, F.lit(m)), F.lit(s)) for m, s in MARKERS))


def pdf_judgement(body: Column) -> Column:
    """For what should be a PDF: null if it is one, else the challenge's source or content-mismatch."""
    return F.when(F.substring(body, 1, 5) == F.unhex(F.lit("255044462D")), None).otherwise(F.coalesce(body_challenge(body), F.lit("content-mismatch")))


def challenge(headers: Column, body: Column, content_type: Column) -> Column:
    return F.coalesce(header_challenge(headers), F.when(is_html(content_type), body_challenge(body)))


def visible_text(html: Column) -> Column:
    """Text of the body without scripts, styles, noscript, templates and tags, white space collapsed: for regular markup."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    body = F.regexp_replace(body, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "")
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(body, r"(?U)\s+", " "))


def is_shell(html: Column) -> Column:
    """Little visible text beside scripts, or a bare mount: an expression for regular markup (functions.html judges any)."""
    scripts = html.rlike(r"(?is)<script\b[^>]*\bsrc\s*=") | html.rlike(r"(?is)<script\b[^>]*>(?!\s*</script)")
    return ((F.length(visible_text(html)) < VISIBLE) & scripts) | html.rlike(MOUNT)


def judged_pages(rows: DataFrame, mode: str = "auto", cap: int = 0) -> DataFrame:
    """Fetched page jobs (url, http_status, content_type, size, challenge, error, shell, rendered) with status, out_kind, fetcher, why, harvest."""
    c = F.col
    render = F.coalesce(c("rendered"), F.lit(False)) & F.lit(mode in ("auto", "always"))
    large = (F.lit(cap) > 0) & (c("size") > cap)
    dynamic = render & (F.lit(mode == "always") | c("shell"))
    cases = [
        (c("error").isNotNull(), "failed", "page", "none", c("error")),
        (large, "too-large", "page", "none", None),
        (c("challenge").isNotNull() & render, "ok", "page", "playwright", None),
        (c("challenge").isNotNull(), "challenge", "page", "none", c("challenge")),
        (c("http_status") >= 400, "failed", "page", "none", F.concat(F.lit("HTTP "), c("http_status").cast("string"))),
        (~is_html(c("content_type")), "ok", "asset", "static", None),
        (dynamic, "ok", "page", "playwright", None),
        (F.lit(True), "ok", "page", "static", None),
    ]
    return _decided(rows, cases).withColumn("harvest", (F.col("status") == "ok") & (F.col("out_kind") == "page"))


def judged_assets(rows: DataFrame, cap: int = 0) -> DataFrame:
    """Fetched asset jobs (url, depth, http_status, content_type, size, error) likewise; follow: whether its style sheet's references are."""
    c = F.col
    cases = [
        (c("error").isNotNull(), "failed", "asset", "none", c("error")),
        ((F.lit(cap) > 0) & (c("size") > cap), "too-large", "asset", "none", None),
        (c("http_status") >= 400, "failed", "asset", "none", F.concat(F.lit("HTTP "), c("http_status").cast("string"))),
        (F.lit(True), "ok", "asset", "static", None),
    ]
    follow = (F.col("status") == "ok") & is_css(c("url"), c("content_type")) & (c("depth") < 5)
    return _decided(rows, cases).withColumn("follow", follow)


def _decided(rows: DataFrame, cases: list) -> DataFrame:
    def chain(k: int) -> Column:
        out = None
        for when, *values in cases:
            v = values[k]
            v = v if isinstance(v, Column) else F.lit(v).cast("string")
            out = F.when(F.coalesce(when, F.lit(False)), v) if out is None else out.when(F.coalesce(when, F.lit(False)), v)
        return out

    return rows.withColumns({"status": chain(0), "out_kind": chain(1), "fetcher": chain(2), "why": chain(3)})
