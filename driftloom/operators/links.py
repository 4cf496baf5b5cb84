"""The links relation: references of pages and style sheets as rows, resolved and classified."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, weburl
from ..functions.css import css_refs
from ..functions.urls import extension, in_scope, is_page_extension, normalize, part

#: a[href] in regular markup; scripts and comments are cut out before.
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"'>]*)[\"']"
SCRIPTS = r"(?is)<script\b.*?</script\s*>|<!--.*?-->"


def anchors(page_html: Column) -> Column:
    """Raw a[href] values of regular markup, in order, as an expression."""
    plain = F.regexp_extract_all(F.regexp_replace(page_html, SCRIPTS, ""), F.lit(ANCHOR), F.lit(1))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = _each_replaced(plain, entity, char)
    return plain


def _each_replaced(values: Column, old: str, new: str) -> Column:
    return F.transform(values, lambda v: F.replace(v, F.lit(old), F.lit(new)))


SCANNED = "src_url string, shell boolean, base_url string, refs array<struct<source: string, ord: int, raw_ref: string, abs_url: string>>"


def scanned(pages: DataFrame) -> DataFrame:
    """(url, html) to SCANNED, one row and one parse for each page: whether it is a shell, its base, its references resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("source", pa.string()), ("ord", pa.int32()), ("raw_ref", pa.string()), ("abs_url", pa.string())])
        for batch in batches:
            shells, bases, found = [], [], []
            urls, texts = (batch.column(k).to_pylist() for k in ("url", "html"))
            for url, text in zip(urls, texts, strict=True):
                base, refs = html.references(text or "")
                at = (weburl.normalize(base, url) if base else None) or url
                shells.append(html.needs_rendering(text or ""))
                bases.append(at)
                found.append([(rule, k, ref, weburl.normalize(ref, at)) for k, (rule, ref) in enumerate(refs)])
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(shells, pa.bool_()), pa.array(bases, pa.string()), pa.array(found, pa.list_(item))], names=["src_url", "shell", "base_url", "refs"])

    return pages.select("url", "html").mapInArrow(run, SCANNED)


def flat(scans: DataFrame) -> DataFrame:
    """SCANNED to one row for each reference: src_url, base_url, source, ord, raw_ref, abs_url."""
    return scans.select("src_url", "base_url", F.inline("refs"))


def page_references(pages: DataFrame) -> DataFrame:
    """(url, html) to (src_url, base_url, source, ord, raw_ref, abs_url) by a full scan of the markup, one parse a page."""
    return flat(scanned(pages))


def regular_references(pages: DataFrame) -> DataFrame:
    """The same for pages whose only references are a[href], without leaving the plan."""
    found = pages.select("url", F.posexplode(anchors(F.col("html"))).alias("ord", "raw_ref"))
    return found.select(F.col("url").alias("src_url"), F.col("url").alias("base_url"), F.lit("a").alias("source"), "ord", "raw_ref", normalize(F.col("raw_ref"), F.col("url")).alias("abs_url"))


def links(refs: DataFrame, root: Column, subdomains: bool = True) -> DataFrame:
    """References to links: unresolved ones and pages out of scope go, kind is page or asset, each target once for a page and kind."""
    scoped = in_scope(F.col("abs_url"), root, subdomains)
    ext = extension(F.regexp_extract(part(F.col("abs_url"), 3), r"([^/]*)$", 1))
    kind = F.when(F.col("source") == "a", F.when(scoped, F.when(is_page_extension(ext), "page").otherwise("asset"))).when(F.col("source") == "iframe", F.when(scoped, "page")).otherwise("asset")
    rows = refs.filter("abs_url is not null").withColumn("kind", kind).filter("kind is not null")
    first = Window.partitionBy("src_url", "kind", "abs_url").orderBy("ord")
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def stylesheet_links(sheets: DataFrame) -> DataFrame:
    """(url, css) to (src_url, ord, raw_ref, abs_url), each target once."""
    rows = sheets.select(F.col("url").alias("src_url"), F.posexplode(css_refs(F.col("css"))).alias("ord", "raw_ref"))
    rows = rows.withColumn("abs_url", normalize(F.col("raw_ref"), F.col("src_url"))).filter("abs_url is not null")
    first = Window.partitionBy("src_url", "abs_url").orderBy("ord")
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
