"""Rewriting saved content so that it works offline: the plan as joins, the edits as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css as css_fn
from ..functions import html as html_fn
from ..functions import weburl
from ..functions.urls import is_inert, joined_path, normalize, relative_ref, trimmed


def content_references(files: DataFrame) -> DataFrame:
    """(url, path, type html or css, content) to (url, path, base_url, raw_ref), each once for a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, path, kind, text in zip(*(batch.column(k).to_pylist() for k in ("url", "path", "type", "content")), strict=True):
                base, refs = html_fn.rewrite_references(text or "") if kind == "html" else (None, html_fn.css_strings(text or ""))
                at = (weburl.normalize(base, url) if base else None) or url
                out += [(url, path, at, r) for r in refs]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["url", "path", "base_url", "raw_ref"])

    return files.select("url", "path", "type", "content").mapInArrow(run, "url string, path string, base_url string, raw_ref string")


def plan(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """refs (url, path, base_url, raw_ref) with abs_url, action and value (null: leave it), localized.

    Mirrored targets become relative paths; relative refs that mean a file of the mirror stay; absolute ones stay; what is left becomes absolute."""
    ok = manifest.filter("status = 'ok' and path <> ''")
    raw = trimmed(F.col("raw_ref"))
    relative = ~raw.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)")
    rows = refs.withColumn("abs_url", F.when(~is_inert(F.col("raw_ref")), normalize(raw, F.col("base_url"))))
    rows = rows.withColumn("own_path", F.when(F.col("abs_url").isNotNull() & relative, joined_path(F.col("path"), F.regexp_extract(raw, r"^([^?#]*)", 1))))
    #: What can't meet a file has no key; such rows have keys of their own, which match nothing and don't gather in one partition.
    nowhere = F.concat(F.lit("\0"), F.xxhash64("url", "raw_ref").cast("string"))
    rows = rows.withColumns({"url_key": F.coalesce("abs_url", nowhere), "path_key": F.coalesce("own_path", nowhere)})
    rows = rows.join(ok.select(F.col("url").alias("url_key"), F.col("path").alias("target")), "url_key", "left")
    rows = rows.join(ok.select(F.col("path").alias("path_key"), F.lit(True).alias("there")).distinct(), "path_key", "left")
    fragment = F.regexp_extract(raw, r"(#.+)$", 1)
    action = (
        F.when(F.col("abs_url").isNull(), "skipped")
        .when(F.col("target").isNotNull(), "localized")
        .when(F.col("there").isNotNull(), "kept")
        .when(~relative & ~raw.rlike(r"^/(?!/)"), "kept")
        .otherwise("absolutized")
    )
    rows = rows.withColumn("action", action)
    value = F.when(F.col("action") == "localized", F.concat(relative_ref(F.col("path"), F.col("target")), fragment)).when(F.col("action") == "absolutized", F.concat(F.col("abs_url"), fragment))
    return rows.select("url", "path", "base_url", "raw_ref", "abs_url", "action", value.alias("value"), (F.col("action") == "localized").alias("localized"))


def rewritten(files: DataFrame, plan_: DataFrame) -> DataFrame:
    """(url, path, content, changed): each file's edits travel to it as one map."""
    edits = plan_.filter("value is not null").groupBy("url").agg(F.collect_list(F.struct("raw_ref", "value", "localized")).alias("edits"))
    rows = files.select("url", "path", "type", "content").join(edits, "url", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, path, kind, text, edits in zip(*(batch.column(k).to_pylist() for k in ("url", "path", "type", "content", "edits")), strict=True):
                known = {e["raw_ref"]: (e["value"], e["localized"]) for e in edits or ()}
                text = text or ""
                new = html_fn.rewrite_html(text, known.get) if kind == "html" else css_fn.rewrite_css(text, known.get)
                out.append((url, path, new, new != text))
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["url", "path", "content", "changed"])

    return rows.mapInArrow(run, "url string, path string, content string, changed boolean")


def rewritable(manifest: DataFrame) -> DataFrame:
    """ok rows with a path that are HTML or CSS, with type."""
    path = F.lower("path")
    kind = F.when(path.rlike(r"\.html?$"), "html").when(path.endswith(".css") | F.contains(F.lower("content_type"), F.lit("text/css")), "css")
    return manifest.filter("status = 'ok' and path <> ''").withColumn("type", kind).filter("type is not null")


def broken(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Local references (path, raw_ref) of rewritten files that no path of the mirror answers; rows that share url and path are one file, its references come once."""
    local = refs.dropDuplicates(["url", "path", "raw_ref"]).filter(~is_inert(F.col("raw_ref")) & ~F.col("raw_ref").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)"))
    local = local.withColumn("own_path", joined_path(F.col("path"), F.regexp_extract(trimmed(F.col("raw_ref")), r"^([^?#]*)", 1)))
    return local.join(paths.select(F.col("path").alias("own_path")).distinct(), "own_path", "left_anti")


def collisions(paths: DataFrame) -> DataFrame:
    """Local paths that several URLs have: path, urls, first_url, last_url."""
    return paths.groupBy("path").agg(F.count_distinct("url").cast("long").alias("urls"), F.min("url").alias("first_url"), F.max("url").alias("last_url")).filter("urls > 1")


def entry_index(manifest: DataFrame, seed: str) -> DataFrame:
    """One row: the root index.html that leads to the seed's copy, or to the seed itself."""
    row = manifest.filter((F.col("url") == seed) & (F.col("status") == "ok") & (F.col("path") != "")).agg(F.max("path").alias("path"))
    href = F.replace(F.coalesce(F.col("path"), F.lit(seed)), F.lit('"'), F.lit("%22"))
    return row.select(F.lit("index.html").alias("path"), F.concat(F.lit('<!doctype html>\n<meta charset="utf-8">\n<meta http-equiv="refresh" content="0; url='), href, F.lit('">\n<a href="'), href, F.lit('">Open the mirrored site</a>\n')).alias("content"))
