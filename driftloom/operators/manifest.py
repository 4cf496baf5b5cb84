"""The manifest: last write wins, merging runs, progress and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Reasons shown for statuses without an error text.
REASONS = {
    "failed": "Fetch failed",
    "too-large": "Exceeded the maximum file size",
    "challenge": "Blocked by an anti-bot challenge",
    "robots": "Disallowed by robots.txt",
    "excluded": "Matched an exclude pattern",
}
FAILURES = ("failed", "too-large", "challenge")


def latest(log: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """One row for each key, the last written. A partial aggregate meets the log before it is shuffled."""
    columns = log.columns
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("row")).select("row.*")


def stub(rows: DataFrame, status: Column, kind: Column, error: Column | None = None, content_type: Column | None = None) -> DataFrame:
    """Rows (url, seq) of outcomes without content: empty strings, not nulls; only error may be null."""
    return rows.select(
        "url", F.lit("").alias("path"), status.alias("status"), kind.alias("kind"), F.coalesce(content_type if content_type is not None else F.lit(""), F.lit("")).alias("content_type"),
        F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"), F.lit("none").alias("fetcher"), (error if error is not None else F.lit(None)).cast("string").alias("error"), F.col("seq").cast("long").alias("seq"),
    )


def digests(rows: DataFrame, body: str) -> DataFrame:
    """sha256 and size of stored content (text or bytes)."""
    return rows.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256)).withColumn("size_bytes", F.octet_length(body).cast("long"))


def merged(previous: DataFrame, current: DataFrame) -> DataFrame:
    """A resumed run: rows of the current one win, whatever their numbers."""
    both = previous.withColumn("run_", F.lit(0)).unionByName(current.withColumn("run_", F.lit(1)))
    return latest(both.withColumn("order_", F.struct("run_", "seq")), "url", "order_").drop("run_", "order_")


def report(manifest: DataFrame) -> DataFrame:
    """One row: pages, assets, bytes, robots_skipped, excluded, failures."""
    n = lambda c: F.count_if(c).cast("long")
    s, k = F.col("status"), F.col("kind")
    return manifest.agg(
        n((s == "ok") & (k == "page")).alias("pages"), n((s == "ok") & (k == "asset")).alias("assets"),
        F.coalesce(F.sum(F.when(s == "ok", F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"),
        n(s == "robots").alias("robots_skipped"), n(s == "excluded").alias("excluded"), n(~s.isin("ok", "robots", "excluded")).alias("failures"),
    )


def failures(manifest: DataFrame) -> DataFrame:
    """url, category, reason of everything that isn't ok, robots or excluded: a relation, however many there are."""
    reasons = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    rows = manifest.filter(~F.col("status").isin("ok", "robots", "excluded"))
    return rows.select("url", F.col("status").alias("category"), F.coalesce(F.nullif("error", F.lit("")), F.try_element_at(reasons, F.col("status")), F.col("status")).alias("reason"))


def progress(log: DataFrame, scope: list[str] | None = None, phase: str = "crawl") -> DataFrame:
    """Counters after each event of a log in which a URL may be written again (then its earlier row stops counting).

    scope: columns whose values number events of their own (a host, a run). Logs with `enqueued` (URLs that the event put into the queue, which
    starts with one) have queue_size: what waits after the event."""
    scope = scope or []
    own = Window.partitionBy(*scope, "url").orderBy("seq")
    delta = lambda now, was: (now.cast("long") - F.coalesce(was.cast("long"), F.lit(0)))
    flags = {
        "pages_done": (F.col("status") == "ok") & (F.col("kind") == "page"),
        "assets_done": (F.col("status") == "ok") & (F.col("kind") == "asset"),
        "failures": F.col("status").isin(*FAILURES),
    }
    rows = log
    for name, flag in flags.items():
        rows = rows.withColumn(f"d_{name}", delta(flag, F.lag(flag).over(own)))
    size = F.when(F.col("status") == "ok", F.col("size_bytes")).otherwise(F.lit(0))
    rows = rows.withColumn("d_bytes", size - F.coalesce(F.lag(size).over(own), F.lit(0)))
    sums = {n: F.col(f"d_{n}") for n in (*flags, "bytes")}
    if "enqueued" in log.columns:
        sums["queued"] = F.col("enqueued").cast("long") - 1
    rows = tables.running(rows, "seq", sums, scope)
    queue = [(F.col("queued") + 1).cast("long").alias("queue_size")] if "queued" in sums else []
    return rows.select(*scope, "seq", F.lit(phase).alias("phase"), *(F.col(n).cast("long").alias(n) for n in (*flags, "bytes")), *queue, F.col("url").alias("current_url"))
