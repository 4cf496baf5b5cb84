"""A whole run: crawl, assets, manifest, rewriting, report; and a handle to start and stop it."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import local_path, normalize, scope_root
from ..operators import crawl, links, manifest, responses, rewrite
from ..operators.tables import cut, numbered
from ..sources.responses import rescanned
from .spec import MirrorSpec
from .web import LiveWeb, TableWeb, Web


@dataclass
class Mirror:
    """What a run gives: relations, not files (sources.sinks writes them). progress has a row for each URL that left the queue (schemas.PROGRESS)."""

    manifest: DataFrame
    rewritten: DataFrame
    entry: DataFrame
    report: dict
    interrupted: bool
    answers: DataFrame
    progress: DataFrame


@dataclass
class Earlier:
    """What an earlier run left: its ok rows, whether their saved copies can be harvested, and what these refer to."""

    done: DataFrame
    links: DataFrame | None
    nested: DataFrame | None


def earlier(previous: DataFrame, saved: DataFrame | None, spec: MirrorSpec) -> Earlier:
    """Saved pages and style sheets (path, content) are scanned again instead of fetched; without them, links come from the responses."""
    done = previous.filter("status = 'ok'").select("url", "path", "kind")
    if saved is None:
        return Earlier(done.select("url", (F.col("kind") == "page").alias("harvest")), None, None)
    copies = cut(rescanned(previous, saved, F.col("kind").isin("page", "asset")).join(previous.select("url", "kind"), "url"), "saved")
    done = done.join(copies.select("url", F.lit(True).alias("there")), "url", "left")
    text = F.col("content").cast("string")
    scans = links.scanned(copies.filter("kind = 'page'").select("url", text.alias("html")))
    found = cut(links.links(links.flat(scans), scope_root(F.lit(spec.url)), spec.subdomains), "saved-links")
    sheets = copies.filter("kind = 'asset'").filter(responses.is_css(F.col("url"), F.col("content_type"))).select("url", text.alias("css"))
    nested = cut(links.stylesheet_links(sheets), "saved-nested")
    return Earlier(cut(done.select("url", ((F.col("kind") == "page") & F.coalesce("there", F.lit(False))).alias("harvest")), "done"), found, nested)


def mirror(
    spark: SparkSession, spec: MirrorSpec, table: DataFrame | None = None, previous: DataFrame | None = None, stop: threading.Event | None = None,
    on_progress: Callable[[dict], None] | None = None, saved: DataFrame | None = None, web: Web | None = None,
) -> Mirror:
    """Run spec over responses (schemas.RESPONSES), or without a table over the live web, level by level.

    previous is the manifest of an earlier run, whose ok rows aren't fetched again; saved (path, content) are its files, which are scanned for what
    they refer to. on_progress hears of each level and round; stop is looked at between them."""
    seed = spark.range(1).select(normalize(F.lit(spec.url)).alias("u")).first()["u"]
    if seed is None:
        raise ValueError(f"not a URL: {spec.url}")
    stop = stop or threading.Event()
    web = web or (TableWeb(spark, spec, table) if table is not None else LiveWeb(spark, spec))
    rules = web.rules if spec.respect_robots else None
    old = earlier(previous, saved, spec) if previous is not None and not spec.fresh else None
    so_far = {"phase": "crawl", "pages_done": 0, "assets_done": 0, "queue_size": 1, "bytes": 0, "failures": 0, "current_url": seed}

    def both(now: DataFrame, more: DataFrame | None, *columns: str) -> DataFrame:
        now = now.select(*columns)
        return now if more is None else now.unionByName(more.select(*columns))

    def visit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        outcomes, found = web.pages(rows)
        return outcomes, both(found, old.links if old else None, "src_url", "ord", "abs_url", "kind")

    def on_level(rows: DataFrame, waiting: int) -> None:
        if on_progress:
            ok, page = F.col("status") == "ok", F.col("out_kind") == "page"
            n = rows.agg(F.count_if(ok & page).alias("pages_done"), F.count_if(ok & ~page).alias("assets_done"), F.count_if(F.col("status").isin(*manifest.FAILURES)).alias("failures"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max_by("url", "seq").alias("current_url")).first()
            so_far.update({k: so_far[k] + n[k] for k in ("pages_done", "assets_done", "failures", "bytes")} | {"queue_size": waiting, "current_url": n["current_url"] or seed})
            on_progress(dict(so_far))

    gates = crawl.Gates(spec.max_depth, spec.max_pages, spec.exclude, spec.respect_robots, spec.fresh, stop)
    walked = cut(crawl.crawl(spark, seed, None, None, gates, rules, old.done if old else None, visit, on_level), "walked")

    every_link = both(web.links(), old.links if old else None, "src_url", "abs_url", "kind")
    wanted = walked.filter("harvest").select(F.col("url").alias("src_url")).join(every_link.filter("kind = 'asset'"), "src_url").select(F.col("abs_url").alias("url")).distinct()
    wanted = wanted.join(walked.filter("status = 'ok'").select("url"), "url", "left_anti")  # a page that is there serves as asset too
    if stop.is_set():
        wanted = wanted.limit(0)  # the queue is left as it is

    def visit_assets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        outcomes, nested = web.assets(rows)
        follow = outcomes.filter("follow").select("url", "follow")
        if old and old.nested is not None:
            follow = follow.unionByName(old.nested.select(F.col("src_url").alias("url"), F.lit(True).alias("follow")).distinct())
        return follow, both(nested, old.nested if old else None, "src_url", "abs_url")

    jobs = cut(crawl.asset_jobs(spark, cut(wanted, "wanted"), None, None, spec.exclude, rules, old.done if old else None, visit_assets, stop), "jobs")
    jobs = jobs.filter("state <> 'done'")
    assets = jobs.join(web.outcomes().select("url", "status", "why"), "url", "left")
    if stop.is_set():
        assets = assets.filter("state <> 'fetch' or status is not null")
    state = F.when(F.col("state") == "fetch", F.coalesce("status", F.lit("failed"))).otherwise(F.col("state"))
    last = walked.agg(F.max("seq").alias("s")).first()["s"]
    numbers = numbered(assets.select("url", "depth", F.lit("asset").alias("out_kind"), state.alias("status"), F.when(state == "ok", "static").otherwise("none").alias("fetcher"), F.when(state == "failed", F.coalesce("why", F.lit("network"))).alias("why")), ["depth", "url"], "seq", last)

    written = walked.filter("status <> 'done'").select("url", "out_kind", "status", "fetcher", "why", "seq").unionByName(numbers.drop("depth"))
    answers = web.answers()
    body = answers.select("url", "content_type", F.coalesce(F.col("rendered_html").cast("binary"), F.col("body")).alias("rendered"), "body")
    rows = written.join(body, "url", "left")
    ok, answered = F.col("status") == "ok", ~F.col("status").isin("robots", "excluded")
    content = F.when(F.col("fetcher") == "playwright", F.col("rendered")).otherwise(F.col("body"))
    rows = rows.select(
        "url", F.when(ok, local_path(F.col("url"), F.col("out_kind"))).otherwise("").alias("path"), "status", F.col("out_kind").alias("kind"), F.when(answered, F.coalesce("content_type", F.lit(""))).otherwise("").alias("content_type"),
        F.when(ok, F.sha2(content, 256)).otherwise("").alias("sha256"), F.when(ok, F.octet_length(content)).otherwise(0).cast("long").alias("size_bytes"), "fetcher", F.col("why").alias("error"), "seq",
    )
    entries = manifest.latest(rows)
    entries = cut(manifest.merged(previous, entries) if previous is not None and not spec.fresh else entries, "manifest")
    counts = manifest.report(entries).first().asDict()

    if on_progress:
        on_progress(so_far | {"phase": "rewrite", "queue_size": 0, "pages_done": counts["pages"], "assets_done": counts["assets"], "bytes": counts["bytes"], "current_url": seed})
    files = rewrite.rewritable(entries).select("url", "path", "type", "fetcher").join(body, "url")
    files = files.select("url", "path", "type", F.when(F.col("fetcher") == "playwright", F.col("rendered")).otherwise(F.col("body")).cast("string").alias("content"))
    if old and saved is not None:  # what the earlier run saved and nobody answered now
        kept = rewrite.rewritable(entries).join(answers.select("url"), "url", "left_anti").select("url", "path", "type").join(saved.select("path", F.col("content").cast("string").alias("content")), "path")
        files = files.unionByName(kept.select("url", "path", "type", "content"))
    done_files = rewrite.rewritten(files, rewrite.plan(rewrite.content_references(files), entries)) if not stop.is_set() and spec.rewrite else files.select("url", "path", "content", F.lit(False).alias("changed"))
    return Mirror(entries, done_files, rewrite.entry_index(entries, seed), counts, stop.is_set(), answers, progress_of(walked, last, numbers, entries))


def progress_of(walked: DataFrame, last: int, assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Counters after each URL that left the queue, in order; last: the number of the last page."""
    put = walked.filter("parent is not null").groupBy(F.col("parent").alias("seq")).agg(F.count("*").alias("enqueued"))
    pages = walked.select("url", "seq").join(put, "seq", "left").select("url", "seq", F.coalesce("enqueued", F.lit(0)).alias("enqueued"))
    assets = assets.select("url", "seq", F.lit(0).cast("long").alias("enqueued"))
    more = assets.count()  # the last page puts the assets into the queue
    pages = pages.select("url", "seq", (F.col("enqueued") + F.when(F.col("seq") == last, F.lit(more)).otherwise(0)).alias("enqueued"))
    log = pages.unionByName(assets).join(entries.select("url", "status", "kind", "size_bytes"), "url")
    return manifest.progress(log)


class Engine(Protocol):
    """Anything that runs a spec: the engine over responses, or a stand-in."""

    def __call__(self, spec: MirrorSpec, stop: threading.Event, on_progress: Callable[[dict], None]) -> object: ...


class Run:
    """A started run: idle, running, stopping, done or error; stop() asks it to end after its level."""

    def __init__(self, engine: Engine, spec: MirrorSpec):
        self.engine, self.spec = engine, spec
        self.status, self.progress, self.result, self.error = "idle", {}, None, None
        self._stop, self._thread = threading.Event(), None

    def start(self) -> Run:
        if self.status in ("running", "stopping"):
            raise RuntimeError("already running")
        self.status = "running"
        self._thread = threading.Thread(target=self._go, daemon=True)
        self._thread.start()
        return self

    def _go(self) -> None:
        try:
            self.result = self.engine(self.spec, self._stop, self.progress.update)
            self.status = "done"
        except Exception as e:  # shown to whoever asks for the state
            self.error, self.status = str(e), "error"

    def stop(self) -> None:
        if self.status != "running":
            raise RuntimeError("not running")
        self.status = "stopping"
        self._stop.set()

    def wait(self, timeout: float | None = None) -> Run:
        if self._thread:
            self._thread.join(timeout)
        return self

    def state(self) -> dict:
        return {"status": self.status, "progress": dict(self.progress), "error": self.error}


def stop_on_signal(run: Run, last: Callable[[], None] | None = None) -> None:
    """The first signal asks the run to stop, a second one ends the process (after `last`)."""

    def handle(number, frame):
        if run.status == "running":
            run.stop()
        else:
            if last:
                last()
            raise SystemExit(130)

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, handle)


__all__ = ["Mirror", "Run", "Engine", "mirror", "stop_on_signal"]
