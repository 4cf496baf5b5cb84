"""Breadth-first crawling over relations: one job for each level, gates before responses are looked up.

The loop moves keys only: links (src_url, ord, abs_url, kind), outcomes (url, status, out_kind, ...) and rules are relations, bodies stay where they
are. Links in buckets of src_url, outcomes in buckets of url (tables.bucketed) are never shuffled, nor are the URLs seen so far, a table in buckets that each level is added to: a
level's own rows go to their buckets. Levels of at most NAMED parents name them, so that the scan of the links opens only their buckets. Each level is written to the shared folder. A level is: enqueue (anti join with what was seen, then exclude), done (resume), robots,
page limit, outcome, harvest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import part, within_depth
from .excludes import flagged
from .robots import allowed
from .tables import Growing, cut, numbered, running

#: Requests of a redirect chain, levels of style sheets that are followed.
MOST_REQUESTS, CSS_DEPTH = 10, 5
#: Most parents of a level that are named to the scan of the links.
NAMED = 500


@dataclass(frozen=True)
class Gates:
    """What a crawl respects; 0 is no limit."""

    max_depth: int = 0
    max_pages: int = 0
    exclude: tuple[str, ...] = ()
    respect_robots: bool = True
    fresh: bool = False
    stop: object = field(default=None, compare=False)  # anything with is_set(): looked at between levels


def first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each url: the first in the order of columns."""
    return rows.groupBy("url").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def following(parents: DataFrame, links: DataFrame) -> DataFrame:
    """parents (src_url, ...) with what they link to; few of them are named to the scan."""
    few = [r["src_url"] for r in parents.select("src_url").limit(NAMED + 1).collect()]
    return parents.join(links.filter(F.col("src_url").isin(few)) if len(few) <= NAMED else links, "src_url")


#: A level's rows to what became of them: outcomes of those to fetch, and links of those whose copies give some.
Visit = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def crawl(
    spark: SparkSession, seed: str, links: DataFrame | None, outcomes: DataFrame | None, gates: Gates, rules: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    done: DataFrame | None = None, visit: Visit | None = None, on_level: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """(url, kind, depth, seq, parent, status, out_kind, fetcher, why, size, harvest): what happens to each page URL, in breadth-first order.

    links hold kind 'page' rows for the walk; outcomes are judged responses (missing ones fail as network errors); done is a relation of
    URLs that an earlier run has, with harvest: whether their saved copy gives links. Where these aren't known beforehand, visit makes them
    level by level, and rules may be a function of a level's rows (url, host, pathname). on_level is told each level's rows and how many wait."""
    level = spark.createDataFrame([(seed, 1, 1, None)], "url string, depth int, seq long, parent long")
    growing, out, attempts, number = Growing(spark, "url", "seen"), [], 0, 1
    seen = growing.add(level.select("url"))
    while True:
        rows = flagged(level, "url", list(gates.exclude), "x")
        if done is not None and not gates.fresh:
            rows = rows.join(done.select("url", F.col("harvest").alias("saved")), "url", "left")
        else:
            rows = rows.withColumn("saved", F.lit(None).cast("boolean"))
        rows = rows.withColumn("host", part(F.col("url"), 2)).withColumn("pathname", part(F.col("url"), 3))
        known = rules(rows) if callable(rules) and gates.respect_robots else rules
        rows = allowed(rows, known) if known is not None and gates.respect_robots else rows.withColumn("allowed", F.lit(True))
        rows = rows.withColumn("state", F.when(F.col("x"), "excluded").when(F.col("saved").isNotNull(), "done").when(~F.col("allowed"), "robots").otherwise("fetch"))
        rows = rows.drop("x", "host", "pathname", "allowed")
        if gates.max_pages or visit:
            rows = cut(rows, "level")
        if gates.max_pages:
            fetched = rows.filter("state = 'fetch'")
            left = gates.max_pages - attempts
            cutoff = fetched.orderBy("seq").limit(left).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
            attempts += cutoff["n"]
            if cutoff["n"] >= left:  # the limit is looked at before each page, so later rows are left alone; excluded ones never wait
                rows = rows.filter((F.col("seq") <= cutoff["last"]) | (F.col("state") == "excluded"))
        if visit:
            outcomes, links = visit(rows)
        answers = outcomes.select("url", "status", "out_kind", "fetcher", "why", "harvest", (F.col("size") if "size" in outcomes.columns else F.lit(0)).cast("long").alias("size"))
        judged = rows.join(answers, "url", "left")
        fetch = F.col("state") == "fetch"
        judged = judged.select(
            "url", "depth", "seq", "parent", "state", "saved", F.lit("page").alias("kind"),
            F.when(fetch, F.coalesce("status", F.lit("failed"))).otherwise(F.col("state")).alias("status"),
            F.when(fetch, F.coalesce("out_kind", F.lit("page"))).otherwise(F.lit("page")).alias("out_kind"),
            F.when(fetch, F.coalesce("fetcher", F.lit("none"))).otherwise(F.lit("none")).alias("fetcher"),
            F.when(fetch, F.when(F.col("status").isNull(), "network").otherwise(F.col("why"))).alias("why"),
            F.when(fetch & (F.col("status") == "ok"), F.coalesce("size", F.lit(0))).otherwise(F.lit(0)).alias("size"),
            F.when(fetch, F.coalesce("harvest", F.lit(False))).otherwise((F.col("state") == "done") & F.coalesce("saved", F.lit(False))).alias("harvest"),
        )
        judged = cut(judged, "judged")
        out.append(judged)
        stopped = (gates.stop is not None and gates.stop.is_set()) or (gates.max_pages and attempts >= gates.max_pages)
        found = 0
        if not stopped:
            pages = links.filter("kind = 'page'").select("src_url", "ord", F.col("abs_url").alias("url"))
            parents = judged.filter("harvest").filter(within_depth(F.col("depth") + 1, gates.max_depth)).select(F.col("url").alias("src_url"), F.col("seq").alias("parent"), "depth")
            fresh = following(parents, pages).select("url", (F.col("depth") + 1).alias("depth"), "parent", "ord")
            fresh = first_seen(fresh, ["parent", "ord"]).join(seen, "url", "left_anti")
            fresh = cut(fresh, "fresh")
            found = fresh.count()  # of a written table
        if on_level:
            on_level(judged, found)
            stopped = stopped or (gates.stop is not None and gates.stop.is_set())
        if stopped or not found:
            break
        level = numbered(fresh, ["parent", "ord", "url"], "seq", number).select("url", "depth", "seq", "parent")
        number += found
        seen = growing.add(fresh.select("url"))
    return reduce(DataFrame.unionByName, out).drop("state", "saved")


def depths(spark: SparkSession, seeds: DataFrame, edges: DataFrame, most: int = 0) -> DataFrame:
    """(url, depth) of what is reached from seeds (url) over edges (src, dst): least number of steps, seeds have 1."""
    level = cut(seeds.select("url").distinct().withColumn("depth", F.lit(1)), "level")
    out = level
    while level.count() and (not most or level.first()["depth"] < most):
        fresh = level.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), F.col("depth") + 1).toDF("url", "depth").distinct()
        level = cut(fresh.join(out, "url", "left_anti"), "level")
        out = out.unionByName(level)
    return out


def asset_jobs(
    spark: SparkSession, found: DataFrame, nested: DataFrame | None, outcomes: DataFrame | None, exclude: tuple[str, ...] = (),
    rules: DataFrame | Callable[[DataFrame], DataFrame] | None = None, done: DataFrame | None = None, visit: Visit | None = None, stop: object = None,
) -> DataFrame:
    """Assets (url) and what their style sheets (nested: src_url, abs_url) need, each at the depth of its first enqueueing: (url, depth, state).

    A round asks for excludes, for what is done, for robots, and follows only sheets that pass (or are done) and are judged `follow`.
    visit makes outcomes and nested round by round where they aren't known beforehand. Style sheets are followed below depth CSS_DEPTH
    only, so there are at most CSS_DEPTH + 1 rounds."""
    level = found.select("url").distinct().withColumn("depth", F.lit(0))
    out = None
    for depth in range(CSS_DEPTH + 1):
        rows = flagged(level, "url", list(exclude), "x").withColumn("host", part(F.col("url"), 2)).withColumn("pathname", part(F.col("url"), 3))
        rows = rows.join(done.select("url", F.lit(True).alias("there")), "url", "left") if done is not None else rows.withColumn("there", F.lit(False))
        known = rules(rows) if callable(rules) else rules
        rows = allowed(rows, known) if known is not None else rows.withColumn("allowed", F.lit(True))
        state = F.when(F.col("x"), "excluded").when(F.coalesce("there", F.lit(False)), "done").when(~F.col("allowed"), "robots").otherwise("fetch")
        level = cut(rows.select("url", "depth", state.alias("state")), "assets")
        out = level if out is None else out.unionByName(level)
        if visit:
            outcomes, nested = visit(level)
        if depth == CSS_DEPTH or (stop is not None and stop.is_set()):
            break
        sheets = level.filter("state in ('fetch', 'done')").join(outcomes.filter("follow").select("url"), "url", "left_semi")
        more = sheets.join(nested, F.col("url") == F.col("src_url")).select(F.col("abs_url").alias("url")).distinct()
        level = more.join(out.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1))
    return out


def redirects(hops: DataFrame, starts: DataFrame, resolve: Column | None = None) -> DataFrame:
    """Chains over hops (url, status, location: absolute or null) from starts (url): at most MOST_REQUESTS requests.

    Returns url, final_url, http_status, requests, error (null, redirect-limit, bad-redirect or network for a URL without a hop)."""
    target = resolve if resolve is not None else F.col("location")
    at = starts.select("url", F.col("url").alias("now")).withColumn("requests", F.lit(0))
    table = hops.select(F.col("url").alias("now"), F.col("status").alias("http_status"), target.alias("target"), F.lit(True).alias("known"))
    ended = []
    for k in range(1, MOST_REQUESTS + 1):
        got = cut(at.join(table, "now", "left").withColumn("requests", F.lit(k)), "hops")
        moved = F.coalesce(F.col("http_status").isin(301, 302, 303, 307, 308), F.lit(False))
        error = F.when(F.col("known").isNull(), "network").when(moved & F.col("target").isNull(), "bad-redirect").when(moved & F.lit(k == MOST_REQUESTS), "redirect-limit")
        got = got.withColumn("error", error).withColumn("end", ~moved | error.isNotNull())
        ended.append(got.filter("end").select("url", F.col("now").alias("final_url"), "http_status", "requests", "error"))
        at = got.filter(~F.col("end")).select("url", F.col("target").alias("now"))
        if not at.head(1):
            break
    return reduce(DataFrame.unionByName, ended)


def delay_schedule(rows: DataFrame, delay_ms: Column, scope: list[str] | None = None) -> DataFrame:
    """rows (seq) with earliest_ms: the sum of the delays of the rows before, within each scope."""
    return running(rows, "seq", {"earliest_ms": delay_ms.cast("double")}, scope or [], -1).withColumn("earliest_ms", F.col("earliest_ms").cast("double"))


def jittered(least: Column, draw: Column) -> Column:
    """A whole number from least to below 1.75 times least; draw is from 0 to below 1 (F.rand())."""
    return least + F.floor(draw * (F.floor(least * 1.75) - least))


def stepped(least: Column, most: Column, step: Column, draw: Column) -> Column:
    """least plus a drawn number of steps, at most up to most (or least, if that is more)."""
    return least + step * F.floor(draw * (F.floor((F.greatest(most, least) - least) / step) + 1))
