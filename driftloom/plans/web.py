"""Where a run's answers come from: a table of responses, or the live web asked level by level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import part, scope_root
from ..operators import links, responses, robots
from ..operators.tables import bucketed, cut
from ..schemas import RESPONSES
from ..sources import responses as sources
from .spec import MirrorSpec

#: Milliseconds between the assets of a host, before jitter.
ASSET_SPACING = 100


class Judged:
    """Answers with what a run needs of them: page outcomes, asset outcomes, links, references of style sheets; one parse for each page."""

    def __init__(self, table: DataFrame, spec: MirrorSpec, name: str):
        text = F.col("body").cast("string")
        html = responses.is_html(F.col("content_type"))
        rows = table.select(
            "url", "http_status", F.coalesce("content_type", F.lit("")).alias("content_type"), F.octet_length("body").cast("long").alias("size"),
            responses.challenge(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.col("body"), F.col("content_type")).alias("challenge"),
            F.when(F.col("error").isNotNull(), F.coalesce("error.message", "error.kind")).alias("error"), F.col("rendered_html").isNotNull().alias("rendered"),
        )
        scanned = cut(links.scanned(table.filter(html).select("url", text.alias("html"))), f"{name}-scan")
        rows = rows.join(scanned.select(F.col("src_url").alias("url"), "shell"), "url", "left").withColumn("shell", F.coalesce("shell", F.lit(False)))
        self.pages = bucketed(responses.judged_pages(rows, spec.browser, spec.max_file_size), "url", f"{name}-outcomes")
        self.plain = rows.drop("shell", "rendered")
        rendered = self.pages.filter("fetcher = 'playwright'").select("url")
        again = links.scanned(table.join(rendered, "url", "left_semi").select("url", F.col("rendered_html").alias("html")))
        found = scanned.join(rendered, scanned["src_url"] == rendered["url"], "left_anti").unionByName(again)
        self.links = bucketed(links.links(links.flat(found), scope_root(F.lit(spec.url)), spec.subdomains), "src_url", f"{name}-links")
        sheets = table.filter(responses.is_css(F.col("url"), F.col("content_type"))).select("url", text.alias("css"))
        self.nested = cut(links.stylesheet_links(sheets), f"{name}-nested")


class Web(Protocol):
    """What a run asks of its source; rows are a crawl's or an asset round's (url, host, depth, state)."""

    def rules(self, rows: DataFrame) -> DataFrame | None: ...

    def pages(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def assets(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def answers(self) -> DataFrame: ...

    def outcomes(self) -> DataFrame: ...

    def links(self) -> DataFrame: ...


class TableWeb:
    """A finished table (schemas.RESPONSES): everything is judged and parsed once, levels only look it up."""

    def __init__(self, spark: SparkSession, spec: MirrorSpec, table: DataFrame):
        self.spark, self.spec, self.table = spark, spec, table
        self.judged = Judged(table, spec, "table")
        self._rules: DataFrame | None = None

    def rules(self, rows: DataFrame) -> DataFrame | None:
        if self._rules is None:
            hosts = self.judged.links.select(F.col("abs_url").alias("url")).unionByName(self.spark.createDataFrame([(self.spec.url,)], "url string")).unionByName(self.judged.nested.select(F.col("abs_url").alias("url")))
            found, _ = robots.parsed(sources.robots_texts(hosts, self.table), self.spec.user_agent)
            self._rules = cut(found, "rules")
        return self._rules

    def pages(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.judged.pages, self.judged.links

    def assets(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return responses.judged_assets(self.judged.plain.withColumn("depth", F.lit(0)), self.spec.max_file_size), self.judged.nested

    def answers(self) -> DataFrame:
        return self.table

    def outcomes(self) -> DataFrame:
        return self.assets(self.table)[0]

    def links(self) -> DataFrame:
        return self.judged.links


class LiveWeb:
    """The web itself: each level's frontier is fetched, a host by one task, politely; what came back is written before it is judged.

    renderer: url to (HTML or None), asked for what the browser mode wants rendered (sources.render has one)."""

    def __init__(self, spark: SparkSession, spec: MirrorSpec, renderer: Callable[[str], str | None] | None = None):
        self.spark, self.spec, self.renderer = spark, spec, renderer
        self._answers: list[DataFrame] = []
        self._judged: list[Judged] = []
        self._rules = spark.createDataFrame([], "host string, ord int, allow boolean, pattern string, regex string")
        self._delays = spark.createDataFrame([], "host string, crawl_delay double")
        self._hosts = spark.createDataFrame([], "host string")
        self._clock = spark.createDataFrame([], "host string, last_ms long")

    def rules(self, rows: DataFrame) -> DataFrame:
        """Rules of all hosts met so far; robots.txt of the new ones among rows is fetched, once a host."""
        new = rows.select(part(F.col("url"), 1).alias("scheme"), part(F.col("url"), 2).alias("host")).groupBy("host").agg(F.min("scheme").alias("scheme"))
        texts = cut(sources.fetched_robots(new.join(self._hosts, "host", "left_anti"), self.spec.user_agent), "robots")
        found, delays = robots.parsed(texts, self.spec.user_agent)
        self._rules = cut(self._rules.unionByName(found), "rules")
        self._delays = cut(self._delays.unionByName(delays), "delays")
        self._hosts = cut(self._hosts.unionByName(texts.select("host")), "hosts")
        return self._rules

    def _fetched(self, rows: DataFrame, low: int, high: int | None, renderer: Callable[[str], str | None] | None, use_delays: bool) -> Judged:
        frontier = rows.filter("state = 'fetch'").select("url", *(["seq"] if "seq" in rows.columns else [F.xxhash64("url").alias("seq")])).withColumn("host", part(F.col("url"), 2))
        if use_delays:
            frontier = frontier.join(self._delays, "host", "left").withColumn("delay_ms", robots.effective_delay(F.lit(low), F.col("crawl_delay")))
        else:
            frontier = frontier.withColumn("delay_ms", F.lit(float(low)))
        frontier = frontier.join(self._clock, "host", "left")
        s = self.spec
        got = cut(sources.live(frontier, s.user_agent, max_ms=high, most_bytes=s.max_file_size, renderer=renderer, mode=s.browser), "answers")
        #: When each host was last asked, carried over levels and rounds.
        asked = got.select(part(F.col("url"), 2).alias("host"), F.col("asked_ms").alias("last_ms")).unionByName(self._clock)
        self._clock = cut(asked.groupBy("host").agg(F.max("last_ms").alias("last_ms")), "clock")
        got = got.drop("asked_ms")
        self._answers.append(got)
        self._judged.append(Judged(got, s, "live"))
        return self._judged[-1]

    def pages(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        got = self._fetched(rows, self.spec.delay, self.spec.delay_max, self.renderer, True)
        return got.pages, got.links

    def assets(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        got = self._fetched(rows, ASSET_SPACING, None, None, False)
        return responses.judged_assets(got.plain.withColumn("depth", F.lit(0)), self.spec.max_file_size), got.nested

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def answers(self) -> DataFrame:
        return self._all(self._answers, RESPONSES)

    def outcomes(self) -> DataFrame:
        plain = [responses.judged_assets(j.plain.withColumn("depth", F.lit(0)), self.spec.max_file_size) for j in self._judged]
        return self._all(plain, "url string, status string, why string, follow boolean, content_type string")

    def links(self) -> DataFrame:
        return self._all([j.links for j in self._judged], "src_url string, ord int, abs_url string, kind string")
