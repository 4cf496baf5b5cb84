"""Registered queries of the engine's own operators: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import css, urls
from .operators import crawl, excludes, links, manifest, responses, rewrite, robots, tables
from .plans import catalog
from .sources.manifest_log import ManifestLog
from .streaming.crawl import CrawlStream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCOPE_ROOTS = ("example.com", "example.net", "example.org", "www.example.com", "com")
AGENT = "Mozilla/5.0 (compatible; Driftloom/1.0)"
C = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the full markup scan; each page's own host is its scope."""
    rows = pages(spark, sf_dir).select(F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    return links.links(links.page_references(rows), urls.scope_root(C("src_url")))


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: what rewriting does with the links of its pages."""
    own = pages(spark, sf_dir).select(F.regexp_replace("url", "#.*$", "").alias("url")).distinct()
    mirrored = own.select(C("url").alias("abs_url"), F.lit(True).alias("there"))
    rows = page_links(spark, sf_dir).join(mirrored, "abs_url", "left").withColumn("host", urls.hostname(C("src_url")))
    action = F.when(C("there"), "localized").otherwise("absolutized")
    return rows.groupBy("host", "kind", action.alias("action")).agg(F.count("*").alias("links"), F.count_distinct("abs_url").alias("targets"), F.min(urls.local_path(C("abs_url"), C("kind"))).alias("first_path"))


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", urls.normalize(C("url")).alias("normalized"), urls.hostname(C("url")).alias("host"))


@query
def url_resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.spread(spark, sf_dir, fx.NORMALIZE, "ref string, base string")
    return rows.select("ref", "base", urls.normalize(C("ref"), C("base")).alias("resolved"))


@query
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and hard cases against several roots, with and without subdomains."""
    rows = fx.frame(spark, fx.SCOPE, "url string, root string")
    roots = F.explode(F.array(*(F.lit(r) for r in SCOPE_ROOTS)))
    rows = rows.unionByName(pages(spark, sf_dir).select("url", roots.alias("root")))
    return rows.select("url", "root", urls.in_scope(C("url"), C("root"), True).alias("with_sub"), urls.in_scope(C("url"), C("root"), False).alias("without_sub"))


@query
def scope_filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within the scope of page 0, subdomains included."""
    root = pages(spark, sf_dir).filter("page_id = 0").agg(F.min(urls.scope_root(C("url")))).first()[0]
    return pages(spark, sf_dir).filter(urls.in_scope(C("url"), F.lit(root), True)).select("page_id", "url")


@query
def exclude_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that each pattern excludes: a theta semi join on contains with a handful of patterns."""
    marks = [F.struct(F.lit(n).alias("name"), urls.excluded(C("url"), [p] if p is not None else []).alias("hit")) for n, p in fx.EXCLUDES]
    rows = pages(spark, sf_dir).select("page_id", "url", F.inline(F.array(*marks)))
    return rows.filter("hit").select("name", "page_id")


@query
def exclude_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and page addresses by how many of some thousand patterns they contain: every pair of neighbouring words of the benchmark, and its words of ten letters and more."""
    words = F.split(F.lower("text"), "[^a-z]+")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words.alias("w"))
    patterns = rows.select(F.explode(F.concat(F.filter(pairs, lambda p: F.length(p) >= 8), F.filter("w", lambda w: F.length(w) >= 4))).alias("pattern"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("document "), C("doc_id").cast("string")).alias("name"), "text")
    texts = texts.unionByName(pages(spark, sf_dir).select(F.concat(F.lit("page "), C("page_id").cast("string")).alias("name"), C("url").alias("text")))
    return excludes.contained(texts, "name", "text", patterns).groupBy("name").agg(F.count("*").alias("patterns"), F.min("pattern").alias("first_pattern"))


@query
def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths and limits (none, 0 and others) as events give them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (C("event_id") % 7 + 1).cast("int").alias("depth"), F.when(C("user_id") % 5 < 4, (C("user_id") % 5).cast("int")).alias("most"))
    return rows.select("event_id", "depth", "most", urls.within_depth(C("depth"), C("most")).alias("inside"))


@query
def url_to_path_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_links(spark, sf_dir).filter("kind = 'page'").select(C("abs_url").alias("url")).union(pages(spark, sf_dir).select(urls.normalize(C("url")))).distinct()
    return rows.select("url", urls.local_path(C("url"), F.lit("page")).alias("path"))


@query
def url_to_path_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select(urls.normalize(C("url")).alias("url")).distinct()
    return rows.select("url", urls.local_path(C("url"), F.lit("asset")).alias("path"))


@query
def segment_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard cases and every segment of the paths that pages link to."""
    found = page_links(spark, sf_dir).select(F.explode(F.split(urls.part(C("abs_url"), 3), "/")).alias("seg")).filter("seg <> ''").distinct()
    return fx.frame(spark, fx.SEGMENTS, "seg string").union(found).distinct().select("seg", urls.sanitize_host(C("seg")).alias("host_form"), urls.sanitize_segment(C("seg")).alias("path_form"), urls.extension(C("seg")).alias("ext"))


@query
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages and links, and variants of them, that share a local path."""
    own = pages(spark, sf_dir).select(urls.normalize(C("url")).alias("url")).union(page_links(spark, sf_dir).select("abs_url"))
    other = F.when(C("url").startswith("https:"), F.regexp_replace("url", "^https:", "http:")).otherwise(F.regexp_replace("url", "^http:", "https:"))
    rows = own.distinct().select(F.explode(F.array("url", other)).alias("url")).distinct().select("url", urls.local_path(C("url"), F.lit("page")).alias("path"))
    return rewrite.collisions(rows)


@query
def relative_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = fx.frame(spark, fx.PATH_PAIRS, "source string, target string")
    rows = page_links(spark, sf_dir).select(urls.local_path(C("src_url"), F.lit("page")).alias("source"), urls.local_path(C("abs_url"), C("kind")).alias("target")).distinct()
    return rows.unionByName(cases).select("source", "target", urls.relative_ref(C("source"), C("target")).alias("ref"))


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of regular markup without leaving the plan."""
    rows = pages(spark, sf_dir).select(F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    return links.links(links.regular_references(rows), urls.scope_root(C("src_url"))).select("src_url", "abs_url", "kind")


@query
def extract_links_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same relation by the full markup scan."""
    return page_links(spark, sf_dir).select("src_url", "abs_url", "kind")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text (its markup taken for text) behind markup of all kinds, under a URL of its own."""
    shapes = fx.spread(spark, sf_dir, fx.MARKUP, "url string, html string").withColumnRenamed("html", "shape")
    text = F.regexp_replace("html", "[<>]", " ")
    return shapes.join(pages(spark, sf_dir).select("page_id", text.alias("text")), "page_id").select("url", F.concat("shape", F.lit("<p>"), "text").alias("html"))


@query
def extract_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction rule on markup that pages don't have, and on theirs behind it."""
    refs = links.page_references(marked_pages(spark, sf_dir))
    return links.links(refs, urls.scope_root(C("src_url"))).select("src_url", "abs_url", "kind")


@query
def effective_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_references(marked_pages(spark, sf_dir)).select(C("src_url").alias("url"), "base_url").distinct()


@query
def inert_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, among the pages' own and others."""
    found = pages(spark, sf_dir).select("page_id", F.explode(links.anchors(C("html"))).alias("ref"))
    rows = found.unionByName(fx.spread(spark, sf_dir, fx.INERT, "ref string"))
    return rows.select("page_id", "ref", urls.is_inert(C("ref")).alias("inert"))


@query
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and durations as people read them, over events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (C("event_id") * C("event_id") * 37).alias("n"))
    return rows.select("event_id", urls.human_bytes(C("n")).alias("size"), urls.format_duration(C("n")).alias("duration"))


@query
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as names of files, folders and numbered downloads."""
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat(C("url"), F.lit("  a:b*\t?"), F.repeat(F.lit(" long|name"), F.pmod("page_id", F.lit(15)).cast("int"))).alias("name"))
    number = urls.numbered_filename(C("url"), C("page_id").cast("int")), urls.numbered_filename(C("url"), C("page_id").cast("int"), F.when(C("page_id") % 2 == 0, F.lit("Re<port>.PDF")))
    return rows.select("page_id", urls.safe_filename(C("name"), ".html").alias("file"), urls.safe_dirname(C("name")).alias("folder"), number[0].alias("numbered"), number[1].alias("suggested"))


@query
def css_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.stylesheet_links(fx.spread(spark, sf_dir, fx.SHEETS, "url string, css string")).select("src_url", "abs_url")


@query
def srcset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.spread(spark, sf_dir, fx.SRCSETS, "value string")
    return rows.select("page_id", "value", F.posexplode(css.srcset(C("value"))).alias("pos", "c")).select("page_id", "value", C("pos").cast("long").alias("pos"), "c.url", "c.descriptor")


@query
def srcset_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.create_map(F.lit("a.png"), F.lit("local/a.png"), F.lit("only.png"), F.lit("../only.png"))
    return fx.spread(spark, sf_dir, fx.SRCSETS, "value string").select("page_id", "value", css.rewritten_srcset(C("value"), mapping).alias("rewritten"))


@query
def js_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = responses.visible_text(C("html"))
    return pages(spark, sf_dir).select("page_id", F.length(text).cast("long").alias("visible"), responses.is_shell(C("html")).alias("shell"))


@query
def js_shell_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mounts, scripts and little text by the full markup scan."""
    rows = fx.spread(spark, sf_dir, fx.SHELLS, "attribute string, inner string, script int, words int")
    body = F.concat(F.lit("<html><body><div "), "attribute", F.lit(">"), "inner", F.lit("</div><p>"), F.repeat(F.lit("word "), (C("words") + C("page_id") % 35).cast("int")), F.lit("</p>"), F.when(C("script") == 1, "<script>go()</script>").otherwise(""), F.lit("</body></html>"))
    return links.scanned(rows.select(C("page_id").cast("string").alias("url"), body.alias("html"))).select(C("src_url").cast("long").alias("page_id"), "shell")


@query
def challenge_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.spread(spark, sf_dir, fx.BODIES, "header string, front string, content_type string").join(pages(spark, sf_dir).select("page_id", "html"), "page_id").withColumn("body", F.concat("front", "html"))
    headers = F.when(C("header") != "", F.create_map(C("header"), F.lit("Challenge"))).otherwise(F.create_map().cast("map<string,string>"))
    body = C("body").cast("binary")
    return rows.select("page_id", responses.challenge(headers, body, C("content_type")).alias("challenge"), responses.pdf_judgement(body).alias("as_pdf"))


@query
def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers over whole tables; some documents end with one, which counts if it lies within the bytes that are looked at."""
    body = F.concat(C("text"), F.when(C("doc_id") % 3 == 0, " CF-Mitigated").when(C("doc_id") % 3 == 1, " <Title>Access denied</title>").otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", responses.body_challenge(body.cast("binary")).alias("source"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"))


@query
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, delays = robots.parsed(fx.spread(spark, sf_dir, fx.ROBOTS, "host string, text string"), AGENT)
    return rules.select("host", "ord", "allow", "pattern", "regex").join(delays, "host", "left").select("host", C("ord").cast("long").alias("ord"), "allow", "pattern", "regex", "crawl_delay")


@query
def robots_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.spread(spark, sf_dir, fx.ROBOTS, "host string, text string")
    rules, _ = robots.parsed(texts, AGENT)
    rows = texts.select("page_id", "host").join(fx.spread(spark, sf_dir, [(p,) for p in fx.ROBOT_PATHS], "pathname string", True), "page_id")
    return robots.allowed(rows, rules).select("host", "pathname", "allowed")


@query
def robots_match_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = robots.parsed(catalog.robots(spark), AGENT)
    rows = catalog.site_responses(spark, sf_dir).select("url", urls.part(C("url"), 2).alias("host"), urls.part(C("url"), 3).alias("pathname"))
    return robots.allowed(rows, rules).groupBy(F.split("pathname", "/")[1].alias("section"), "allowed").agg(F.count("*").alias("urls"))


@query
def effective_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.spread(spark, sf_dir, fx.ROBOTS, "host string, text string")
    _, delays = robots.parsed(texts, AGENT)
    return texts.select("host").join(delays, "host", "left").select("host", robots.effective_delay(F.lit(2500), C("crawl_delay")).alias("delay_ms"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a write log: users are hosts, a hundred URLs each."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        C("event_id").alias("seq"), F.concat(F.lit("https://host"), C("user_id").cast("string"), F.lit(".test")).alias("host"),
        F.concat(F.lit("https://host"), C("user_id").cast("string"), F.lit(".test/p"), (C("event_id") % 100).cast("string")).alias("url"),
        F.when(C("event_type") == "error", "failed").when(C("event_type") == "signup", "robots").otherwise("ok").alias("status"),
        F.when(C("event_type") == "click", "asset").otherwise("page").alias("kind"), F.floor(F.abs("value") * 100).cast("long").alias("size_bytes"),
    )


@query
def delay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("delay", F.when(C("status") == "robots", 0.0).otherwise(500.0))
    return crawl.delay_schedule(rows, C("delay"), ["host"]).select("seq", "host", "earliest_ms")


@query
def delay_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays for draws that events give."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.pmod(C("event_id") * 7919, F.lit(1000)) / 1000).alias("draw"), (C("user_id") % 2000).cast("int").alias("least"))
    return rows.select("event_id", crawl.jittered(C("least"), C("draw")).alias("jittered"), crawl.stepped(C("least"), F.lit(900), F.lit(100), C("draw")).alias("stepped"))


@query
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.spread(spark, sf_dir, fx.ERRORS, "name string, code string, message string")
    return rows.select("page_id", responses.error_kind(C("name"), C("code")).alias("kind"), responses.error_message(C("code"), C("message")).alias("message"))


@query
def fetch_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page decision order over responses made from events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (F.pmod(C("event_id"), F.lit(13)) == 0).alias("bad"), F.when(F.pmod(C("event_id"), F.lit(13)) == 0, "timeout").alias("error"),
        (F.lit(100) + F.pmod(C("event_id") * 7, F.lit(900))).alias("size"), F.when(F.pmod(C("event_id"), F.lit(11)) == 0, "cloudflare").alias("challenge"),
        F.when(C("event_type") == "error", 404).otherwise(200).alias("http_status"), F.when(C("event_type") == "click", "image/png").otherwise("text/html; charset=utf-8").alias("content_type"),
        (F.pmod(C("event_id"), F.lit(5)) == 0).alias("shell"), (F.pmod(C("event_id"), F.lit(2)) == 0).alias("rendered"),
    )
    return responses.judged_pages(rows, "auto", 950).select("event_id", "status", C("out_kind").alias("kind"), "fetcher", C("why").alias("error"), "harvest")


@query
def asset_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.concat(F.lit("https://s.test/f"), C("event_id").cast("string"), F.when(C("event_type") == "view", ".css?v=1").otherwise(".png")).alias("url"),
        F.pmod(C("event_id"), F.lit(8)).cast("int").alias("depth"), F.when(F.pmod(C("event_id"), F.lit(13)) == 0, "dns").alias("error"), (F.lit(100) + F.pmod(C("event_id") * 7, F.lit(900))).alias("size"),
        F.when(C("event_type") == "error", 500).otherwise(200).alias("http_status"), F.when(C("event_type") == "click", "text/css").otherwise("application/octet-stream").alias("content_type"),
    )
    return responses.judged_assets(rows, 950).select("event_id", "status", C("why").alias("error"), "follow")


def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_links(spark, sf_dir).select(C("src_url").alias("src"), C("abs_url").alias("dst"))


@query
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.depths(spark, fx.frame(spark, [(catalog.HOME,)], "url string"), site_edges(spark, sf_dir))


def site_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once in buckets, as every level of a crawl looks outcomes up."""
    return tables.bucketed(responses.judged_pages(catalog.site_responses(spark, sf_dir), "auto", 2900), "url", "outcomes")


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bucketed(catalog.site_links(spark, sf_dir), "src_url", "links")


@query
def bfs_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 pages in breadth-first order."""
    gates = crawl.Gates(max_pages=300)
    rows = crawl.crawl(spark, catalog.HOME, site_links(spark, sf_dir), site_outcomes(spark, sf_dir), gates)
    return rows.select("url", "depth", "seq", "status")


@query
def crawl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the site with robots, excludes and a depth limit."""
    rules, _ = robots.parsed(catalog.robots(spark), AGENT)
    gates = crawl.Gates(max_depth=6, exclude=("/NATION/7", "/order/5"))
    rows = crawl.crawl(spark, catalog.HOME, site_links(spark, sf_dir), site_outcomes(spark, sf_dir), gates, rules)
    return rows.select("url", "depth", "status", C("out_kind").alias("kind"), C("why").alias("error"))


@query
def stream_crawl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl as a stream over files of events, with state for each host."""
    rules, _ = robots.parsed(catalog.robots(spark), AGENT)
    gates = crawl.Gates(max_depth=6, exclude=("/NATION/7", "/order/5"))
    outcomes, found = site_outcomes(spark, sf_dir), site_links(spark, sf_dir)
    rows = CrawlStream(spark, catalog.HOME, lambda asked: (outcomes, found), gates, rules).run()
    return rows.select("url", "depth", "status", C("out_kind").alias("kind"), C("why").alias("error"))


@query
def resume_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resuming after the regions and even nations were saved: what is left to fetch, to depth 5."""
    done = catalog.site_responses(spark, sf_dir).filter(C("url").rlike("/region/|/nation/[0-9]*[02468]$")).select("url", F.lit(True).alias("harvest"))
    rows = crawl.crawl(spark, catalog.HOME, site_links(spark, sf_dir), site_outcomes(spark, sf_dir), crawl.Gates(max_depth=5), done=done)
    return rows.select("url", "depth", "status")


@query
def css_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = fx.spread(spark, sf_dir, fx.CSS_EDGES, "src_url string, abs_url string", True).drop("page_id")
    starts = fx.spread(spark, sf_dir, [(fx.CSS_EDGES[0][0],)], "url string")
    outcomes = nested.select(C("abs_url").alias("url")).union(nested.select("src_url")).distinct().select("url", C("url").endswith(".css").alias("follow"))
    return crawl.asset_jobs(spark, starts, nested, outcomes).select("url", "depth")


@query
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = fx.spread(spark, sf_dir, fx.HOPS, "url string, status int, location string", True)
    return crawl.redirects(hops, fx.spread(spark, sf_dir, [(u,) for u in fx.HOP_STARTS], "url string", True))


@query
def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.latest(event_log(spark, sf_dir)).select("url", "seq", "status", "kind", "size_bytes")


@query
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the log as an earlier and a later run."""
    log = event_log(spark, sf_dir)
    old, new = (manifest.latest(log.filter(f"seq % 2 = {k}")) for k in (1, 0))
    return manifest.merged(old, new).select("url", "seq", "status")


@query
def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two halves as commits of a log in buckets: a delta is merged as it is read."""
    log = event_log(spark, sf_dir).select("url", F.lit("").alias("path"), "status", "kind", F.lit("").alias("content_type"), F.lit("").alias("sha256"), "size_bytes", F.lit("none").alias("fetcher"), F.lit(None).cast("string").alias("error"), "seq")
    kept = ManifestLog(spark, f"{tables.shared_dir(spark).rstrip('/')}/driftloom-log-{uuid.uuid4().hex}", 8)
    for k in (1, 0):
        kept.upsert(log.filter(f"seq % 2 = {k}"))
    return kept.read().select("url", "seq", "status")


@query
def progress_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.progress(event_log(spark, sf_dir).withColumn("enqueued", C("seq") % 3), ["host"])


@query
def progress_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log without scopes: sums of ranges of its events."""
    return manifest.progress(event_log(spark, sf_dir)).drop("phase")


@query
def mirror_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(manifest.latest(event_log(spark, sf_dir)))


@query
def failures_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.latest(event_log(spark, sf_dir)).withColumn("error", F.when(C("seq") % 3 == 0, "HTTP 500").when(C("seq") % 3 == 1, ""))
    return manifest.failures(rows)


@query
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digests(pages(spark, sf_dir), "html").select("page_id", "sha256", "size_bytes")


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a finished crawl: every link target with an even length counts as mirrored too."""
    own = pages(spark, sf_dir).select(urls.normalize(C("url")).alias("url"))
    more = page_links(spark, sf_dir).filter((C("kind") == "page") & (F.length("abs_url") % 2 == 0)).select(C("abs_url").alias("url"))
    rows = own.union(more).distinct()
    return rows.select("url", urls.local_path(C("url"), F.lit("page")).alias("path"), F.lit("ok").alias("status"), F.lit("text/html").alias("content_type"))


@query
def rewrite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = page_links(spark, sf_dir).select(C("src_url").alias("url"), urls.local_path(C("src_url"), F.lit("page")).alias("path"), "base_url", "raw_ref")
    return rewrite.plan(refs, page_manifest(spark, sf_dir)).select("url", "raw_ref", "action", "value")


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select(urls.normalize(C("url")).alias("url"), C("html").alias("content"))
    return rows.select("url", urls.local_path(C("url"), F.lit("page")).alias("path"), F.lit("html").alias("type"), "content")


def rewritten_pages(spark: SparkSession, sf_dir: str, mirror: DataFrame | None = None) -> DataFrame:
    files = saved_pages(spark, sf_dir)
    return rewrite.rewritten(files, rewrite.plan(rewrite.content_references(files), mirror if mirror is not None else tables.cut(page_manifest(spark, sf_dir), "mirror")))


@query
def rewrite_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten_pages(spark, sf_dir).select("url", "path", F.sha2("content", 256).alias("sha256"), "changed")


@query
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local references of rewritten pages that lead nowhere once the files with a path length that 3 divides are gone."""
    mirror = tables.cut(page_manifest(spark, sf_dir), "mirror")  # one parse for both uses
    files = rewritten_pages(spark, sf_dir, mirror).select("url", "path", F.lit("html").alias("type"), "content")
    left = mirror.filter(F.length("path") % 3 != 0)
    return rewrite.broken(rewrite.content_references(files), left).select("path", "raw_ref")


@query
def rewrite_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of saved files: to mirrored URLs, to files that are there, to neither."""
    saved = fx.spread(spark, sf_dir, fx.KEPT_FILES, "url string, path string", True).withColumn("status", F.lit("ok"))
    from_ = fx.spread(spark, sf_dir, fx.KEPT_FILES[:1], "url string, path string")
    refs = from_.join(fx.spread(spark, sf_dir, fx.KEPT_REFS, "raw_ref string", True), "page_id").select("url", "path", C("url").alias("base_url"), "raw_ref")
    return rewrite.plan(refs, saved).select("url", "raw_ref", "action", "value")


@query
def rewrite_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = fx.spread(spark, sf_dir, fx.SHEETS, "url string, css string")
    files = sheets.select("url", urls.local_path(C("url"), F.lit("asset")).alias("path"), F.lit("css").alias("type"), C("css").alias("content"))
    known = fx.spread(spark, sf_dir, [("https://~.site.test/css/base.css",), ("https://~.site.test/img/a.png",)], "url string", True)
    mirror = known.select("url", urls.local_path(C("url"), F.lit("asset")).alias("path"), F.lit("ok").alias("status"))
    return rewrite.rewritten(files, rewrite.plan(rewrite.content_references(files), mirror)).select("url", "content", "changed")


@query
def entry_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a crawl that began at the last page's URL, and for one whose seed isn't mirrored."""
    rows = tables.cut(page_manifest(spark, sf_dir), "manifest")
    seed = rows.agg(F.max("url").alias("u")).first()["u"]
    return rewrite.entry_index(rows, seed).unionByName(rewrite.entry_index(rows, f'{seed}?q="x"'))
