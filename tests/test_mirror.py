"""Whole runs over fixture sites, resuming, stopping, sources, sinks and the progress stream."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from driftloom.__main__ import engine
from driftloom.operators import crawl, rewrite
from driftloom.plans.mirror import Run, mirror
from driftloom.plans.spec import MirrorSpec, default_out, parse_args, parse_ui_args, validate
from driftloom.plans.web import LiveWeb
from driftloom.schemas import MANIFEST, RESPONSES
from driftloom.sources import sinks
from driftloom.sources import responses as sources
from driftloom.streaming.progress import ProgressStream

A = "http://site-a.test:8001"
LONG = "word " * 60


def site(spark, pages, robots=None):
    pages = dict(pages) | ({"/robots.txt": ("text/plain", robots)} if robots else {})
    rows = [(A + p, A + p, 404 if t == "404" else 200, t, {}, b.encode(), [], None, None) for p, (t, b) in pages.items()]
    return spark.createDataFrame(rows, RESPONSES)


def tree(last=7):
    """A site made by a rule: page n leads to pages 2n and 2n + 1 and shows picture n; the root has a theme, page 7 a way to one that isn't there."""
    at = lambda n: "/" if n == 1 else f"/node/{n}"
    pages = {"/theme.css": ("text/css", "body{background:url(pics/wall.gif)}"), "/pics/wall.gif": ("image/gif", "wall")}
    for n in range(1, last + 1):
        ways = [f'<a href="{at(k)}">{k}</a>' for k in (2 * n, 2 * n + 1) if k <= last or k == 15]
        pages[at(n)] = ("text/html", f'<h1>{n}</h1>{"<link rel=stylesheet href=/theme.css>" * (n == 1)}{"".join(ways)}<img src="/pics/{n}.gif">{LONG}')
        pages[f"/pics/{n}.gif"] = ("image/gif", f"picture {n}")
    return pages


PAGES = tree()


def statuses(result):
    return {r["url"].removeprefix(A): (r["status"], r["kind"]) for r in result.manifest.collect()}


def test_levels_excludes_and_links_that_work(spark):
    full = mirror(spark, MirrorSpec(url=A + "/"), site(spark, PAGES))
    got = statuses(full)
    assert got["/node/7"] == ("ok", "page") and got["/pics/7.gif"] == ("ok", "asset") and got["/node/15"] == ("failed", "page") and "/node/14" not in got
    assert (full.report["pages"], full.report["assets"], full.report["failures"]) == (7, 9, 1)
    files = full.rewritten.selectExpr("url", "path", "case when path like '%.css' then 'css' else 'html' end type", "content")
    assert rewrite.broken(rewrite.content_references(files), full.manifest.filter("status = 'ok'")).count() == 0
    home = next(r["content"] for r in full.rewritten.collect() if r["url"] == A + "/")
    assert 'href="node/2.html"' in home and A not in home
    gated = mirror(spark, MirrorSpec(url=A + "/", max_depth=2, exclude=("NODE/3", "cs/1.GIF")), site(spark, PAGES))
    got = statuses(gated)
    assert [n for n in range(1, 8) if f"/node/{n}" in got] == [2, 3] and got["/node/3"] == ("excluded", "page") and got["/pics/1.gif"] == ("excluded", "asset") and gated.report["excluded"] == 2
    home = next(r["content"] for r in gated.rewritten.collect() if r["url"] == A + "/")
    assert f'href="{A}/node/3"' in home and 'href="node/2.html"' in home


def test_robots_limit_and_resume(spark):
    table = site(spark, PAGES, "User-agent: *\nDisallow: /node/3\nDisallow: /pics/2")
    got = statuses(mirror(spark, MirrorSpec(url=A + "/"), table))
    assert got["/node/3"] == ("robots", "page") and got["/pics/2.gif"] == ("robots", "asset") and "/node/6" not in got
    first = mirror(spark, MirrorSpec(url=A + "/", max_pages=2), site(spark, PAGES))
    assert first.report["pages"] == 2
    again = mirror(spark, MirrorSpec(url=A + "/"), site(spark, PAGES), previous=first.manifest)
    assert again.report["pages"] == 7


def test_relative_base_walls_and_sizes(spark):
    pages = {
        "/": ("text/html", f'<a href="guide">g</a><a href="/wall">w</a><a href="/big">b</a>{LONG}'),
        "/guide": ("text/html", f'<base href="parts/one/"><a href="two">next</a><img src="x.gif">{LONG}'),
        "/parts/one/two": ("text/html", f'<a href="../../guide">back</a>{LONG}'),
        "/parts/one/x.gif": ("image/gif", "x"),
        "/wall": ("text/html", "<title>Just a moment...</title>"),
        "/big": ("text/html", "x" * 5000),
    }
    done = mirror(spark, MirrorSpec(url=A + "/", max_file_size=4000), site(spark, pages))
    got = statuses(done)
    assert got["/wall"][0] == "challenge" and got["/big"][0] == "too-large" and got["/parts/one/two"] == ("ok", "page") and got["/parts/one/x.gif"] == ("ok", "asset")
    text = {r["url"].removeprefix(A): r["content"] for r in done.rewritten.collect()}
    assert "<base" not in text["/guide"] and 'href="parts/one/two.html"' in text["/guide"] and 'href="../../guide.html"' in text["/parts/one/two"]


def test_stopped_run_leaves_content_alone(spark):
    stop = threading.Event()
    stop.set()
    done = mirror(spark, MirrorSpec(url=A + "/"), site(spark, PAGES), stop=stop)
    assert done.interrupted and done.report["pages"] == 1 and not any(r["changed"] for r in done.rewritten.collect())


def test_run_handle():
    gate = threading.Event()

    def engine(spec, stop, on_progress):
        on_progress({"pages": 1})
        gate.set()
        stop.wait(10)
        return "end"

    run = Run(engine, MirrorSpec(url="x")).start()
    gate.wait(10)
    with pytest.raises(RuntimeError):
        run.start()
    run.stop()
    assert run.wait(10).state() == {"status": "done", "progress": {"pages": 1}, "error": None} and run.result == "end"
    with pytest.raises(RuntimeError):
        run.stop()
    bad = Run(lambda *a: 1 / 0, MirrorSpec(url="x")).start().wait(10)
    assert bad.status == "error" and "zero" in bad.error


def test_depths_on_a_cycle_and_empty_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in crawl.depths(spark, seeds, edges).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert crawl.depths(spark, seeds, edges.limit(0)).count() == 1


def test_options():
    assert validate({"url": "www.ex.com"})[0].out == "mirror-ex.com" and default_out("www.ex.com") == "mirror-www.ex.com"
    assert validate({"url": ""})[1] and validate({"url": "ftp://x"})[1] and validate({"url": "e.c", "maxPages": "x"})[1] and validate({"url": "e.c", "maxPages": -1})[1] and validate(None)[1]
    assert validate({"url": "e.c", "delayFromS": "3", "delayToS": "2"})[1] and validate({"url": "e.c", "browser": "maybe"})[1]
    spec = validate({"url": "e.c", "delayToS": "1.5", "exclude": " a \n\nb", "mode": "fresh", "subdomains": False})[0]
    assert (spec.delay, spec.delay_max, spec.exclude, spec.fresh, spec.subdomains, spec.max_file_size) == (0, 1500, ("a", "b"), True, False, 200 << 20)
    cli, table = parse_args(["ex.com", "--responses", "t", "--exclude", "x", "--exclude", "y", "--max-depth", "3", "--delay-min", "0.5", "--delay-max", "2", "--no-robots"])
    assert (cli.url, cli.exclude, cli.max_depth, cli.delay, cli.delay_max, cli.respect_robots) == ("https://ex.com", ("x", "y"), 3, 500, 2000, False)
    assert table == "t" and parse_args(["ex.com"])[1] is None and parse_ui_args(["--port", "80", "--no-open"]).no_open
    for wrong in (["--port", "x"], ["--port", "70000"], ["extra"]):
        with pytest.raises(SystemExit):
            parse_ui_args(wrong)
    for wrong in (["ex.com", "--max-depth", "-1"], ["ex.com", "--delay-min", "2", "--delay-max", "1"], []):
        with pytest.raises(SystemExit):
            parse_args(wrong)


def test_manifest_files(spark, tmp_path):
    path = str(tmp_path / "m" / "manifest.json")
    assert sources.read_manifest(spark, path).count() == 0
    done = mirror(spark, MirrorSpec(url=A + "/", max_depth=1), site(spark, PAGES))
    sinks.write_manifest(path, done.manifest, A + "/", "site-a.test")
    assert json.load(open(path))["seed"] == A + "/"
    assert sources.read_manifest(spark, path).count() == done.manifest.count()
    (tmp_path / "m" / "manifest.json").write_text("{broken")
    assert sources.read_manifest(spark, path).count() == 0 and len(list((tmp_path / "m").glob("*.corrupt-*"))) == 1
    files = done.rewritten.select("path", "content").unionByName(done.entry)
    assert sinks.write_tree(files, str(tmp_path / "tree")) == files.count() and (tmp_path / "tree" / "index.html").exists()
    escape = spark.createDataFrame([("../out.txt", "x")], "path string, content string")
    assert sinks.write_tree(escape, str(tmp_path / "tree")) == 0
    assert "pages: 1" in sinks.summary(done.report)


def test_saved_copies_are_scanned_again(spark, tmp_path):
    done = mirror(spark, MirrorSpec(url=A + "/", max_depth=1), site(spark, PAGES))
    sinks.write_tree(done.rewritten.select("path", "content"), str(tmp_path / "copy"))
    again = sources.rescanned(done.manifest, sources.saved_tree(spark, str(tmp_path / "copy")))
    assert {r["url"] for r in again.collect()} == {A + "/", A + "/style.css"}


def test_failed_fetches_are_rows(spark):
    row = sources.fetch("http://127.0.0.1:9/x", "t", timeout=2)
    assert row[7][0] in ("connection", "network", "timeout") and row[2] is None
    got = sources.live(spark.createDataFrame([("http://127.0.0.1:9/x", "127.0.0.1:9", 1, 0.0, None)], "url string, host string, seq long, delay_ms double, last_ms long"), "t", 2).first()
    assert got["error"]["kind"] == row[7][0]


def test_pauses():
    assert all(500 <= sources.pause_ms(500, None) < 875 for _ in range(300))
    assert {sources.pause_ms(300, 900) for _ in range(900)} == {300, 400, 500, 600, 700, 800, 900} and sources.pause_ms(400, 200) == 400


def test_progress_stream(spark, tmp_path):
    def outcome(url, status, seq):
        return (url, "p", status, "page", "text/html", "h", 10, "static", None, seq)

    folder, said = str(tmp_path / "in"), []
    spark.createDataFrame([outcome("u1", "ok", 1), outcome("u2", "failed", 2)], MANIFEST).write.parquet(folder)
    stream = ProgressStream(spark, folder, said.append)
    stream.start(once=True).awaitTermination(60)
    spark.createDataFrame([outcome("u2", "ok", 3)], MANIFEST).write.mode("append").parquet(folder)
    following = stream.start(once=True)
    following.awaitTermination(60)
    assert said[0] == {"pages": 1, "assets": 0, "bytes": 10, "robots_skipped": 0, "excluded": 0, "failures": 1}
    assert said[-1]["pages"] == 2 and said[-1]["failures"] == 0
    spark.createDataFrame([outcome("u3", "ok", 4)], MANIFEST).write.mode("append").parquet(folder)
    other, heard = str(stream.where), []
    restarted = ProgressStream(spark, folder, heard.append, other)  # a new process: nothing but the folder is left
    restarted.start(once=True).awaitTermination(60)
    assert heard[-1]["pages"] == 3 and restarted.current().count() == 3
    batch = spark.createDataFrame([outcome("u4", "ok", 5)], MANIFEST)
    for n in (14, 15, 16, 16):  # a batch that comes again counts once
        restarted.merge(batch, n)
    assert heard[-1]["pages"] == 4 and restarted.log.state()["token"] == 16


def test_robots_are_asked_before_sheets_are_followed(spark):
    pages = {"/": ("text/html", f'<link rel=stylesheet href="/no/s.css"><link rel=stylesheet href="/yes.css">{LONG}'), "/no/s.css": ("text/css", "a{background:url(/n.png)}"), "/yes.css": ("text/css", "a{background:url(/y.png)}"), "/n.png": ("image/png", "N"), "/y.png": ("image/png", "Y")}
    got = statuses(mirror(spark, MirrorSpec(url=A + "/"), site(spark, pages, "User-agent: *\nDisallow: /no/")))
    assert got["/no/s.css"] == ("robots", "asset") and got["/y.png"] == ("ok", "asset") and "/n.png" not in got


def test_resume_from_saved_files_only(spark, tmp_path):
    """The second run's table lacks what the first one saved: links, and assets of a saved sheet, come from the files."""
    first = mirror(spark, MirrorSpec(url=A + "/", max_depth=1, rewrite=False), site(spark, PAGES))
    body = first.answers.join(first.manifest.filter("status = 'ok'").select("url", "path"), "url").selectExpr("path", "body as content")
    sinks.write_tree(body, str(tmp_path / "copy"))
    saved = sources.saved_tree(spark, str(tmp_path / "copy"))
    rest = site(spark, {p: x for p, x in PAGES.items() if p not in ("/", "/theme.css", "/pics/1.gif")})
    again = mirror(spark, MirrorSpec(url=A + "/"), rest, previous=first.manifest.filter("url not like '%/pics/wall.gif'"), saved=saved)
    got = statuses(again)
    assert again.report["pages"] == 7 and got["/pics/wall.gif"] == ("ok", "asset") and got["/theme.css"] == ("ok", "asset")
    assert A + "/" in {r["url"] for r in again.rewritten.collect()}


def test_progress_events(spark):
    done = mirror(spark, MirrorSpec(url=A + "/"), site(spark, PAGES), on_progress=(said := []).append)
    rows = done.progress.orderBy("seq").collect()
    assert rows[0]["queue_size"] >= 2 and rows[-1]["queue_size"] == 0 and rows[-1]["pages_done"] == 7 and rows[-1]["assets_done"] == done.report["assets"]
    assert len(rows) == done.manifest.count() and said[0]["phase"] == "crawl" and said[0]["queue_size"] == 2 and said[-1]["phase"] == "rewrite"


class Server:
    """The site over HTTP: PAGES, robots, a redirect, a scripted page; what was asked, when."""

    def __init__(self, robots=""):
        self.asked = asked = []

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                asked.append((self.path, time.monotonic()))
                kind, text = {**PAGES, "/robots.txt": ("text/plain", robots), "/shell": ("text/html", "<div id=root></div><script>1</script>")}.get(self.path, ("404", "no"))
                moved = self.path == "/node/2"
                self.send_response(302 if moved else 404 if kind == "404" else 200)
                if moved:
                    self.send_header("Location", "/moved")
                    text = ""
                if self.path == "/node/3":
                    text += '<a href="/shell">s</a>'
                self.send_header("Content-Type", kind if kind != "404" else "text/html")
                self.send_header("Content-Length", str(len(text.encode())))
                self.end_headers()
                self.wfile.write(text.encode())

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_live_crawl(spark, tmp_path):
    """Stop after the seed, go on from the files, to the end: robots, redirects, errors, delays, rendering, a browsable copy."""
    web = Server("User-agent: *\nDisallow: /node/6\nCrawl-delay: 0.2")
    out = str(tmp_path / "copy")
    spec = MirrorSpec(url=f"{web.url}/", out=out, delay=10, delay_max=50, max_file_size=100_000)
    stop, run = threading.Event(), engine(spark)
    first = run(spec, stop, lambda p: stop.set() if p["pages_done"] else None)
    assert first["pages"] == 1 and not os.path.exists(f"{out}/index.html") and [p for p, _ in web.asked] == ["/robots.txt", "/"]
    web.asked.clear()
    rendered = LiveWeb(spark, spec, lambda url: "<body>rendered <a href='/node/4'>4</a></body>" if url.endswith("/shell") else None)
    record, saved = sources.read_manifest(spark, f"{out}/manifest.json"), sources.saved_tree(spark, out)
    done = mirror(spark, spec, None, record, saved=saved, web=rendered)
    got = {r["url"].removeprefix(web.url): r for r in done.manifest.collect()}
    paths = [p for p, _ in web.asked]
    assert "/" not in paths and paths.count("/robots.txt") == 1 and "/node/6" not in paths
    assert got["/node/6"]["status"] == "robots" and got["/node/15"]["error"] == "HTTP 404" and got["/node/2"]["status"] == "failed"
    assert got["/shell"]["fetcher"] == "playwright" and got["/node/4"]["status"] == "ok" and got["/pics/3.gif"]["status"] == "ok"
    ats = [t for p, t in web.asked if p in ("/node/2", "/node/3", "/moved")]
    assert max(ats) - min(ats) >= 0.2  # the host's own delay
    report = run(spec, threading.Event(), lambda p: None)
    assert report["pages"] == 4 and os.path.exists(f"{out}/index.html") and len(json.load(open(f"{out}/report.json"))["failures"]) == report["failures"]


def test_exports():
    import driftloom

    assert all(getattr(driftloom, name) for name in driftloom.__all__)
    with pytest.raises(AttributeError):
        driftloom.nothing
