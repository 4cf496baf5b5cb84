"""A host's own delay holds between levels and rounds, not only within them."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from driftloom.operators import crawl
from driftloom.plans.mirror import mirror
from driftloom.plans.spec import MirrorSpec
from driftloom.plans.web import LiveWeb
from driftloom.streaming.crawl import CrawlStream

TEXT = "Stairs lead from each floor to the next one above it. " * 4
FLOORS = {f"/floor{k}": f'<title>{k}</title><a href="/floor{k + 1}">up</a><link rel=icon href="/sign{k}.ico">{TEXT}' for k in range(1, 4)}


class Tower:
    """A page a level, each with an icon."""

    def __init__(self):
        self.asked = asked = []

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                asked.append((self.path, time.monotonic()))
                text = "User-agent: *\nCrawl-delay: 6\n" if self.path == "/robots.txt" else FLOORS.get(self.path, "x" if self.path.endswith(".ico") else None)
                self.send_response(404 if text is None else 200)
                self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "image/x-icon" if self.path.endswith(".ico") else "text/html")
                self.end_headers()
                self.wfile.write((text or "").encode())

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def gaps(self):
        at = [t for p, t in self.asked if p.startswith("/floor")]
        return [b - a for a, b in zip(at, at[1:], strict=False)]


def test_between_levels_and_rounds(spark):
    tower = Tower()
    done = mirror(spark, MirrorSpec(url=f"{tower.url}/floor1", delay=10))
    got = {r["url"].removeprefix(tower.url): r["status"] for r in done.manifest.collect()}
    assert got == {"/floor1": "ok", "/floor2": "ok", "/floor3": "ok", "/floor4": "failed", "/sign1.ico": "ok", "/sign2.ico": "ok", "/sign3.ico": "ok"}
    assert len(tower.gaps()) == 3 and min(tower.gaps()) >= 6


def test_stream_over_the_live_web(spark):
    tower = Tower()
    spec = MirrorSpec(url=f"{tower.url}/floor1", delay=10)
    web = LiveWeb(spark, spec)
    rows = CrawlStream(spark, spec.url, web.pages, crawl.Gates(), web.rules).run(most=240).collect()
    assert {(r["url"].removeprefix(tower.url), r["depth"], r["status"]) for r in rows} == {("/floor1", 1, "ok"), ("/floor2", 2, "ok"), ("/floor3", 3, "ok"), ("/floor4", 4, "failed")}
    assert min(tower.gaps()) >= 6


def test_large_pages_are_not_rendered():
    from driftloom.sources.responses import wants_rendering

    shell = ("u", "u", 200, "text/html", {}, b"<div id=root></div><script>1</script>", [], None)
    assert wants_rendering(shell, "auto") and wants_rendering(shell, "auto", 100) and not wants_rendering(shell, "auto", 10) and not wants_rendering(shell, "never")
