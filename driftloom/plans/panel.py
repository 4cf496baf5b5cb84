"""A local control panel: start and stop runs over HTTP, follow their state as server-sent events."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .mirror import Engine, Run
from .spec import MirrorSpec, validate

MOST_BODY = 1_000_000
PAGE = """<!doctype html><meta charset="utf-8"><title>driftloom</title>
<form id="f"><input name="url" placeholder="Website"><input name="maxDepth" placeholder="Levels"><input name="maxPages" placeholder="Pages"><button>Start</button><button type="button" id="s">Stop</button></form><pre id="o"></pre>
<script>
const post = (path, body) => fetch(path, {method: "POST", body: JSON.stringify(body || {})});
f.onsubmit = e => { e.preventDefault(); post("/api/start", Object.fromEntries(new FormData(f))); };
s.onclick = () => post("/api/stop");
new EventSource("/api/events").onmessage = e => { o.textContent = JSON.stringify(JSON.parse(e.data), null, 1); };
</script>"""


class Rehearsal:
    """An engine that only counts, for trying the panel out: `pages` steps of `pause` seconds."""

    def __init__(self, pages: int = 5, pause: float = 0.05, fail: str = ""):
        self.pages, self.pause, self.fail = pages, pause, fail

    def __call__(self, spec: MirrorSpec, stop: threading.Event, on_progress) -> dict:
        if self.fail:
            raise RuntimeError(self.fail)
        done = 0
        for done in range(1, self.pages + 1):
            on_progress({"phase": "crawl", "pages": done, "current": f"{spec.url}/{done}"})
            if stop.wait(self.pause):
                break
        return {"pages": done, "stopped": stop.is_set()}


class Panel:
    """One run at a time on 127.0.0.1; port 0 takes a free one."""

    def __init__(self, engine: Engine, port: int = 0):
        self.engine, self.run, self.lock = engine, None, threading.Lock()
        panel = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def answer(self, status: int, value: object, kind: str = "application/json") -> None:
                data = value.encode() if isinstance(value, str) else json.dumps(value, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", f"{kind}; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                if self.path == "/":
                    self.answer(200, PAGE, "text/html")
                elif self.path == "/api/state":
                    self.answer(200, panel.state())
                elif self.path == "/api/events":
                    self.events()
                else:
                    self.answer(404, {"error": "not found"})

            def do_POST(self):
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BODY:
                    return self.answer(413, {"error": "body too large"})
                try:
                    raw = json.loads(self.rfile.read(size) or b"{}")
                except ValueError:
                    return self.answer(400, {"errors": ["The request is not JSON."]})
                if self.path == "/api/start":
                    self.answer(*panel.start(raw))
                elif self.path == "/api/stop":
                    self.answer(*panel.stop())
                else:
                    self.answer(404, {"error": "not found"})

            def events(self):
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                self.wfile.write(b"retry: 3000\n\n")
                last = None
                try:
                    while not panel.closed.is_set():
                        now = json.dumps(panel.state(), default=str)
                        if now != last:
                            self.wfile.write(f"data: {now}\n\n".encode())
                            self.wfile.flush()
                            last = now
                        time.sleep(0.05)
                except OSError:
                    return

        self.closed = threading.Event()
        self.server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def state(self) -> dict:
        return self.run.state() | {"result": self.run.result} if self.run else {"status": "idle", "progress": {}, "error": None, "result": None}

    def start(self, raw: object) -> tuple[int, dict]:
        with self.lock:
            if self.run and self.run.status in ("running", "stopping"):
                return 409, {"error": "already running"}
            spec, errors = validate(raw)
            if errors:
                return 400, {"errors": errors}
            self.run = Run(self.engine, spec).start()
            return 200, self.state()

    def stop(self) -> tuple[int, dict]:
        with self.lock:
            if not self.run or self.run.status != "running":
                return 409, {"error": "not running"}
            self.run.stop()
            return 200, self.state()

    def close(self) -> None:
        self.closed.set()
        self.server.shutdown()
        self.server.server_close()
