"""The control panel over a rehearsing engine, and the command line over a table."""

import json
import time
import urllib.error
import urllib.request

import pytest

from driftloom.plans.panel import MOST_BODY, Panel, Rehearsal


@pytest.fixture
def panel(request):
    p = Panel(getattr(request, "param", Rehearsal(40, 0.05)))
    yield p
    p.close()


def call(panel, path, body=None, raw=None):
    data = raw if raw is not None else None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{panel.port}{path}", data=data), timeout=10) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def wait_for(panel, status):
    for _ in range(200):
        if (s := json.loads(call(panel, "/api/state")[1]))["status"] == status:
            return s
        time.sleep(0.02)
    raise AssertionError(s)


def test_start_stop_and_errors(panel):
    assert "<form" in call(panel, "/")[1] and call(panel, "/nothing")[0] == 404 and call(panel, "/api/nothing", {})[0] == 404
    assert json.loads(call(panel, "/api/state")[1])["status"] == "idle"
    assert call(panel, "/api/stop", {})[0] == 409
    assert call(panel, "/api/start", {"url": ""})[0] == 400 and call(panel, "/api/start", raw=b"{")[0] == 400
    assert call(panel, "/api/start", {"url": "example.com"})[0] == 200
    assert call(panel, "/api/start", {"url": "example.com"})[0] == 409
    assert call(panel, "/api/stop", {})[0] == 200
    assert wait_for(panel, "done")["result"]["stopped"] is True


@pytest.mark.parametrize("panel", [Rehearsal(3, 0.05)], indirect=True)
def test_events_follow_the_run(panel):
    stream = urllib.request.urlopen(f"http://127.0.0.1:{panel.port}/api/events", timeout=10)
    assert stream.readline() == b"retry: 3000\n"
    call(panel, "/api/start", {"url": "https://example.com"})
    seen = []
    while not seen or seen[-1]["status"] != "done":
        line = stream.readline()
        if line.startswith(b"data: "):
            seen.append(json.loads(line[6:]))
    assert seen[0]["status"] == "idle" and any(s["progress"].get("pages") == 2 for s in seen) and seen[-1]["result"] == {"pages": 3, "stopped": False}


@pytest.mark.parametrize("panel", [Rehearsal(fail="no network")], indirect=True)
def test_failures_and_large_bodies(panel):
    call(panel, "/api/start", {"url": "example.com"})
    assert wait_for(panel, "error")["error"] == "no network"
    assert call(panel, "/api/start", raw=b" " * (MOST_BODY + 1))[0] == 413


def test_command_line(spark, tmp_path):
    from driftloom.__main__ import main
    from tests.test_mirror import A, PAGES, site

    site(spark, PAGES).write.parquet(str(tmp_path / "responses"))
    out = tmp_path / "copy"
    assert main([A + "/", "--out", str(out), "--responses", str(tmp_path / "responses")]) == 0
    report = json.loads((out / "report.json").read_text())
    assert report["pages"] == 7 and (out / "index.html").exists() and (out / "_assets/site-a.test_8001/pics/1.gif").read_bytes() == b"picture 1"
    assert main([A + "/", "--out", str(out), "--responses", str(tmp_path / "responses")]) == 0
    assert main(["not-there.invalid", "--out", str(tmp_path / "live"), "--no-robots"]) == 0  # without a table: the web
    assert json.loads((tmp_path / "live" / "report.json").read_text())["failures"][0]["status"] == "failed"
    with pytest.raises(SystemExit):
        main([])
