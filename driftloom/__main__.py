"""python -m driftloom URL [options]: mirror a site, from the web or (--responses TABLE) from a Parquet table of responses (schemas.RESPONSES).
python -m driftloom ui [--port N] [--no-open]: the control panel."""

from __future__ import annotations

import os
import sys
import threading
import time
import webbrowser
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.manifest import failures
from .operators.tables import drop_cut
from .plans.mirror import Run, mirror, stop_on_signal
from .plans.panel import Panel
from .plans.spec import MirrorSpec, parse_args, parse_ui_args
from .plans.web import LiveWeb
from .sources import sinks
from .sources.manifest_log import ManifestLog
from .sources.render import BrowserRenderer
from .sources.responses import read_manifest, saved_tree

#: The manifest for later runs, its JSON form for other tools, the report.
LOG, RECORD, REPORT = ".manifest", "manifest.json", "report.json"


def engine(spark: SparkSession, responses: str | None = None) -> Callable[[MirrorSpec, threading.Event, Callable[[dict], None]], dict]:
    """A whole run that writes the browsable copy, manifest and report below spec.out, a folder that all executors share; returns the counts."""

    def run(spec: MirrorSpec, stop: threading.Event, on_progress: Callable[[dict], None]) -> dict:
        record = os.path.join(spec.out, RECORD)
        previous = saved = None
        log = ManifestLog(spark, f"file://{os.path.abspath(spec.out)}/{LOG}")
        if not spec.fresh and (log.exists() or os.path.isfile(record)):
            previous, saved = log.read() if log.exists() else read_manifest(spark, record), saved_tree(spark, spec.out)
        table = spark.read.parquet(responses) if responses else None
        web = None if responses else LiveWeb(spark, spec, BrowserRenderer(spec.user_agent) if spec.browser != "never" else None)
        done = mirror(spark, spec, table, previous, stop, on_progress, saved, web)
        plain = done.manifest.filter("status = 'ok' and path <> ''").join(done.answers.select("url", "body"), "url").join(done.rewritten.select("url"), "url", "left_anti")
        files = done.rewritten.select("path", F.col("content").cast("binary").alias("content")).unionByName(plain.select("path", F.col("body").alias("content")))
        sinks.write_tree(files, spec.out)
        if not done.interrupted:
            sinks.write_tree(done.entry, spec.out)
        root = urlsplit(spec.url).hostname.removeprefix("www.")
        if previous is None or not log.exists():
            log.replace(done.manifest)
        else:
            log.upsert(done.manifest.subtract(previous))
        sinks.write_manifest(record, done.manifest, spec.url, root)
        sinks.write_report(os.path.join(spec.out, REPORT), done.report, failures(done.manifest), spec.url, root, done.interrupted)
        drop_cut(spark)
        return done.report

    return run


def main(argv: list[str]) -> int:
    start = SparkSession.builder.appName("driftloom").getOrCreate
    if argv[:1] == ["ui"]:
        args = parse_ui_args(argv[1:])
        panel = Panel(engine(start()), args.port)
        address = f"http://127.0.0.1:{panel.port}/"
        print(address)
        if not args.no_open:
            webbrowser.open(address)
        try:
            while True:
                time.sleep(3600)
        except KeyboardInterrupt:
            panel.close()
        return 0
    spec, responses = parse_args(argv)
    run = Run(engine(start(), responses), spec)
    stop_on_signal(run)
    run.start()
    while run.status in ("running", "stopping"):
        run.wait(0.5)
    if run.error:
        print(run.error, file=sys.stderr)
        return 1
    print(sinks.summary(run.result))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
