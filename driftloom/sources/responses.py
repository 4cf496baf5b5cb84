"""Where responses come from: a live fetcher, folders of saved files, earlier manifests."""

from __future__ import annotations

import http.client
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import weburl
from ..functions.html import needs_rendering
from ..functions.urls import part
from ..operators.crawl import MOST_REQUESTS
from ..operators.responses import MARKERS, SNIFFED
from ..schemas import MANIFEST, RESPONSES

#: Milliseconds that a robots.txt may take; most bytes of one.
ROBOTS_TIMEOUT, ROBOTS_BYTES = 10.0, 1 << 20
#: An entry of a manifest's JSON form.
ENTRY = "struct<url: string, path: string, status: string, kind: string, contentType: string, sha256: string, sizeBytes: bigint, fetcher: string, error: string>"
#: Responses and when they were asked for.
ASKED = f"{RESPONSES}, asked_ms long"
#: A random delay is a whole number of these milliseconds above the least one.
STEP = 100


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def _failure(e: BaseException) -> str:
    text = f"{type(e).__name__} {e}"
    reason = getattr(e, "reason", e)
    if isinstance(reason, TimeoutError) or "timed out" in text:
        return "timeout"
    if type(reason).__name__ == "gaierror":
        return "dns"
    if type(reason).__name__.startswith("SSL"):
        return "tls"
    return "connection" if isinstance(reason, ConnectionError) else "network"


def fetch(url: str, user_agent: str, timeout: float = 30.0, most: int = MOST_REQUESTS, most_bytes: int = 0) -> tuple:
    """One URL with its redirects followed by hand: a row of RESPONSES without rendered_html. Of a body larger than most_bytes (0: any) one byte
    more than that is read, which is enough to know."""
    opener, now, chain = urllib.request.build_opener(_Stay), url, []
    for _ in range(most):
        request = urllib.request.Request(now, headers={"User-Agent": user_agent, "Accept": "*/*", "Accept-Language": "en"})
        try:
            try:
                answer = opener.open(request, timeout=timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                status, headers = answer.status, {k.lower(): v for k, v in answer.headers.items()}
                if status in (301, 302, 303, 307, 308):
                    chain.append(f"{status} {now}")
                    target = weburl.normalize(headers["location"], now) if "location" in headers else None
                    if not target:
                        return (url, now, status, "", headers, None, chain, ("bad-redirect", f"no usable Location at {now}"))
                    now = target
                    continue
                body = answer.read(most_bytes + 1) if most_bytes else answer.read()
                return (url, now, status, headers.get("content-type", ""), headers, body, chain, None)
        except (OSError, ValueError, http.client.HTTPException) as e:
            return (url, now, None, "", {}, None, chain, (_failure(e), str(e)))
    return (url, now, None, "", {}, None, chain, ("redirect-limit", f"more than {most} requests"))


def pause_ms(least: float, most: float | None) -> float:
    """Milliseconds to wait: from least to most in steps, or where there is no most, from least to below 1.75 times it."""
    if most is None:
        return least + random.random() * (int(least * 1.75) - least)
    return least + STEP * random.randrange(int((max(least, most) - least) // STEP) + 1)


def wants_rendering(row: tuple, mode: str, most_bytes: int = 0) -> bool:
    """Whether a browser mode asks for a fetched page (a row of fetch) to be rendered; one that is too large never is."""
    _, _, status, kind, headers, body, _, failure = row
    if mode == "never" or failure or body is None or 0 < most_bytes < len(body):
        return False
    markup = "text/html" in kind.lower() or "application/xhtml" in kind.lower()
    challenged = any(headers.get(k, "").lower() == "challenge" for k in ("cf-mitigated", "x-amzn-waf-action")) or (markup and any(m in body[:SNIFFED].decode("latin-1").lower() for m, _ in MARKERS))
    return challenged or (status < 400 and markup and (mode == "always" or needs_rendering(body.decode("utf-8", "replace"))))


def live(
    frontier: DataFrame, user_agent: str, timeout: float = 30.0, max_ms: float | None = None, most_bytes: int = 0,
    renderer: Callable[[str], str | None] | None = None, mode: str = "never",
) -> DataFrame:
    """Fetch a frontier (url, host, seq, delay_ms, last_ms) to ASKED: hosts are dealt to tasks, each host is asked by one task, one request after
    another in the order of seq, with a random pause of at least delay_ms (pause_ms) before each but the first; before that one what is left of a
    pause since last_ms, when an earlier level or round last asked the host (null: never)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        kinds = [text, text, pa.int32(), text, pa.map_(text, text), pa.binary(), pa.list_(text), pa.struct([("kind", text), ("message", text)]), text, pa.int64()]
        names, last = ["url", "final_url", "http_status", "content_type", "headers", "body", "redirect_chain", "error", "rendered_html", "asked_ms"], None
        for batch in batches:
            for url, host, delay, before in zip(*(batch.column(k).to_pylist() for k in ("url", "host", "delay_ms", "last_ms")), strict=True):
                if host == last:
                    time.sleep(pause_ms(delay, max_ms) / 1000)
                elif before is not None:
                    pause = pause_ms(delay, max_ms)
                    time.sleep(min(pause, max(0.0, before + pause - time.time() * 1000)) / 1000)
                last, asked = host, int(time.time() * 1000)
                row = fetch(url, user_agent, timeout, most_bytes=most_bytes)
                page = renderer(url) if renderer and wants_rendering(row, mode, most_bytes) else None
                values = [*row[:4], list(row[4].items()), *row[5:7], {"kind": row[7][0], "message": row[7][1]} if row[7] else None, page, asked]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return frontier.select("url", "host", "seq", "delay_ms", "last_ms").repartition("host").sortWithinPartitions("host", "seq").mapInArrow(run, ASKED)


def fetched_robots(hosts: DataFrame, user_agent: str, timeout: float = ROBOTS_TIMEOUT) -> DataFrame:
    """(host, scheme) to (host, text) of each host's robots.txt, redirects followed; what can't be had is empty, which allows all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("host").to_pylist(), []
            for host, scheme in zip(names, batch.column("scheme").to_pylist(), strict=True):
                row = fetch(f"{scheme}://{host}/robots.txt", user_agent, timeout, most_bytes=ROBOTS_BYTES)
                texts.append(row[5].decode("utf-8", "replace") if row[7] is None and 200 <= row[2] < 300 else "")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["host", "text"])

    return hosts.select("host", "scheme").repartition("host").mapInArrow(run, "host string, text string")


def robots_texts(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """(host, text) of each host's robots.txt among responses: one lookup a host; missing or failed ones are empty, which allows all."""
    hosts = frontier.select(part(F.col("url"), 1).alias("scheme"), part(F.col("url"), 2).alias("host")).groupBy("host").agg(F.min("scheme").alias("scheme"))
    asked = hosts.select("host", F.concat("scheme", F.lit("://"), "host", F.lit("/robots.txt")).alias("url"))
    fine = responses.filter((F.col("http_status") >= 200) & (F.col("http_status") < 300)).select("url", F.col("body").cast("string").alias("text"))
    return asked.join(fine, "url", "left").select("host", F.coalesce("text", F.lit("")).alias("text"))


def saved_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a mirror's files. Listings skip names that begin with _, so the assets' folder is named as well."""
    root = root.rstrip("/")
    inside = "^.*?/" + re.escape(root.rsplit("/", 1)[-1]) + "/"

    def below(folder: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", inside, "").alias("path"), "content")

    try:
        return below(root).unionByName(below(f"{root}/_assets"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return below(root)


def rescanned(manifest: DataFrame, saved: DataFrame, kind: Column | None = None) -> DataFrame:
    """Saved content of earlier ok rows (url, path, content), for harvesting again without fetching."""
    ok = manifest.filter("status = 'ok' and path <> ''")
    return (ok.filter(kind) if kind is not None else ok).select("url", "path", "content_type").join(saved, "path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An earlier manifest's JSON form as a table, parsed by a task; empty where there is none. One that can't be read is moved aside and counts as none."""
    if os.path.isfile(path):
        known = spark.read.schema(f"entries map<string, {ENTRY}>, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(f"file://{os.path.abspath(path)}")
        if known.agg(F.count_if(F.col("entries").isNotNull() & F.col("broken").isNull()).alias("n")).first()["n"] == 1:
            rows = known.select(F.posexplode("entries").alias("seq", "key", "e")).select("seq", "e.*")
            kept = {"contentType": "content_type", "sizeBytes": "size_bytes"}
            rows = rows.withColumnsRenamed(kept).withColumns({"size_bytes": F.coalesce("size_bytes", F.lit(0)), "fetcher": F.coalesce("fetcher", F.lit("none")), "content_type": F.coalesce("content_type", F.lit("")), "sha256": F.coalesce("sha256", F.lit(""))})
            return rows.select(*(F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(MANIFEST)))
        os.replace(path, f"{path}.corrupt-{int(time.time() * 1000)}")
    return spark.createDataFrame([], MANIFEST)
