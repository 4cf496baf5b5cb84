"""A crawl as a stream: each host is a key with state, timers keep it polite, a restart goes on where the stream ended.

Events arrive in files: `discover` (a URL, the least depth at which it was found in its batch, and what the gates say) and `answer` (what a requested URL gave). For each host a processor keeps the
URLs it has seen with their depths, a first-in-first-out queue and the time from which it may ask again; it emits manifest rows, requests, and `again` for a page that turns out to
be nearer than it was when its links were followed. After each batch the requests are visited (a table of responses, or the web), their answers and what they link to become the next batch's files. Links
are joined and gated outside the state, as relations; state holds a depth and a letter a URL.

All that a run is lies below `where`: checkpoint with the state, event files, emitted rows, a count of open work for each batch. A batch that is sent again writes the same folders
again, so a process that ends in the middle loses nothing and asks no URL again that was answered in a finished batch. Depths are those of a breadth-first crawl at the end, whatever the order in which hosts answer: a shorter
way found later lowers the depths behind it.

A host that may have to wait is asked by one key at a time, which politeness wants. Where a crawl has no pauses at all nobody waits, and a host's URLs are dealt to SHARDS keys by hash. Which of
both holds is written down when a crawl begins. Events are bounded by the URLs of a batch, repeats are dropped before they are sent."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.urls import part, within_depth
from ..operators.crawl import Gates, Visit
from ..operators.excludes import flagged
from ..operators.robots import allowed
from ..operators.tables import shared_dir

EVENTS = "kind string, host string, url string, depth int, gate string, delay_ms double, status string, out_kind string, why string, harvest boolean"
EMITTED = "host string, kind string, url string, depth int, status string, out_kind string, why string, open int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keys of a host that needs no pause.
SHARDS = 256

#: What has become of a URL: waiting, asked, answered with links that were followed, closed.
WAITING, ASKED, FOLLOWED, CLOSED = "w", "a", "f", "c"


class HostProcessor(StatefulProcessor):
    """State of one key, a host or a share of one: seen (url: depth, letter), queue (number: url), ends (first and next number of the queue, when it may ask, delay)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "depth int, letter string")
        self.queue = handle.getMapState("queue", "number long", "url string")
        self.ends = handle.getValueState("ends", "head long, tail long, due double, delay double")

    def _ask(self, host: str, now: float, out: list[tuple]) -> None:
        """Requests for what may be asked now; a timer for the rest."""
        head, tail, due, delay = self.ends.get() if self.ends.exists() else (0, 0, 0.0, 0.0)
        while head < tail and now >= due:
            (url,) = self.queue.getValue((head,))
            self.queue.removeKey((head,))
            head += 1
            depth, _ = self.seen.getValue((url,))
            self.seen.updateValue((url,), (depth, ASKED))
            out.append((host, "request", url, depth, None, None, None, 0))
            due = now + delay if delay else 0.0
        self.ends.update((head, tail, due, delay))
        if head < tail:
            self.handle.registerTimer(int(due) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        host, out, fresh = key[0], [], []
        head, tail, due, delay = self.ends.get() if self.ends.exists() else (0, 0, 0.0, 0.0)
        free = head == tail and not due and not delay  # nobody waits: what needs no pause is asked at once
        for frame in rows:
            for e in sorted(frame.itertuples(index=False), key=lambda e: (e.kind, e.depth, e.url)):  # answers first
                known = self.seen.getValue((e.url,))
                if e.kind == "answer":
                    if known and known[1] == ASKED:
                        self.seen.updateValue((e.url,), (known[0], FOLLOWED if e.harvest else CLOSED))
                        out.append((host, "manifest", e.url, known[0], e.status, e.out_kind, e.why, -1))
                        if e.harvest and known[0] < e.depth:  # nearer since it was asked
                            out.append((host, "again", e.url, known[0], None, None, None, 0))
                elif known is None:
                    if e.gate == "fetch" and free and not e.delay_ms:
                        self.seen.updateValue((e.url,), (int(e.depth), ASKED))
                        out.append((host, "request", e.url, e.depth, None, None, None, 1))
                    elif e.gate == "fetch":
                        self.seen.updateValue((e.url,), (int(e.depth), WAITING))
                        fresh.append((e.url, e.delay_ms))
                        out.append((host, "open", e.url, e.depth, None, None, None, 1))
                    else:
                        self.seen.updateValue((e.url,), (int(e.depth), CLOSED))
                        out.append((host, "manifest", e.url, e.depth, e.gate, "page", None, 0))
                elif e.depth < known[0]:
                    self.seen.updateValue((e.url,), (int(e.depth), known[1]))
                    if known[1] in (FOLLOWED, CLOSED):
                        out.append((host, "nearer", e.url, e.depth, None, None, None, 0))
                    if known[1] == FOLLOWED:
                        out.append((host, "again", e.url, e.depth, None, None, None, 0))
        if fresh:
            for k, (url, wait) in enumerate(fresh):
                self.queue.updateValue((tail + k,), (url,))
                delay = max(delay, float(wait or 0))
            self.ends.update((head, tail + len(fresh), due, delay))
            self._ask(host, float(timerValues.getCurrentProcessingTimeInMs()), out)
        yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self._ask(key[0], float(timerValues.getCurrentProcessingTimeInMs()), out)
        yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        names = ["host", "kind", "url", "depth", "status", "out_kind", "why", "open"]
        return pd.DataFrame(out, columns=names).astype({"depth": "int32", "open": "int32"})

    def close(self) -> None:
        pass


class CrawlStream:
    """A crawl from `seed` through `visit` (rows with url, depth, seq, state to outcomes and links, as crawl.crawl's), gated by gates and rules, at least delay_ms between two requests
    to a host (crawl_delay: rows (host, crawl_delay) in seconds that ask for more). gates.max_pages isn't looked at: hosts share no counter."""

    def __init__(
        self, spark: SparkSession, seed: str, visit: Visit, gates: Gates, rules: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
        crawl_delay: DataFrame | None = None, delay_ms: float = 0.0, where: str | None = None,
    ):
        self.spark, self.seed, self.visit, self.gates, self.rules, self.crawl_delay, self.delay_ms = spark, seed, visit, gates, rules, crawl_delay, delay_ms
        self.where = (where or f"{shared_dir(spark).rstrip('/')}/driftloom-crawl-{uuid.uuid4().hex}").rstrip("/")
        self.idle, self._halt, self._resting, self._released = (threading.Event() for _ in range(4))
        self._left: dict[int, int] = {}
        self._shards = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _key(self, url: Column, host: Column) -> Column:
        """Whose state a URL belongs to."""
        return F.concat(host, F.lit("#"), F.pmod(F.xxhash64(url), F.lit(self._shards)).cast("string")) if self._shards else host

    def _dealt(self, new: bool) -> int:
        """How many keys a host has, 0 for one of its own name: settled when the crawl begins."""
        paused = bool(self.delay_ms) or self.crawl_delay is not None
        path, fs = self._path("shards")
        if new and not fs.exists(path):
            self._put("shards", 0 if paused else SHARDS)
        shards = int(self.spark.read.text(f"{self.where}/shards").first()[0]) if fs.exists(path) else 0
        if shards and paused:
            raise ValueError(f"{self.where} holds a crawl that began without pauses; one with pauses needs a folder of its own")
        return shards

    def _gated(self, found: DataFrame) -> DataFrame:
        """(url, depth) as events of discovery."""
        rows = flagged(found, "url", list(self.gates.exclude), "x").withColumn("host", part(F.col("url"), 2)).withColumn("pathname", part(F.col("url"), 3))
        known = self.rules(rows) if callable(self.rules) and self.gates.respect_robots else self.rules
        rows = allowed(rows, known) if known is not None and self.gates.respect_robots else rows.withColumn("allowed", F.lit(True))
        delay = F.lit(float(self.delay_ms))
        if self.crawl_delay is not None:
            rows = rows.join(self.crawl_delay.select("host", "crawl_delay"), "host", "left")
            delay = F.greatest(delay, F.coalesce(F.col("crawl_delay") * 1000, F.lit(0.0)))
        gate = F.when(F.col("x"), "excluded").when(~F.col("allowed"), "robots").otherwise("fetch")
        return self._events(rows.select(F.lit("discover").alias("kind"), self._key(F.col("url"), F.col("host")).alias("host"), "url", "depth", gate.alias("gate"), delay.alias("delay_ms")))

    def _events(self, rows: DataFrame) -> DataFrame:
        wanted = T._parse_datatype_string(EVENTS)
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    def _open(self, number: int) -> int:
        """Work that was open after a batch: URLs to be asked that have no answer yet."""
        if number not in self._left:
            self._left[number] = int(self.spark.read.text(f"{self.where}/open/{number}").first()[0]) if number >= 0 else 0
        return self._left[number]

    def _put_open(self, number: int, left: int) -> None:
        self._left[number] = left
        self._put(f"open/{number}", left)

    def _put(self, name: str, number: int) -> None:
        path, fs = self._path(name)
        out = fs.create(path, True)
        try:
            out.write(f"{number}\n".encode())
        finally:
            out.close()

    def _after(self, batch: DataFrame, number: int) -> None:
        if self.idle.is_set() or self._halt.is_set():  # the batch before is committed, this one has done nothing: here a stop costs no work
            self._resting.set()
            self._released.wait(60)
            raise InterruptedError("the stream was stopped")
        batch.write.mode("overwrite").parquet(f"{self.where}/rows/{number}")
        rows = self.spark.read.schema(EMITTED).parquet(f"{self.where}/rows/{number}")
        told = rows.agg(F.coalesce(F.sum("open"), F.lit(0)).alias("open"), F.count_if(F.col("kind").isin("request", "again")).alias("asks")).first()
        left = self._open(number - 1) + told["open"]
        if told["asks"]:
            asked = rows.filter("kind = 'request'").select("url", "depth")
            #: Hosts wait on their own, so the order across them says nothing: a number for each URL will do.
            outcomes, links = self.visit(asked.select("url", "depth", F.xxhash64("url").alias("seq"), F.lit(None).cast("long").alias("parent"), F.lit("fetch").alias("state")))
            answers = asked.join(outcomes.select("url", "status", "out_kind", "why", "harvest"), "url", "left")
            none = F.col("status").isNull()
            answers = answers.select(
                F.lit("answer").alias("kind"), self._key(F.col("url"), part(F.col("url"), 2)).alias("host"), "url", "depth", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("out_kind", F.lit("page")).alias("out_kind"),
                F.when(none, "network").otherwise(F.col("why")).alias("why"), F.coalesce("harvest", F.lit(False)).alias("harvest"),
            )
            parents = answers.filter("harvest").select("url", "depth").unionByName(rows.filter("kind = 'again'").select("url", "depth"))
            parents = parents.filter(within_depth(F.col("depth") + 1, self.gates.max_depth)).select(F.col("url").alias("src_url"), "depth")
            pages = links.filter("kind = 'page'").select("src_url", F.col("abs_url").alias("url"))
            found = parents.join(pages, "src_url").groupBy("url").agg(F.min(F.col("depth") + 1).alias("depth"))
            self._events(answers).unionByName(self._gated(found)).write.mode("overwrite").parquet(f"{self.where}/events/{number}")
        self._put_open(number, left)
        if not left and not told["asks"]:
            self.idle.set()

    def start(self) -> StreamingQuery:
        path, fs = self._path("events/seed")
        self._shards = self._dealt(not fs.exists(path))
        if not fs.exists(path):
            self._gated(self.spark.createDataFrame([(self.seed, 1)], "url string, depth int")).write.parquet(f"{self.where}/events/seed")
        for flag in (self.idle, self._halt, self._resting, self._released):
            flag.clear()
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)
        try:
            events = self.spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.where}/events")
            emitted = events.groupBy("host").transformWithStateInPandas(HostProcessor(), EMITTED, "Append", "processingTime")
            return emitted.writeStream.foreachBatch(self._after).option("checkpointLocation", f"{self.where}/checkpoint").start()
        finally:
            self.spark.conf.set(PROVIDER, before)

    def run(self, most: float = 3600.0, until: Callable[[], bool] | None = None) -> DataFrame:
        """Run until nothing is open (or `until` says so, or `most` seconds are over). The manifest so far."""
        query, began = self.start(), time.monotonic()
        try:
            while query.isActive and not self.idle.wait(0.2) and not (until and until()) and time.monotonic() - began < most:
                pass
            if query.exception() is not None:
                raise query.exception()
        finally:
            self._halt.set()
            while query.isActive and not self._resting.wait(0.2):
                pass  # batches follow one another, as timers are looked at between them
            ending = threading.Thread(target=query.stop)
            ending.start()
            time.sleep(0.3)
            self._released.set()
            ending.join()
        return self.manifest()

    def manifest(self) -> DataFrame:
        """(url, depth, status, out_kind, why) of what has an outcome."""
        path, fs = self._path("rows")
        if not fs.exists(path):
            return self.spark.createDataFrame([], "url string, depth int, status string, out_kind string, why string")
        rows = self.spark.read.schema(EMITTED).option("recursiveFileLookup", "true").parquet(f"{self.where}/rows").filter("kind in ('manifest', 'nearer')")
        told = F.col("kind") == "manifest"
        first = lambda c: F.max(F.when(told, F.col(c))).alias(c)
        return rows.groupBy("url").agg(F.min("depth").alias("depth"), first("status"), first("out_kind"), first("why"))
