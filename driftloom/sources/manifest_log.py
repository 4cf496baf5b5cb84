"""The manifest as a log of commits over buckets of URLs: upserts write deltas, readers merge them, compaction rewrites only buckets that many deltas touch.

    where/data/<number>-<id>/b=<bucket>/...   rows of one commit
    where/commits/<number>.json               what is live after it: for each bucket its folders, the base first; counters; the last token

A commit appears whole or not at all, as its file is created last and only if no other writer has taken the number. A reader looks at the latest commit file and reads live folders only; of a URL the row of the
latest commit counts, within a commit that with the largest seq. Counters (pages, assets, bytes, robots_skipped, excluded, failures) are carried: an upsert takes off what the
replaced rows counted and adds the new ones, so they cost no pass over the manifest. The driver holds one commit file: buckets x (1 + deltas) names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.manifest import latest, report
from ..schemas import MANIFEST

#: Buckets of a new log, deltas of a bucket before it is compacted, URLs that a lookup names to the scan.
BUCKETS, DELTAS, NAMED = 32, 8, 1000
STORED = f"{MANIFEST}, commit_ bigint, b int"


class ManifestLog:
    """A log at `where`, a folder that all executors share; buckets counts for a new one only (some 10 million URLs a bucket are fine)."""

    def __init__(self, spark: SparkSession, where: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.where, self.deltas = spark, where.rstrip("/"), deltas
        self._empty = {"number": -1, "buckets": buckets, "live": {}, "counts": {}, "token": None}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The latest commit."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return dict(self._empty)
        numbers = [int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return dict(self._empty)
        path, fs = self._path(f"commits/{max(numbers)}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.state()["number"] >= 0

    def _commit(self, state: dict) -> None:
        """Take the next number, or fail if another writer has it."""
        path, fs = self._path(f"commits/{state['number']}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer has made commit {state['number']}") from e
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()

    def _rows(self, state: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """Live rows of some buckets, as they were written."""
        wanted = set(state["live"]) if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.where}/data/{folder}/b={b}" for b, folders in state["live"].items() if b in wanted for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        bare = T.StructType([f for f in T._parse_datatype_string(STORED) if f.name != "b"])
        return self.spark.read.schema(bare).parquet(*paths).withColumn("b", self._bucket(state))

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64("url"), F.lit(state["buckets"])).cast("int")

    def _merged(self, rows: DataFrame) -> DataFrame:
        return latest(rows.withColumn("order_", F.struct("commit_", "seq")), "url", "order_").drop("order_")

    def read(self) -> DataFrame:
        """The manifest: one row for each URL."""
        return self._merged(self._rows(self.state())).drop("commit_", "b")

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The manifest's rows of some URLs (url), read from their buckets only; few URLs are named to the scan, which skips what can't hold them."""
        return self._found(self.state(), urls).drop("commit_", "b")

    def _found(self, state: dict, urls: DataFrame) -> DataFrame:
        urls = urls.select("url").distinct()
        rows = self._rows(state, [r["b"] for r in urls.select(self._bucket(state).alias("b")).distinct().collect()])
        few = [r["url"] for r in urls.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            rows = rows.filter(F.col("url").isin(few))
        return self._merged(rows.join(urls, "url", "left_semi"))

    def _written(self, rows: DataFrame, state: dict, number: int) -> tuple[str, DataFrame]:
        folder = f"{number}-{uuid.uuid4().hex[:12]}"
        path = f"{self.where}/data/{folder}"
        rows.withColumn("b", self._bucket(state)).repartition("b").sortWithinPartitions("b", "url").write.partitionBy("b").parquet(path)
        return folder, self.spark.read.schema(T._parse_datatype_string(STORED)).parquet(path)

    def upsert(self, rows: DataFrame, token: int | None = None) -> dict:
        """Write rows (schemas.MANIFEST) as one commit; the last seq of each URL counts. A token (say a batch's number) that isn't above the last one's has been written
        already, and nothing happens. Returns the counters after it."""
        state = self.state()
        if token is not None and state["token"] is not None and token <= state["token"]:
            return state["counts"]
        number = state["number"] + 1
        columns = [f.name for f in T._parse_datatype_string(MANIFEST)]
        folder, new = self._written(latest(rows.select(columns)).withColumn("commit_", F.lit(number).cast("long")), state, number)
        touched = [r["b"] for r in new.select("b").distinct().collect()]
        added, gone = report(new).first().asDict(), report(self._found(state, new)).first().asDict()
        counts = {k: state["counts"].get(k, 0) + added[k] - gone[k] for k in added}
        live = state["live"] | {str(b): [*state["live"].get(str(b), []), folder] for b in touched}
        state = state | {"number": number, "live": live, "counts": counts, "token": state["token"] if token is None else token}
        self._commit(state)
        full = [int(b) for b, folders in live.items() if len(folders) > 1 + self.deltas]
        if full:
            self.compact(full)
        return counts

    def compact(self, buckets: Iterable[int] | None = None) -> None:
        """Rewrite some buckets (or all) as one base each; the others stay as they are. Rows keep the commit that wrote them."""
        state = self.state()
        chosen = [int(b) for b in (state["live"] if buckets is None else buckets)]
        folder, new = self._written(self._merged(self._rows(state, chosen)), state, state["number"] + 1)
        there = {str(r["b"]) for r in new.select("b").distinct().collect()}
        self._commit(state | {"number": state["number"] + 1, "live": state["live"] | {str(b): [folder] if str(b) in there else [] for b in chosen}})

    def replace(self, rows: DataFrame) -> dict:
        """Begin anew with rows."""
        state = self.state()
        self._commit(self._empty | {"number": state["number"] + 1, "buckets": state["buckets"], "counts": {}, "token": state["token"]})
        return self.upsert(rows)

    def vacuum(self) -> int:
        """Remove folders that no reader of the latest commit needs. Returns how many."""
        live = {folder for folders in self.state()["live"].values() for folder in folders}
        path, fs = self._path("data")
        old = [f.getPath() for f in (fs.listStatus(path) if fs.exists(path) else []) if f.getPath().getName() not in live]
        for p in old:
            fs.delete(p, True)
        return len(old)
