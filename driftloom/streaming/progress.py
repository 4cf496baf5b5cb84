"""Progress of a run as a stream: outcomes arrive in files, each micro-batch updates the latest rows and the counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import shared_dir
from ..schemas import MANIFEST
from ..sources.manifest_log import ManifestLog


class ProgressStream:
    """Follows a folder of outcome files. A batch is one commit of a manifest log beside the checkpoint: it reads the buckets of its own URLs, and the
    counters change by what it replaces and adds, so that its cost follows the batch and not the manifest. All state lies there, so a process that starts
    with the same `where` goes on where the one before ended; a batch that is sent again is known by its number."""

    def __init__(self, spark: SparkSession, folder: str, on_progress=None, where: str | None = None):
        self.spark, self.folder, self.on_progress = spark, folder, on_progress
        self.where = (where or f"{shared_dir(spark).rstrip('/')}/driftloom-progress-{uuid.uuid4().hex}").rstrip("/")
        self.log = ManifestLog(spark, f"{self.where}/log")

    def merge(self, batch: DataFrame, number: int) -> None:
        counts = self.log.upsert(batch, number)
        if self.on_progress:
            self.on_progress(counts)

    def current(self) -> DataFrame:
        return self.log.read()

    def start(self, once: bool = False) -> StreamingQuery:
        stream = self.spark.readStream.schema(MANIFEST).parquet(self.folder)
        writer = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.where}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def live_counts(spark: SparkSession, folder: str, schema: str = MANIFEST) -> DataFrame:
    """A streaming aggregate (complete mode) of events by status and kind."""
    return spark.readStream.schema(schema).parquet(folder).groupBy("status", "kind").agg(F.count("*").alias("events"), F.sum("size_bytes").alias("bytes"))
