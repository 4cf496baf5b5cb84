"""Disk of the corpus pipeline's third stage: shuffle files go with the job that wrote them, texts that stay are not shuffled."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from driftloom.llm import common, jaccard_join


def shuffle_files(spark) -> dict[str, int]:
    """Shuffle data files at hand and their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    at = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in at if re.match(r"shuffle_\d+_.*data$", f.getName())}


def test_staged_jobs_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    table = common.stage(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "disk")
    until = time.time() + 5
    while (left := shuffle_files(spark).keys() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and table.count() == 100 and spark.conf.get(common.CLEANUP, None) == was


def test_tables_that_no_result_reads_are_removed(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: tables.setdefault(name, common.stage(df, name)))
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40)) + f" e{i}") for i in range(40)]
    assert jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20
    at = {name: os.path.exists(common._at[df].removeprefix("file://")) if df in common._at else None for name, df in tables.items()}
    assert at["columns"] is None and at["rows"] is None and at["sets"] and at["judged"]


def test_texts_that_stay_are_not_shuffled(spark):
    r = random.Random(3)
    rows = [(i, " ".join(str(r.random()) for _ in range(500))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (5000, "")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        before = shuffle_files(spark)
        ids = [x["doc_id"] for x in df.collect()]
        written = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, ids)) == sorted(map(str, [*range(200), None, 5000]))
    assert 0 < written < sum(len(t or "") for _, t in rows) / 8
