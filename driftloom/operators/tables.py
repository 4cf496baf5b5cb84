"""Cutting lineage through written tables, and numbering rows in a total order without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset a run in one process takes an own folder, a cluster refuses."""
    context = spark.sparkContext
    if where := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return where
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
    return context.getCheckpointDir()


#: Tables that this process has written, by application.
_written: dict[str, list[str]] = {}


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: later steps don't compute it again, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Catalog names of bucketed tables, by application.
_named: dict[str, list[str]] = {}


def _as_buckets(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    df.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def bucketed(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """df as a written table in buckets of key, as many as there are shuffle partitions: joins on key move the other side only, and few named keys read their own buckets."""
    return Growing(df.sparkSession, key, name).add(df)


class Growing:
    """A table in buckets of key that rows are added to, level by level; what it holds is never shuffled again."""

    def __init__(self, spark: SparkSession, key: str, name: str):
        self.spark, self.key, self.buckets = spark, key, int(spark.conf.get("spark.sql.shuffle.partitions"))
        own = uuid.uuid4().hex
        self.table, self.path = f"driftloom_{name.replace('-', '_')}_{own}", f"{shared_dir(spark).rstrip('/')}/driftloom-{name}-{own}"

    def add(self, rows: DataFrame) -> DataFrame:
        """Everything so far, these rows included."""
        app = self.spark.sparkContext.applicationId
        if self.table not in _named.setdefault(app, []):
            _named[app].append(self.table)
            _written.setdefault(app, []).append(self.path)
        return _as_buckets(rows, self.table, self.path, self.key, self.buckets)


def drop_cut(spark: SparkSession) -> int:
    """Remove the tables that this application has cut, when no result that reads them is needed any more. Returns how many there were."""
    for table in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def numbered(df: DataFrame, order: list[str], name: str = "seq", start: int = 0) -> DataFrame:
    """df with start + 1, start + 2, ... in the order of columns (a total order): numbers within range partitions plus what lies before."""
    dealt = cut(df.repartitionByRange(*(F.asc(c) for c in order)).withColumn("part_", F.spark_partition_id()), "order")
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    before = dealt.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before_"))
    rows = dealt.withColumn(name, F.row_number().over(Window.partitionBy("part_").orderBy(*order)).cast("long"))
    return rows.join(before, "part_").withColumn(name, F.col(name) + F.col("before_") + start).drop("part_", "before_")


def running(df: DataFrame, order: str, sums: dict[str, Column], scope: list[str], upto: int = 0) -> DataFrame:
    """df with running sums, each over the rows of its scope up to the current one (upto -1: up to the one before).

    Without a scope the rows are dealt by range over `order` and each range is summed on its own, what lies before it is added."""
    if scope:
        rows = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumns({n: F.coalesce(F.sum(x).over(rows), F.lit(0)) for n, x in sums.items()})
    own = {f"{n}_own": x for n, x in sums.items()}
    dealt = cut(df.withColumns(own).repartitionByRange(F.asc(order)).withColumn("part_", F.spark_partition_id()), "sums")
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    totals = dealt.groupBy("part_").agg(*(F.sum(k).alias(k) for k in own))
    totals = totals.select("part_", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_before") for k in own))
    rows = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    both = {n: F.coalesce(F.sum(f"{n}_own").over(rows), F.lit(0)) + F.col(f"{n}_own_before") for n in sums}
    return dealt.join(totals, "part_").withColumns(both).drop("part_", *own, *(f"{k}_before" for k in own))
