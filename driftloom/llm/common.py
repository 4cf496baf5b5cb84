"""What the operators of this subpackage share: staging tables, Arrow batches, helper columns."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Word characters are everything but these; bytes.split() and bytes.strip() know the same set.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a run in one process takes an own one, a cluster refuses."""
    context = spark.sparkContext
    if where := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return where
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
    return context.getCheckpointDir()


#: Tables that this process has staged, by application; and where those that are still at hand lie.
_staged: dict[str, list[str]] = {}
_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind. Else they stay until the driver happens to collect its garbage, which long runs with large heaps seldom do."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftloom-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _at[table] = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that no result reads any more."""
    for table in tables:
        spark, path = table.sparkSession, _at.pop(table, None)
        if path:
            _staged[spark.sparkContext.applicationId].remove(path)
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(spark: SparkSession) -> int:
    """Remove the application's staged tables, when no result that reads them is needed any more. Returns how many there were."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        remove(spark, p)
    return len(paths)


#: A key is hot if it holds more than one SHARE-th of the rows (and more than HOT_ROWS): so there are fewer than SHARE such keys.
SHARE, HOT_ROWS = 2048, 64


def hot_keys(counts: DataFrame, key: str) -> list[int]:
    """The hot ones of counts (key: long, n: rows that have it), fewer than SHARE."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return [r[key] for r in counts.filter(F.col("n") > max(HOT_ROWS, total // SHARE)).select(key).collect()]


def spread_join(rows: DataFrame, one: DataFrame, key: str, hot: list[int]) -> DataFrame:
    """rows left join one (a row for each key) on key: rows of hot keys meet them by broadcast where they are, all others by a shuffle at every size.

    rows and one are read twice where there are hot keys, so they should be written tables."""
    if not hot:
        return rows.join(one.hint("merge"), key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = rows.filter(~is_hot).join(one.filter(~is_hot).hint("merge"), key, "left")
    return rest.unionByName(rows.filter(is_hot).join(F.broadcast(one.filter(is_hot)), key, "left"))


def safe_join(rows: DataFrame, one: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """rows join one on equal names, nulls equal to nulls, by a shuffle at every size; each name comes once."""
    other = one.withColumnsRenamed({n: f"{n}_of" for n in names}).hint("merge")
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    return rows.join(other, on, how).drop(*(f"{n}_of" for n in names))


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named like these (any case) renamed out of the way, and how they were: new name to old."""
    clash = [c for c in df.columns if c.lower() in names]
    new = dict(zip(spare(df, *(f"{c}_given" for c in clash)), clash, strict=True))
    return df.withColumnsRenamed({old: n for n, old in new.items()}), new


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; bytes bind where rows don't."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-") or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that df doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def replaced(df: DataFrame, **added: T.DataType) -> T.StructType:
    """df's schema without columns named like those added (any case), then those."""
    names = {n.lower() for n in added}
    return T.StructType([*(f for f in df.schema if f.name.lower() not in names), *(T.StructField(n, t) for n, t in added.items())])


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b'' for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow of a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_hash(column: str) -> F.Column:
    """Names a text among rows that share a doc_id."""
    return F.xxhash64(F.col(column))
