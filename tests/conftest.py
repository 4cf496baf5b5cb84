import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    form = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(form(r[c]) for c in columns) for r in df.collect())


def sql_rows(duck, sql, columns):
    got = duck.sql(sql)
    assert sorted(got.columns) == columns
    at = [got.columns.index(c) for c in columns]
    form = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(form(r[i]) for i in at) for r in got.fetchall())
