"""Ranks over a total order without a global window: range partitions, counts of each, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... within each group in ascending order (nulls first).

    The rows are dealt by range over group and order, so a group that holds a third of them spans many partitions;
    a rank is the row's number in its partition's part of the group plus the rows of the group in earlier partitions.
    Rows equal in group and order get ranks next to each other in any order. Helper columns: part_, before_."""
    dealt = rows.repartitionByRange(*(F.asc(c) for c in [*group, *order])).withColumn("part_", F.spark_partition_id())
    dealt = stage(dealt, "ranks")
    ahead = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "part_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)))
    sizes = sizes.select(*(F.col(c).alias(f"{c}_r") for c in [*group, "part_"]), "before_")
    own = Window.partitionBy(*group, "part_").orderBy(*order)
    rows = dealt.withColumn(name, F.row_number().over(own).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in [*group, "part_"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(sizes, on).withColumn(name, F.col(name) + F.col("before_")).drop(*(f"{c}_r" for c in [*group, "part_"]), "part_", "before_")
