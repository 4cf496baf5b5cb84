"""Connected components of a graph of long ids by alternating large and small stars, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, label) with label the smallest node of the component, for every node that has an edge.

    Each round hangs all larger neighbours of a node on its smallest one, then the smaller ones, until nothing changes; the number of
    rounds grows with the logarithm of the nodes. Minima are combined before they are shuffled; a node with very many
    edges meets them only in a join that Spark may split. Self loops and repeated edges don't matter."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        #: (a, m) itself is among them: its b is m.
        now = stage(small, "stars")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now_is := (state["n"], state["x"])) == seen:
            break
        seen = now_is
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
