"""Mixing sources to target weights by systematic sampling.

Sources (ordered by code point, null last) weigh 5, 2, 1, repeating, and share the words of the whole corpus; a target
stops at 3 times its source's words and the excess is shared again by weight (water filling, closed form over
the table of sources). Every document of a source expects target / source words copies. Documents are ordered by
(words, doc_id) within their source, the expected copies are summed along that order, one offset per source
(from its name and the seed, so reruns agree) is added, and a document is taken once for each integer that the sum crosses.
Ordering by size makes the sample stratified: the words taken differ from the target by about one document.

Defined cases: null text has size 0; sources without words have target 0 and no copies; a null source is a source of its
own; repeated rows are documents of their own and share their copies evenly. Ties in size are ordered by doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, spare, stage
from .ranks import ranked

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, "mix"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target. One row per source is all that meets here."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    total, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    #: In the order of their caps per weight the full sources come first.
    before = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    gone, gone_weight = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("source_size", "weight"))
    sources = sources.select("source", "source_size", "weight", total.alias("total"), all_weight.alias("all_weight"), gone.alias("gone"), gone_weight.alias("gone_weight"))
    level = lambda gone, weight: (F.col("total") - most * gone).cast("double") / (F.col("all_weight") - weight).cast("double")
    cap = (most * F.col("source_size")).cast("double")
    sources = sources.withColumn("full", level(F.col("gone"), F.col("gone_weight")) * F.col("weight") > cap)
    held = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(every), F.lit(0))
    sources = sources.select("source", "source_size", "weight", "total", "all_weight", "full", held("source_size").alias("held"), held("weight").alias("held_weight"))
    return sources.select("source", "source_size", F.when(F.col("full"), cap).otherwise(level(F.col("held"), F.col("held_weight")) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, and the columns of `more`."""
    sizes = docs.select("doc_id", "source", n_words().alias("size"), *(c.alias(k) for k, c in (more or {}).items()))
    rows = ranked(stage(sizes, "sizes"), ["source"], ["size", "doc_id"], "rank")  # texts are read once, dealing by range looks at its rows twice
    goals = source_targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "source_t")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("source_t"))).drop("source_t")
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    sum_to = lambda rank: F.floor(rate * rank.cast("double") + offset)  # noqa: E731  the prefix sum of equal expectations
    copies = F.least(sum_to(F.col("rank")) - sum_to(F.col("rank") - 1), F.lit(most)).cast("long")
    return rows.withColumn("copies", copies).drop("rank")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix: every document as many times as it is taken, with docs' columns."""
    th, k_doc, k_th, total, rows, nth, copies = spare(docs, "th", "k_doc", "k_th", "total", "rows", "nth", "copies")
    plan = mix_plan(docs, weights, most, seed, {"th": F.xxhash64("text", "source")})
    plan = plan.groupBy(F.col("doc_id").alias(k_doc), F.col("th").alias(k_th)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).filter(F.col(total) > 0)
    plan = stage(plan, "taken")
    named = docs.withColumn(th, F.xxhash64("text", "source"))
    same = F.col("doc_id").eqNullSafe(F.col(k_doc)) & (F.col(th) == F.col(k_th))
    times = lambda n: F.explode(F.expr(f"if({n} > 0, sequence(1L, {n}), array())")).alias(nth)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = named.join(plan.filter(F.col(rows) == 1).hint("merge"), same).select(*columns, times(f"`{total}`"))
    if (repeated := plan.filter(F.col(rows) > 1)).head(1):  # equal rows share their copies
        equal = Window.partitionBy(k_doc, k_th).orderBy(F.lit(1))
        shared = named.join(repeated.hint("merge"), same).withColumn(nth, F.row_number().over(equal))
        shared = shared.withColumn(copies, F.expr(f"`{total}` div `{rows}` + if(`{nth}` <= `{total}` % `{rows}`, 1, 0)")).drop(nth)
        taken = taken.unionByName(shared.select(*columns, times(f"`{copies}`")))
    return taken.drop(nth)
