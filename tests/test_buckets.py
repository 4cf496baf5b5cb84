"""Crawl state in buckets: levels move their own rows only."""

import re

from pyspark.sql import functions as F

from driftloom.operators import crawl, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_and_outcomes_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        urls = [f"https://h.test/{k}" for k in range(300)]
        links = tables.bucketed(spark.createDataFrame([(u, 1, f"{u}/x", "page") for u in urls], "src_url string, ord int, abs_url string, kind string"), "src_url", "links")
        level = tables.cut(spark.createDataFrame([(u, 1) for u in urls[:50]], "src_url string, depth int"), "level")
        few = crawl.following(level.limit(1), links)
        many = level.join(links, "src_url")
        # one shuffle, that of the level; a named parent opens one bucket
        assert plan_of(many).count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan_of(many)
        opened = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan_of(few))
        assert int(opened[1]) == 1 < int(opened[2]) and few.count() == 1 and many.count() == 50
        grown = tables.Growing(spark, "url", "seen")
        grown.add(links.select(F.col("src_url").alias("url")))
        seen = grown.add(links.select(F.col("abs_url").alias("url")))
        assert seen.count() == 600
        fresh = spark.createDataFrame([(urls[3], 1), ("https://h.test/new", 2), (f"{urls[4]}/x", 3)], "url string, n int").groupBy("url").agg(F.min("n").alias("n")).join(seen, "url", "left_anti")
        assert plan_of(fresh).count("Exchange hashpartitioning") == 1  # the groups' own
        assert [r["url"] for r in fresh.collect()] == ["https://h.test/new"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tables.drop_cut(spark) > 0 and not spark.catalog.tableExists(grown.table)
