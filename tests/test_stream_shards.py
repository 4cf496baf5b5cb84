"""A host that needs no pause is dealt to several keys; one that may wait keeps its own."""

import pytest

from driftloom.operators import crawl
from driftloom.streaming.crawl import CrawlStream
from tests.test_crawl_stream import graph, walk, web


def test_one_host_without_pauses_has_several_keys(spark):
    seed, edges = graph(5, 1, 40, 4)
    outcomes, links = web(spark, edges)
    stream = CrawlStream(spark, seed, lambda rows: (outcomes, links), crawl.Gates())
    assert {r["url"]: r["depth"] for r in stream.run().collect()} == walk(edges, seed)
    asked = spark.read.option("recursiveFileLookup", "true").parquet(f"{stream.where}/rows").filter("kind = 'request'")
    assert asked.select("host").distinct().count() > 1
    with pytest.raises(ValueError):
        CrawlStream(spark, seed, lambda rows: (outcomes, links), crawl.Gates(), delay_ms=5.0, where=stream.where).start()
