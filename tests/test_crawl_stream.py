"""The crawl as a stream: restarts, politeness by timers, shorter ways found late."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from driftloom.operators import crawl
from driftloom.streaming.crawl import CrawlStream


def web(spark, edges, failing=()):
    """Tables of a small web: edges {url: urls}; every URL answers but those that fail."""
    urls = sorted({*edges, *(u for v in edges.values() for u in v)})
    outcomes = spark.createDataFrame([(u, "failed" if u in failing else "ok", "page", "HTTP 500" if u in failing else None, u not in failing) for u in urls], "url string, status string, out_kind string, why string, harvest boolean")
    links = spark.createDataFrame([(u, k, v, "page") for u, vs in edges.items() for k, v in enumerate(vs)], "src_url string, ord int, abs_url string, kind string")
    return outcomes, links


def walk(edges, seed, most=0, failing=()):
    depths, level, depth = {seed: 1}, [seed], 1
    while level and (not most or depth < most):
        level = sorted({v for u in level if u not in failing for v in edges.get(u, ()) if v not in depths})
        depth += 1
        depths |= dict.fromkeys(level, depth)
    return depths


def graph(seed, hosts, pages, links):
    rng = random.Random(seed)
    urls = [f"https://h{h}.test/p{k}" for h in range(hosts) for k in range(pages)]
    return urls[0], {u: rng.sample(urls, rng.randint(0, links)) for u in urls}


def test_ends_where_it_stopped(spark):
    seed, edges = graph(1, 3, 30, 4)
    failing = {u for u in edges if u.endswith(("7", "3")) and u != seed}
    outcomes, links = web(spark, edges, failing)
    asked = []

    def visit(rows):
        asked.append(rows.count())
        return outcomes, links

    gates = crawl.Gates(max_depth=5, exclude=("/P11",))
    first = CrawlStream(spark, seed, visit, gates)
    part = first.run(until=lambda: len(asked) >= 2).count()
    again = CrawlStream(spark, seed, visit, gates, where=first.where)
    rows = again.run().collect()
    cut = {u: [v for v in vs] for u, vs in edges.items() if "/p11" not in u}
    want = walk(cut, seed, 5, failing)
    assert {r["url"]: r["depth"] for r in rows} == want and part < len(rows)
    assert all(r["status"] == ("excluded" if "/p11" in r["url"] else "failed" if r["url"] in failing else "ok") for r in rows)
    assert sum(asked) == sum("/p11" not in u for u in want)  # no URL was asked twice
    assert {r["why"] for r in rows if r["status"] == "failed"} == {"HTTP 500"}
    assert again.run().count() == len(rows) and sum(asked) == sum("/p11" not in u for u in want)  # nothing is left to do


def test_hosts_wait_and_depths_settle(spark):
    """A slow host makes the short way late: what the long way found first must come nearer, with all behind it."""
    fast, slow = "https://fast.test", "https://slow.test"
    edges = {f"{fast}/": [f"{slow}/1", f"{slow}/2", f"{slow}/3", f"{fast}/a"], f"{fast}/a": [f"{fast}/b"], f"{fast}/b": [f"{fast}/c"], f"{fast}/c": [f"{fast}/goal"], f"{slow}/3": [f"{fast}/goal"], f"{fast}/goal": [f"{fast}/behind"], f"{fast}/behind": [f"{fast}/last"]}
    outcomes, links = web(spark, edges)
    times = defaultdict(list)

    def visit(rows):
        for r in rows.collect():
            times[r["url"].split("/")[2]].append(time.monotonic())
        return outcomes, links

    delays = spark.createDataFrame([("slow.test", 9.0)], "host string, crawl_delay double")
    stream = CrawlStream(spark, f"{fast}/", visit, crawl.Gates(max_depth=5), crawl_delay=delays)
    rows = stream.run(most=240)
    assert {r["url"]: r["depth"] for r in rows.collect()} == walk(edges, f"{fast}/", 5)
    assert all(b - a >= 7.5 for a, b in zip(times["slow.test"], times["slow.test"][1:], strict=False)) and len(times["slow.test"]) == 3
    emitted = spark.read.option("recursiveFileLookup", "true").parquet(f"{stream.where}/rows")
    assert emitted.filter("kind = 'nearer'").count() > 0 and emitted.agg(F.sum("open")).first()[0] == 0
