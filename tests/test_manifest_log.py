"""The manifest's log: merging, counters, lookups of few buckets, compaction, conflicts, restarts."""

import random

import pytest

from driftloom.operators.manifest import report
from driftloom.schemas import MANIFEST
from driftloom.sources.manifest_log import ManifestLog


def row(url, status, kind, seq, size=7):
    return (url, "p" if status == "ok" else "", status, kind, "text/html", "h", size if status == "ok" else 0, "static", None, seq)


def plain(df):
    return sorted(tuple(r) for r in df.select("url", "status", "kind", "size_bytes", "seq").collect())


def test_random_upserts(spark, tmp_path):
    rng, log, model = random.Random(2), ManifestLog(spark, f"file://{tmp_path}/log", buckets=5, deltas=2), {}
    for n in range(7):
        rows = [row(f"https://h.test/{rng.randrange(40)}", rng.choice(["ok", "failed", "robots", "excluded"]), rng.choice(["page", "asset"]), k if n < 4 else -k, rng.randrange(100)) for k in range(rng.choice([1, 25]))]
        counts = log.upsert(spark.createDataFrame(rows, MANIFEST))
        for r in sorted(rows, key=lambda r: r[-1]):
            model[r[0]] = r
        assert plain(log.read()) == sorted((r[0], r[2], r[3], r[6], r[9]) for r in model.values())
        assert counts == report(log.read()).first().asDict()
    state = log.state()
    assert max(map(len, state["live"].values())) <= 3 and state["number"] > 6  # some buckets were compacted
    before = plain(log.read())
    log.compact()
    assert {len(f) for f in log.state()["live"].values()} == {1} and log.vacuum() > 0 and plain(log.read()) == before
    assert log.replace(spark.createDataFrame([row("u", "ok", "page", 1)], MANIFEST))["pages"] == 1 and log.read().count() == 1


def test_lookup_reads_its_own_buckets(spark, tmp_path):
    log = ManifestLog(spark, f"file://{tmp_path}/log", buckets=8)
    log.upsert(spark.createDataFrame([row(f"u{k}", "ok", "page", k) for k in range(200)], MANIFEST))
    found = log.lookup(spark.createDataFrame([("u7",), ("none",)], "url string"))
    assert plain(found) == [("u7", "ok", "page", 7, 7)]
    assert len(found.inputFiles()) <= 2 < len(log.read().inputFiles())


def test_tokens_and_conflicts(spark, tmp_path):
    log = ManifestLog(spark, f"file://{tmp_path}/log", buckets=2)
    assert not log.exists() and log.read().count() == 0
    one = spark.createDataFrame([row("u", "ok", "page", 1)], MANIFEST)
    log.upsert(one, 4)
    assert log.upsert(spark.createDataFrame([row("v", "ok", "page", 1)], MANIFEST), 4)["pages"] == 1 and log.read().count() == 1
    state = log.state()
    with pytest.raises(RuntimeError, match="another writer"):
        log._commit(state)
    assert ManifestLog(spark, f"file://{tmp_path}/log").state() == state
