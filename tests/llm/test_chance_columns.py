"""N-grams that many unrelated texts share must not tie these into clusters, whose full rows meet by the square."""

import random

import numpy as np
import pytest

from driftloom.llm import jaccard_join
from driftloom.llm.common import stage
from driftloom.llm.shingles import WordCodes, shingle_set
from tests.llm.test_llm import jaccard_by_hand


@pytest.mark.parametrize("seed", range(3))
def test_sketches_never_rule_out_a_link(seed):
    r = np.random.default_rng(seed)
    for n in (1, 2, 9, 63, 64, 65, 128, 700, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for gone, more in ((0, n // 4), (n // 5, 0), (n // 10, n // 10), (n // 2, n)):
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, more).astype(np.uint64)]))
            x, y = sorted((np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in (a, b)), key=len)
            assert np.bitwise_count(x ^ jaccard_join.folded(y, len(x))).sum() <= len(np.setxor1d(a, b))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                sets = sorted((a, b), key=len)
                assert jaccard_join.sketch_links(np.array([len(s) for s in sets]), [np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in sets], 80) == [(0, 1)]


@pytest.fixture
def corpus(monkeypatch):
    """Rows of 90 unrelated texts and 40 near copies that share one shingle, and the tables that the join stages."""
    r, codes = random.Random(1), WordCodes()
    word = lambda: f"w{r.randrange(10**9)}"
    #: Words whose one shingle has a small hash, so that it lies in every text's shared part.
    shared = next(p for p in (" ".join(word() for _ in range(5)) for _ in range(10**6)) if shingle_set(p.encode(), codes)[0] < 1 << 54)
    base = [word() for _ in range(120)]
    alike = [" ".join([*base[:k], word(), *base[k + 1 :], shared]) for k in range(0, 120, 3)]
    alone = [" ".join([*(word() for _ in range(r.randrange(60, 400))), shared]) for _ in range(90)]
    tables = {}
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: tables.setdefault(name, stage(df, name)))
    monkeypatch.setattr(jaccard_join, "common_ngrams", lambda _: np.zeros(0, np.uint64))
    return list(enumerate(alone + alike)), tables


@pytest.mark.parametrize("tile", [1 << 25, 20_000])
def test_chance_columns_do_not_chain(spark, monkeypatch, corpus, tile):
    monkeypatch.setattr(jaccard_join, "SKETCHED", tile, raising=False)
    rows, tables = corpus
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(a), b, str(c)) for a, b, c in got.collect()) == jaccard_by_hand(rows)
    assert {r["doc_id"] for r in tables["named"].join(tables["clusters"].withColumnRenamed("sid", "set"), "set").collect()} == set(range(90, 130))


def test_pipeline_stage_drops_near_copies_only(spark, corpus):
    rows, tables = corpus
    got = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(91))
    assert tables["clusters"].count() == 40
