"""Exact top-k search against brute force and SQL; the tree's invariants; pruning; edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import cover_tree
from driftloom.llm.common import read
from driftloom.llm.oracles import ORACLES
from driftloom.llm.queries import QUERIES
from tests.conftest import DATA, rows_of, sql_rows


def clustered(n, dim, seed, clusters=12, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return np.floor(1024 * (centres[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dim)))).astype(np.int64)


def by_hand(rows, k=10):
    """rows: (vec_id, vector or None)."""
    fine = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    fine = [(i, x) for i, x in fine if sum(v * v for v in x) < 9e18]
    asked = {}
    for i, x in fine:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, x), x)
    out = []
    for q, x in asked.items():
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(x) == len(y))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def listed(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query_against_sql(spark, duck):
    df = QUERIES["op11_exact_top_k"](spark, DATA)
    assert rows_of(df) == sql_rows(duck, ORACLES["op11_exact_top_k"], sorted(df.columns))


@pytest.mark.parametrize("n,dim", [(1, 3), (2, 2), (500, 8), (1000, 64)])
def test_tree(n, dim):
    x = clustered(n, dim, n)
    tree = cover_tree.build(x)
    far = lambda a, b: np.sqrt(((a.astype(float) - b) ** 2).sum(-1))
    node, size = tree["near"], tree["sizes"][-1]
    assert sorted(cover_tree.depth_first(tree)) == list(range(size)) and len(set(tree["net"])) == size
    for level in range(len(tree["sizes"]) - 1, -1, -1):
        net = x[tree["net"][: tree["sizes"][level]]]
        assert (far(x, net[node]) <= tree["radius"][level][node] + 1e-9).all()
        if level:
            coarser = tree["sizes"][level - 1]
            node = np.where(node < coarser, node, tree["parent"][node])
    # nested nets whose points are apart: the next point was the furthest from all before it
    gaps = [far(x[tree["net"][:k]], x[p]).min() for k, p in enumerate(tree["net"]) if k]
    assert all(a >= b - 1e-9 for a, b in zip(gaps, gaps[1:], strict=False))


def test_walk_prunes_and_is_exact():
    x = clustered(4000, 16, 1)
    ids = np.arange(4000)
    asked = ids[::40]
    queries = {"x": x[asked], "ids": asked, "tree": cover_tree.build(x[asked])}
    data = {"x": x, "ids": ids, "tree": cover_tree.build(x)}
    best = cover_tree.Best(asked, np.full(len(asked), cover_tree.LOWEST), 10)
    took = cover_tree.walk(queries, data, best)
    full = x[asked] @ x.T
    full[np.arange(len(asked)), asked] = -(2**62)
    for row, (score, found) in enumerate(zip(best.score, best.id, strict=True)):
        want = np.lexsort((ids, -full[row]))[:10]
        assert (found == want).all() and (score == full[row][want]).all()
    assert took < 0.5 * full.size


def test_whole_numbers_beyond_doubles():
    a = np.array([[2**30 + 1, 3], [-(2**30) - 5, 7]])
    assert cover_tree.scores(a, a).tolist() == [[sum(int(u) * int(v) for u, v in zip(p, q, strict=True)) for q in a] for p in a]


@pytest.mark.parametrize("blocks", [False, True])
def test_search_by_hand(spark, monkeypatch, blocks):
    if blocks:  # many blocks, chunks and gangs
        for name, value in {"LEAST_ROWS": 16, "ROWS": 16, "LEAST_QUERIES": 2, "LEAST_GROUPS": 100, "CHUNK": 8, "GANG": 2, "SEEDS": 1, "SAMPLE": 30}.items():
            monkeypatch.setattr(cover_tree, name, value)
    x = clustered(900, 6, 2) / 1024
    rows = [(int(i) * 10, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001 + i, rows[0][1]) for i in range(30)] + [(7, rows[5][1])] * 3 + [(100, [9.0] * 6), (100, [9.0] * 6)]  # ties, repeated rows, a query id of two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "dim", "cell", "place", "rank", "group")})
    assert listed(cover_tree.top_k(df, F.col("vec_id") % 100 == 0)) == by_hand(rows)


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = lambda rows: listed(cover_tree.top_k(frame(rows), F.col("vec_id") % 100 == 0))
    odd = [(None, [1.0, 2.0]), (200, None), (300, []), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [1.0, float("-inf")]), (700, [1e200, 0.0]), (701, [1e18, 1.0])]
    some = [(0, [1.0, -1.0]), (1, [0.0, 0.0]), (2, [1e-300, -1e-300]), (3, [2.0, 5.0]), (100, [1e6, -3.0]), (-100, [2.5, 0.5]), (800, [1.0, 2.0, 3.0]), (801, [0.5, 0.5, 0.5]), (900, [1.0])]
    assert search(some + odd) == by_hand(some + odd) and {r[0] for r in search(some + odd)} == {0, 100, -100, 800}
    assert search([]) == search(odd) == search(some[:1]) == []
    assert {r[0] for r in search([(0, [3.0] * 4), *((i, [float(i)] * 4) for i in range(1, 40))])} == {0}
