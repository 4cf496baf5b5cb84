"""Whitening against a dense solver, exact deviations, edge cases; Lanczos on spectra that make trouble."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import whitening
from driftloom.llm.common import read
from driftloom.llm.queries import QUERIES
from tests.conftest import DATA


def check(rows, vectors, components=8):
    """rows of the query against numpy's dense solver on `vectors` {vec_id: vector} of one length."""
    ids = list(vectors)
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in ids])
    n, s = len(x), [int(v) for v in x.astype(object).sum(axis=0)]
    c = (x - x.mean(axis=0, dtype=np.longdouble)).astype(float)
    values, unit = np.linalg.eigh(c.T @ c / n)
    values, unit = values[::-1][:components], unit[:, ::-1][:, :components]
    z = c @ unit / np.sqrt(values)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and 0 <= r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / ((c * c).sum() / n), rel=1e-9)
    assert set(got) == set(ids) and all(set(g) == set(range(1, len(values) + 1)) for g in got.values())
    for k, i in enumerate(ids):
        assert {r["deviation"] for r in got[i].values()} == {sum((n * int(v) - t) ** 2 for v, t in zip(x[k], s, strict=True))}
    mine = np.array([[got[i][j + 1]["whitened"] for j in range(len(values))] for i in ids])
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * sign - z).max() < 1e-6
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(len(values))).max() <= 1e-4


def test_query_against_dense_solver(spark):
    rows = read(spark, DATA, "embeddings").select("vec_id", "embedding").collect()
    check(QUERIES["op13_embedding_whitening"](spark, DATA).collect(), {r["vec_id"]: r["embedding"] for r in rows})


@pytest.mark.parametrize("dim,n,components", [(3, 40, 3), (100, 60, 8)])
def test_other_shapes(spark, dim, n, components):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((n, dim)) * rng.random(dim) ** 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "dim", "component")})
    check(whitening.whiten(df).collect(), dict(enumerate(x.tolist())), components)


def test_edges(spark):
    ok = [(i, [float(i % 5), float(i % 3), 0.5]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1e300, 0.0, 0.0]), (105, [])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame(ok + odd)).collect()
    assert {r["vec_id"] for r in got} == set(range(30)) and {r["component"] for r in got} == {1, 2}  # the third dimension has no spread
    both = whitening.whiten(frame([*ok, (None, [1.0, 1.0, 1.0]), (7, [9.0, 0.0, 1.0]), (200, [1.0]), (201, [2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 9))) for r in both if r["vec_id"] is not None and r["vec_id"] >= 200) == [(200, 1, 2, 1048576, 1.0), (201, 1, 2, 1048576, 1.0)]
    assert sum(r["vec_id"] is None for r in both) == 3 and sum(r["vec_id"] == 7 for r in both) == 6 and {r["n"] for r in both} == {32, 2}
    for rows in ([], odd, ok[:1], ok[:1] * 4):
        assert whitening.whiten(frame(rows)).collect() == []
    far = whitening.whiten(frame([(1, [8e12, 0.0]), (2, [-8e12, 1.0]), (3, [0.0, 3.0])])).collect()
    assert all(r["deviation"] is None for r in far if r["vec_id"] < 3) and {r["component"] for r in far} == {1}


def spectrum(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [[5.0], [3.0] * 40, [1.0] + [0.0] * 59, [9.0] * 20 + [1.0] * 100, [2.0**-k for k in range(200)], list(1 + np.linspace(0, 1, 600) ** 8), [100.0, 99.999999, 50] + [1e-9] * 297],
)
def test_lanczos(values):
    a = spectrum(np.array(values, float))
    passes = []
    got, unit = whitening.lanczos(lambda b: passes.append(1) or a @ b, len(values), most=96)
    want = np.sort(values)[::-1][:8]
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12) and np.abs(unit.T @ unit - np.eye(len(want))).max() < 1e-12
    assert np.linalg.norm(a @ unit - unit * got, axis=0).max() < 1e-11 * want[0]
    assert len(passes) <= 60
