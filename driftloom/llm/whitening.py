"""Embedding whitening: leading eigenvectors of the covariance by matrix-free block Lanczos, whitened coordinates, explained shares.

Components become whole numbers x = floor(1024 c) + 100000, so sums S and deviations n x - S are exact. The covariance is never formed: a pass over the rows multiplies it with a block of vectors,
the sum of (x - S/n) ((x - S/n) . v) over tasks, centred before multiplying; tasks add up their batches, Spark adds up the tasks, the driver gets dimension x block numbers. The driver
keeps an orthonormal basis and its products: each block is orthogonalised twice against the whole basis, directions that vanish (breakdown) restart from random ones, and a basis of more than
BASIS columns restarts from its leading Ritz vectors. It ends when the residuals of the wanted pairs are below TOLERANCE of the largest eigenvalue, or when the basis spans the space, which makes
the result that of a dense solver. The trace is the mean square deviation, so explained shares need no other eigenvalues. A last pass measures the covariance of what was whitened.

Work: rows x dimension x block a pass, ceil(dimension / BLOCK) passes at most for dimensions up to BASIS, more by the spectrum beyond; nothing is shuffled but sums. Rows are written once as whole numbers and read
once a pass, so a lost executor costs its tasks.

Defined cases: vectors that are null or hold null or non-finite entries, or entries of which 1024 c reaches 2^53 (x would not be exact), are left out; repeated rows count as often as they come; vec_id may be
null or repeat; vectors of each length are a fit list of their own (empty ones have no components); components whose eigenvalue is below ZERO of the largest are left out, as nothing can be whitened along
them (one row, or equal rows, give none). A deviation that no long holds (from some three million unit vectors on) is null; shares don't depend on it. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stage

COMPONENTS, BLOCK, BASIS, TOLERANCE, ZERO = 8, 16, 256, 1e-12, 1e-10
SCALE, SHIFT = 1024, 100_000
LONG = 2**63 - 1


def whole(table: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part."""
    bound = float(2**53)
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < bound), F.lit(False)))
    rows = table.filter(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.select("vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(rows: DataFrame, dim: int, size: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of fn(matrix of x) (`size` doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for x in matrices(batches, dim):
            out += fn(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], names=["place", "value"])

    found = rows.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of x for each dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, np.zeros(dim, object)
        for x in matrices(batches, dim):
            n += len(x)
            for k in range(0, len(x), 512):  # below 2^53 each, so sums of 512 are longs
                out += x[k : k + 512].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), dim]), pa.array([*map(Decimal, map(int, out)), Decimal(n)], pa.decimal128(38))], names=["place", "value"])

    found = rows.select("x").mapInArrow(run, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = {r["place"]: int(r["value"]) for r in found}
    return values.get(dim, 0), [values.get(k, 0) for k in range(dim)]


@dataclass
class Whitening:
    """A fit: eigenvalues fall, columns of `vectors` are unit eigenvectors of the covariance of x."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they hold it, else Python's numbers."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < LONG:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared deviations, exact; None where no long holds one."""
        d = self.deviations(x)
        if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 <= LONG:
            return (d * d).sum(axis=1).tolist()
        rough = (d.astype(float) ** 2).sum(axis=1)
        exact = (sum(int(v) ** 2 for v in row) if r < 1e19 else LONG + 1 for r, row in zip(rough, d, strict=True))
        return [e if e <= LONG else None for e in exact]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns of block, orthogonal to basis, as many as block has (or the space holds), and how many of them had to restart from random ones."""
    out, restarts = basis, 0
    for v in block.T[: len(basis) - basis.shape[1]]:
        for attempt in range(100):
            v = v - out @ (out.T @ v)
            before = np.linalg.norm(v)
            if before > 1e-10 * scale:
                v = v / before
                v = v - out @ (out.T @ v)
                if (after := np.linalg.norm(v)) > 0.5:
                    out = np.c_[out, v / after]
                    break
            restarts += attempt == 0
            v, scale = rng.standard_normal(len(basis)), 1.0
    return out[:, basis.shape[1] :], restarts


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, want: int = COMPONENTS, width: int = BLOCK, most: int = BASIS, tolerance: float = TOLERANCE, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest eigenvalues, falling, and eigenvectors of the symmetric, positive semidefinite matrix that `apply` multiplies a block with."""
    rng, want, width = np.random.default_rng(dim), min(want, dim), min(width, dim)
    basis, product = np.zeros((dim, 0)), np.zeros((dim, 0))
    block, restarts = _orthogonal(rng.standard_normal((dim, width)), basis, 1.0, rng)
    settled = 0
    for _ in range(steps):
        new = apply(block)
        basis, product = np.c_[basis, block], np.c_[product, new]
        small = basis.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        residuals = product @ vectors[:, :want] - basis @ vectors[:, :want] * values[:want]
        worst = np.linalg.norm(residuals, axis=0).max()
        settled = settled + 1 if len(values) >= 2 * width and worst <= tolerance * max(values[0], 0.0) else 0
        if basis.shape[1] == dim or settled > bool(restarts):  # after a restart the random directions are heard once more
            return values[:want], basis @ vectors[:, :want]
        scale = max(abs(values[0]), 1e-300)
        if basis.shape[1] + width > most:
            keep = vectors[:, : 2 * width]
            new = product @ keep[:, :width] - basis @ keep[:, :width] * values[:width]
            basis, product = basis @ keep, product @ keep
        block, restarts = _orthogonal(new, basis, scale, rng)
    raise RuntimeError("the eigenvalues did not settle")


def fit_whitening(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """rows: whole()'s of one length, a written table."""
    bounded_batches(rows.sparkSession)
    n, sums = exact_sums(rows, dim)
    fit = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    first = totals(rows, dim, dim + 1, lambda x: np.append((c := fit.centred(x)).sum(axis=0), (c * c).sum()))
    fit.trace = float(first[dim]) / n
    if not fit.trace > 0:
        return fit

    def apply(block: np.ndarray) -> np.ndarray:
        return totals(rows, dim, block.size, lambda x: (c := fit.centred(x)).T @ (c @ block)).reshape(block.shape) / n

    values, vectors = lanczos(apply, dim, components)
    some = values > ZERO * values[0]
    fit.values, fit.vectors = values[some], vectors[:, some]
    k, rest = len(fit.values), first[:dim] / n @ fit.vectors / np.sqrt(fit.values)  # what rounding leaves of the mean
    shape = totals(rows, dim, k * k, lambda x: (z := fit.project(x) - rest).T @ z).reshape(k, k) / n
    fit.identity_error = float(np.abs(shape - np.eye(k)).max())
    return fit


def whitened(rows: DataFrame, dim: int, fit: Whitening) -> DataFrame:
    """A row for each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    k = len(fit.values)
    schema = T.StructType([rows.schema["vec_id"], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in matrices(iter([batch]), dim):
                m, ids = len(x), batch.column(batch.schema.get_field_index("vec_id"))
                columns = [
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                    pa.array([d for d in fit.squares(x) for _ in range(k)], pa.int64()), pa.array(fit.project(x).ravel()),
                    pa.array(np.tile(fit.values / fit.trace, m)), pa.array(np.full(m * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """table (vec_id, embedding) fitted and whitened: see whitened()."""
    rows = stage(whole(table), "whole")
    out = None
    for r in rows.filter("dim > 0").select("dim").distinct().collect():
        own = rows.filter(F.col("dim") == r["dim"])
        part = whitened(own, r["dim"], fit_whitening(own, r["dim"], components))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else whitened(rows.limit(0), 1, Whitening(0, [0], np.zeros(0), np.zeros((1, 0)), 0.0))
