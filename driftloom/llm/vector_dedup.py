"""Embedding near-dedup by collision counting on one-dimensional projections.

Distinct vectors (copies share one entry) are projected on PROJECTIONS fixed random directions, orthonormal as far as the dimension allows. Two
vectors collide on a projection if either lies in the window of half width `reach` around the other. For a pair at the
threshold the number of collisions is nearly binomial; the count that a pair must have is the largest that such a pair reaches with probability
RECALL, closer pairs reach it more often. Pairs with the count are verified by their cosine in double precision.

Sorting by the first projection deals the vectors into tiles of TILE ranks; pairs of tiles further apart than any link can be are skipped.
STRIPS neighbouring tiles, fewer where there are few, make a strip, and each pair of strips is one unit of work that takes its pairs of tiles one
after another. In them every projection of one tile is sorted; a query's window is a range of that order, its
members are the difference of two prefix bit sets, and bit-sliced counters add up the collisions of all queries with all members at once.
A unit emits each vector's number of links and those links that join something, so that groups of near copies give no rows for their pairs.

The work grows with the square of the vectors, less the pairs of tiles that are skipped, whatever the plan, as a window of a pair at the threshold holds a fixed share of
all vectors on each projection; a vector is sent once for each strip that its own meets. The driver reads the bounds of the tiles (one row for each
TILE vectors) and gives each strip the range of its partners.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, link with nothing; finite components of any size count (vectors are scaled by the largest first); vectors of
different dimensions don't either; repeated rows and equal vectors link with each other. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, hot_keys, spread_join, stage
from .components import components
from .ranks import ranked

COSINE, PROJECTIONS, RECALL, TILE = 0.9, 32, 0.995, 8192
#: Most tiles of a strip and bytes of its vectors; strips that there are at least before they grow.
STRIPS, STRIP_BYTES, LEAST_STRIPS = 16, 32 << 20, 64
#: Half width of a window in standard deviations of the difference of a pair at the threshold.
WIDTH = 1.0


def directions(dim: int) -> np.ndarray:
    """PROJECTIONS fixed unit vectors."""
    rng, out = np.random.default_rng(dim), []
    while sum(map(len, out)) < PROJECTIONS:
        out.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.concatenate(out)[:PROJECTIONS]


def count_needed(cosine: float) -> int:
    """The largest count that a pair at the threshold has with probability RECALL or more."""
    p = math.erf(WIDTH / math.sqrt(2))
    below = 0.0
    for k in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > 1 - RECALL:
            return k
    return PROJECTIONS


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def colliding(a: np.ndarray, b: np.ndarray, reach: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that collide on at least `need` of the projections (columns)."""
    n, words = len(b), -(-len(b) // 64)
    bits = max(1, PROJECTIONS.bit_length())
    start = (1 << bits) - need  # the counters start so that `need` collisions carry into the highest slice
    slices = [np.full((len(a), words), np.uint64(2**64 - 1) if start >> k & 1 else np.uint64(0)) for k in range(bits + 1)]
    place = np.arange(n)
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        prefix = np.zeros((n + 1, words), np.uint64)
        prefix[place + 1, order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.bitwise_or.accumulate(prefix, axis=0, out=prefix)
        values = b[order, j]
        carry = prefix[np.searchsorted(values, a[:, j] + reach, "right")] ^ prefix[np.searchsorted(values, a[:, j] - reach, "left")]
        for s in slices:
            s ^= carry
            carry &= ~s
    left, word = np.nonzero(slices[bits])
    for k in range(0, len(left), 1 << 16):
        got = np.unpackbits(slices[bits][left[k : k + (1 << 16)], word[k : k + (1 << 16)]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, cols = np.nonzero(got)
        yield left[k : k + (1 << 16)][rows], word[k : k + (1 << 16)][rows] * 64 + cols


def unit(a: np.ndarray, b: np.ndarray | None, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of a and of b, weighted by the other side's copies, and links that join something. b None: within a."""
    x = a if b is None else b
    to = directions(a.shape[1]).T
    reach = WIDTH * math.sqrt(max(0.0, 2 - 2 * cosine) / a.shape[1]) + 1e-9
    links_a, links_b, joins = np.zeros(len(a), np.int64), np.zeros(len(x), np.int64), []
    root_a = np.arange(len(a))
    root_b = root_a if b is None else len(a) + np.arange(len(b))
    for i, j in colliding(a @ to, x @ to, reach, count_needed(cosine)):
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            ok = np.einsum("ij,ij->i", a[p], x[q]) >= cosine
            p, q = p[ok], q[ok]
            np.add.at(links_a, p, weight_b[q])
            np.add.at(links_b, q, weight_a[p])
            apart = root_a[p] != root_b[q]
            for s, t in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                old, new = root_b[t], root_a[s]
                if old != new:
                    joins.append((s, t))
                    root_a[root_a == old] = new
                    root_b[root_b == old] = new
    return links_a, links_b, joins


def linked(vectors: DataFrame, cosine: float) -> DataFrame:
    """(dim, vh, embedding, copies) to rows kind 0: (a: vh, b: links to other vectors' copies) and kind 1: (a, b) links that join."""
    dims = [r["dim"] for r in vectors.select("dim").distinct().collect()]
    first = {d: directions(d)[0].tolist() for d in dims}
    #: Scaled by the largest component first: squares of very small or large ones would vanish or overflow.
    vectors = vectors.withColumn("most", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    scaled = vectors.withColumn("scaled", F.transform("embedding", lambda x: x.cast("double") / F.col("most")))
    value = None
    for d in dims:
        norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
        dot = F.aggregate(F.zip_with("scaled", F.lit(first[d]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        value = (F if value is None else value).when(F.col("dim") == d, dot / norm)
    rows = ranked(scaled.withColumn("value", value if value is not None else F.lit(0.0)).drop("scaled", "most"), ["dim"], ["value", "vh"], "place")
    rows = stage(rows.withColumn("tile", F.expr(f"(place - 1) div {TILE}")), "tiles")
    #: However the other directions fall, a pair further apart than this on one is further apart than any link.
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    spans = rows.groupBy("dim", "tile").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("dim", "tile").toPandas()
    plan, bounds = [], {}
    for d, s in spans.groupby("dim"):
        d, lo, hi = int(d), s["lo"].to_numpy(), s["hi"].to_numpy()  # both ascend
        wide = int(max(1, min(STRIPS, STRIP_BYTES // (8 * d * TILE), len(s) // LEAST_STRIPS)))
        bounds[d] = (wide, lo, hi)
        lo, hi = lo[::wide], np.append(hi[wide - 1 :: wide], hi[-1:])[: len(lo[::wide])]
        plan += [(d, k, int(a), int(b)) for k, (a, b) in enumerate(zip(np.searchsorted(hi, lo - far), np.searchsorted(lo, hi + far, "right") - 1, strict=True))]
    plan = vectors.sparkSession.createDataFrame(plan, "dim int, strip long, first long, last long")
    strips = F.lit(1).cast("long")
    for d, (wide, _, _) in bounds.items():
        strips = F.when(F.col("dim") == d, F.lit(wide).cast("long")).otherwise(strips)
    sent = F.col("embedding") if rows.schema["embedding"].dataType.elementType == T.FloatType() else F.col("embedding").cast("array<double>")  # floats become doubles where they are used
    dealt = rows.select("dim", "tile", F.expr("tile").alias("strip"), "vh", "copies", sent.alias("embedding")).withColumn("strip", F.floor(F.col("tile") / strips))
    dealt = dealt.join(plan, ["dim", "strip"]).withColumn("other", F.explode(F.expr("sequence(first, last)")))
    dealt = dealt.select("dim", F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"), "tile", "vh", "copies", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> pa.RecordBatch:
            kind, a, b = [], [], []
            if parts:
                table = pa.Table.from_batches(parts)
                dim, i, j = now
                wide, lo, hi = bounds[dim]
                tile, vh, copies = (table.column(k).to_numpy() for k in ("tile", "vh", "copies"))
                x = unit_rows(table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(tile), -1))
                links, at = np.zeros(len(tile), np.int64), {t: np.flatnonzero(tile == t) for t in np.unique(tile).tolist()}
                for t in (t for t in at if t // wide == i):
                    for u in (u for u in at if u // wide == j and u >= t and lo[u] <= hi[t] + far):
                        p, q = at[t], at[u]
                        la, lb, joins = unit(x[p], x[q] if u != t else None, copies[p], copies[q], cosine)
                        links[p] += la
                        links[q] += lb
                        a += vh[p[[s for s, _ in joins]]].tolist() if joins else []
                        b += vh[q[[s for _, s in joins]]].tolist() if joins else []
                some = np.flatnonzero(links)
                kind = [1] * len(a) + [0] * len(some)
                a, b = a + vh[some].tolist(), b + links[some].tolist()
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("dim", "i", "j")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if keys[s] != now:
                        yield done()
                        now, parts = keys[s], []
                    parts.append(batch.slice(s, e - s))
        yield done()

    bounded_batches(vectors.sparkSession)
    units = plan.agg(F.coalesce(F.sum(F.col("last") - F.col("strip") + 1), F.lit(1)).alias("n")).first()["n"]
    return dealt.repartition(max(1, min(units, 20000)), "dim", "i", "j").sortWithinPartitions("dim", "i", "j").mapInArrow(run, "kind int, a long, b long")


def vector_groups(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of table (vec_id, embedding)."""
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    #: A vector is named by 64 bits of hash; where two share a name (of n about n^2 / 2^65 do), by 64 others.
    rows = table.select("vec_id", "embedding").withColumn("vh", F.when(fine, F.xxhash64("embedding", F.size("embedding")))).withColumn("other", F.when(fine, F.xxhash64(F.lit("other"), "embedding", F.size("embedding"))))
    named = rows.groupBy("vh").agg(F.min("other").alias("low"), F.max("other").alias("high")).filter("vh is not null and low <> high")
    if shared := [r["vh"] for r in named.select("vh").collect()]:
        rows = rows.withColumn("vh", F.when(F.col("vh").isin(shared), F.col("other")).otherwise(F.col("vh")))
    ids = stage(rows.select("vec_id", "vh"), "vectors")
    distinct = rows.filter("vh is not null").groupBy("vh").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))
    links = stage(linked(stage(distinct, "distinct"), cosine), "links")
    counts = links.filter("kind = 0").groupBy(F.col("a").alias("vh")).agg(F.sum("b").alias("links"))
    labels = components(links.filter("kind = 1").select("a", "b")).select(F.col("node").alias("vh"), "label")
    groups = ids.filter("vh is not null").groupBy("vh").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    groups = groups.join(counts, "vh", "left").join(labels, "vh", "left").withColumn("label", F.coalesce("label", "vh"))
    groups = stage(groups, "groups")
    least = stage(groups.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    named = stage(spread_join(groups, least.drop("n"), "label", hot_keys(least, "label")).select("vh", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    out = spread_join(ids.filter("vh is not null"), named, "vh", hot_keys(groups.withColumnRenamed("copies", "n"), "vh"))
    out = out.unionByName(ids.filter("vh is null").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast(ids.schema["vec_id"].dataType)}))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
