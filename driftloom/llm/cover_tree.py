"""Exact top-k search by inner product with cover trees of queries and data that are walked together.

Components become whole numbers floor(1024 x), so scores are exact. A cover tree holds points in nested nets, each twice as fine as the one above: a net's points are further apart than its scale, and
every point lies within it of one. A node knows its covering radius, the distance to the furthest point below it. For a query node with centre q, radius a and a data node
with centre r, radius b no inner product below them exceeds q.r + a|r| + b|q| + ab: where that is less than the worst k-th score of the queries below, the pair of nodes is pruned with all below it.

One tree over queries and data together gives the order: its top, built over a documented sample of SAMPLE rows, deals every row to its nearest net point, and rows in
the tree's depth-first order (within a net point by distance) are cut into blocks of data and groups of queries, so that a place that holds a third of all rows gives many blocks. Blocks and groups hold trees of their own,
down to LEAF rows, packed into one value of at most VALUE bytes. The upper levels of the walk are Spark's: groups meet the centres and radii of all blocks in chunks, pairs that can't hold anything are dropped,
the rest is walked in tasks of one block and up to GANG groups. Two rounds: each group's SEEDS most promising blocks first, whose k-th scores prune the other pairs before any data is sent.

Scale: a stated query set against all rows in blocks, so pairs of a group and a block are compared by their centres (queries x rows / block size^2) and those that no bound excludes are read: the less the
vectors cluster, the more of them. A pair sends a group's value, each block is sent once for GANG groups. The driver holds the sample (SAMPLE rows, 8 MB at most) and counts.

Defined cases: vectors that are null or empty, hold null or non-finite components, or whose whole numbers have a squared length of 9e18 or more (scores would be no longs) take no part, nor do rows without vec_id; vectors of
different lengths aren't compared. A query id asks once, with the least of its vectors; rows that have the query's id are its own and no candidates; repeated other rows count as often as they come. Ties go to the
smaller vec_id, fewer than k candidates are all returned. Other columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stage
from .ranks import ranked

K, SCALE = 10, 1024
#: Rows of the sample; rows below a leaf; most rows of a block or group and bytes of its vectors; groups of one task; blocks of a group's first round; blocks in a chunk.
SAMPLE, LEAF, ROWS, VALUE, GANG, SEEDS, CHUNK = 2048, 8, 4096, 4 << 20, 16, 4, 128
#: There are so many blocks and groups before they grow, if they hold that many rows.
LEAST_BLOCKS, LEAST_ROWS, LEAST_GROUPS, LEAST_QUERIES = 64, 256, 16, 32
LONGEST, SLACK, LOWEST = 9e18, 1e-9, -(2**63)


def build(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray | list]:
    """A cover tree of the rows of x (whole numbers): `net` (rows, coarse ones first), `sizes` (points of each level's net), `parent` (of each net point at the level above its
    own), `near` (each row's point of the finest net), `radius` (of the nodes of each level). The furthest row from the net so far is the next point, which makes nets nested and apart."""
    x = x.astype(np.float64)
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    most = max(1, len(x) // leaf)
    net, parent, near, sizes = [first], [0], np.zeros(len(x), np.int64), [1]
    far = ((x - x[first]) ** 2).sum(1)
    above, scale = near.copy(), far.max() / 4  # of squared distances, so half the distance
    while len(net) < most and (p := int(far.argmax())) >= 0 and far[p] > 0:
        if far[p] <= scale:
            if len(net) > sizes[-1]:
                sizes.append(len(net))
                above = near.copy()
            while far[p] <= scale:
                scale /= 4
        parent.append(int(above[p]))
        net.append(p)
        away = ((x - x[p]) ** 2).sum(1)
        closer = away < far
        near[closer], far[closer] = len(net) - 1, away[closer]
    if len(net) > sizes[-1]:
        sizes.append(len(net))
    net, parent, radius, node = np.array(net), np.array(parent), [], near
    for size, coarser in zip(sizes[::-1], [*sizes[-2::-1], 0], strict=True):
        reach = np.zeros(size)
        np.maximum.at(reach, node, np.sqrt(((x - x[net[node]]) ** 2).sum(1)))
        radius.append(reach)
        node = np.where(node < coarser, node, parent[node])
    return {"net": net, "sizes": sizes, "parent": parent, "near": near, "radius": radius[::-1]}


def depth_first(tree: dict) -> np.ndarray:
    """The place of each point of the finest net in depth-first order."""
    paths, node = [], np.arange(tree["sizes"][-1])
    for coarser in [*tree["sizes"][-2::-1], 0]:
        paths.append(node)
        node = np.where(node < coarser, node, tree["parent"][node])
    place = np.empty(len(paths[0]), np.int64)
    place[np.lexsort(paths)] = np.arange(len(place))
    return place


def _children(tree: dict, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of level + 1 sorted by their parent, and where each node's children begin (with an end)."""
    size, finer = tree["sizes"][level], tree["sizes"][level + 1]
    parent = np.where(np.arange(finer) < size, np.arange(finer), tree["parent"][:finer])
    order = np.argsort(parent, kind="stable")
    return order, np.searchsorted(parent[order], np.arange(size + 1))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs, exact: doubles hold them, or longs, whose sums may wrap on the way but not at the end."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


class Best:
    """The k best of each query so far; `floor` is a k-th score that is known to be reached elsewhere."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.id = np.full((len(ids), k), LOWEST), np.full((len(ids), k), 2**63 - 1)
        self.floor = floor.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, got: np.ndarray) -> None:
        got = np.where(self.ids[rows][:, None] == ids[None, :], LOWEST, got)
        wide = np.c_[self.score[rows], got], np.c_[self.id[rows], np.broadcast_to(ids, got.shape)]
        at = np.lexsort((wide[1], -np.maximum(wide[0], -(2**63 - 1))), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = (np.take_along_axis(w, at, 1) for w in wide)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows][:, -1])


def walk(queries: dict, data: dict, best: Best) -> int:
    """Walk both trees (of values with x, ids, tree) together, fill best, return how many inner products of rows it took."""
    q, r, level = queries["tree"], data["tree"], 0
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    length = [np.sqrt((v["x"][v["tree"]["net"]].astype(float) ** 2).sum(1)) for v in (queries, data)]
    centre = [v["x"][v["tree"]["net"]].astype(float) for v in (queries, data)]
    lowest = len(q["sizes"]) - 1, len(r["sizes"]) - 1
    node = [q["near"]]
    for coarser in q["sizes"][-2::-1]:
        node.append(np.where(node[-1] < coarser, node[-1], q["parent"][node[-1]]))
    node = node[::-1]  # of each query, by level
    while True:
        lq, lr = min(level, lowest[0]), min(level, lowest[1])
        worst = np.full(q["sizes"][lq], np.inf)
        np.minimum.at(worst, node[lq], best.floor.astype(float))
        ra, rb = q["radius"][lq][a], r["radius"][lr][b]
        bound = np.concatenate([np.einsum("ij,ij->i", centre[0][a[s : s + 8192]], centre[1][b[s : s + 8192]]) for s in range(0, len(a), 8192)])
        bound = bound + ra * length[1][b] + rb * length[0][a] + ra * rb + SLACK * (length[0][a] + ra) * (length[1][b] + rb) + 1e-6
        keep = bound >= worst[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        if not len(a):
            return 0
        if level >= max(lowest):
            break
        for tree, low, mine in ((q, lowest[0], 0), (r, lowest[1], 1)):
            if level < low:
                order, begins = _children(tree, level)
                own = (a, b)[mine]
                many = begins[own + 1] - begins[own]
                at = np.repeat(begins[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                a, b = (order[at], np.repeat(b, many)) if mine == 0 else (np.repeat(a, many), order[at])
        level += 1
    rows = [np.argsort(q["near"], kind="stable"), np.argsort(r["near"], kind="stable")]
    begins = [np.searchsorted(t["near"][o], np.arange(t["sizes"][-1] + 1)) for t, o in zip((q, r), rows, strict=True)]
    took, order = 0, np.lexsort((-bound, a))
    a, b, bound = a[order], b[order], bound[order]
    leaves, starts = np.unique(a, return_index=True)
    for leaf, s, e in zip(leaves, starts, [*starts[1:], len(a)], strict=True):
        asked, many = rows[0][begins[0][leaf] : begins[0][leaf + 1]], 8
        while s < e and bound[s] >= best.floor[asked].min():  # the most promising leaves first, so that the others fall
            chosen = b[s : min(e, s + many)][bound[s : min(e, s + many)] >= best.floor[asked].min()]
            at = np.concatenate([rows[1][begins[1][c] : begins[1][c + 1]] for c in chosen])
            best.add(asked, data["ids"][at], scores(queries["x"][asked], data["x"][at]))
            took, s, many = took + len(asked) * len(at), s + many, 2 * many
    return took


def integers(table: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the rows that take part."""
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < LONGEST / SCALE), F.lit(False)))
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))
    return rows.filter(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < LONGEST)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _placed(rows: DataFrame, dim: int, sample: np.ndarray, tree: dict) -> DataFrame:
    """rows with their cell, in depth-first order, and the distance from its centre."""
    centres, place = sample[tree["net"]].astype(float), depth_first(tree)
    own = (centres**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dim).astype(float)
                cell = (own - 2 * (x @ centres.T)).argmin(1)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place[cell]), pa.array(away)], names=["vec_id", "dim", "x", "cell", "away"])

    return rows.select("vec_id", "dim", "x").mapInArrow(run, "vec_id long, dim int, x array<long>, cell long, away double")


def _packed(rows: DataFrame, dim: int, name: str, most: int, k: int = K, sample: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """rows with their `place` cut into values of `most`: name (number), centre, radius, length, worst, value. sample: rows and ids whose k-th score is where queries begin."""

    def value(x: np.ndarray, ids: np.ndarray) -> tuple:
        tree, floor = build(x), np.zeros(0, np.int64)
        if sample is not None:
            best = Best(ids, np.full(len(ids), LOWEST), k)
            for at in range(0, len(ids), 256):
                best.add(np.arange(at, min(at + 256, len(ids))), sample[1], scores(x[at : at + 256], sample[0]))
            floor = best.floor
        centre = x[tree["net"][0]].astype(float)
        worst = float(floor.min()) if len(floor) else 0.0
        return centre.tolist(), float(tree["radius"][0][0]), float(np.sqrt((centre**2).sum())), worst, pickle.dumps({"x": x, "ids": ids, "tree": tree, "floor": floor}, protocol=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, xs, ids = None, [], []

        def done() -> pa.RecordBatch:
            found = [value(np.concatenate(xs), np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.binary())))], names=[name, "centre", "radius", "length", "worst", "value"])

        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if number[s] != now and xs:
                        yield done()
                        xs, ids = [], []
                    now = int(number[s])
                    part = batch.slice(s, e - s)
                    xs.append(_matrix(part.column(2), dim))
                    ids.append(part.column(1).to_numpy())
        if xs:
            yield done()

    cut = rows.select(F.expr(f"(place - 1) div {most}").alias(name), "vec_id", "x")
    return cut.repartition(name).sortWithinPartitions(name, "vec_id").mapInArrow(run, f"{name} long, centre array<double>, radius double, length double, worst double, value binary")


def _bound() -> Column:
    dot = F.aggregate(F.zip_with("centre", "of_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = lambda a, b: F.col("radius") * F.col(b) + F.col(f"of_{a}") * F.col("length") + F.col("radius") * F.col(f"of_{a}")
    return dot + reach("radius", "of_length") + F.lit(SLACK) * (F.col("length") + F.col("radius")) * (F.col("of_length") + F.col("of_radius")) + 1e-6


def _search(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, chunks: int, k: int) -> DataFrame:
    """pairs (group, block, chunk) walked: (group, at: the query's place in its group, query_id, vec_id, score), each pair's k best that may count."""
    gang = F.expr(f"group div {GANG}").alias("gang")
    units = pairs.select("block", gang).distinct()
    none = F.lit(None)
    held = units.join(blocks.select("block", "value").hint("merge"), "block").select("block", "gang", none.cast("long").alias("group"), "value", none.cast("array<long>").alias("floors"))
    salted = groups.select("group", "value", "floors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    asked = pairs.select("group", "block", "chunk").join(salted.hint("merge"), ["group", "chunk"]).select("block", gang, "group", "value", "floors")
    count = max(1, min(units.count(), 20_000))
    dealt = held.unionByName(asked).repartition(count, "block", "gang").sortWithinPartitions("block", "gang", F.asc_nulls_first("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for number, value, floors in zip(*(batch.column(c) for c in (2, 3, 4)), strict=True):
                if not number.is_valid:
                    data = pickle.loads(value.as_py())
                    continue
                queries = pickle.loads(value.as_py())
                floor = queries["floor"] if not floors.is_valid else np.maximum(queries["floor"], np.array(floors.as_py(), np.int64))
                best = Best(queries["ids"], floor, k)
                walk(queries, data, best)
                at, nth = np.nonzero((best.score > LOWEST) & (best.score >= floor[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number.as_py())), pa.array(at), pa.array(queries["ids"][at]), pa.array(best.id[at, nth]), pa.array(best.score[at, nth])], names=["group", "at", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "group long, at long, query_id long, vec_id long, score long")


def _top_of(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query and more, for vectors of one length."""
    fits = max(LEAF, min(ROWS, VALUE // (8 * dim)))
    first = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(min(SAMPLE, 2 * fits)).select("vec_id", "x").toArrow().combine_chunks()
    sample, ids = _matrix(first.column("x").combine_chunks(), dim), first.column("vec_id").to_numpy()
    tree = build(sample)
    n, many = rows.count(), asked.count()
    block = int(min(fits, max(LEAST_ROWS, -(-n // LEAST_BLOCKS))))
    group = int(min(fits, max(LEAST_QUERIES, -(-many // LEAST_GROUPS))))
    order = ["cell", "away", "vec_id"]
    blocks = stage(_packed(ranked(_placed(rows, dim, sample, tree), ["dim"], order, "place"), dim, "block", block), "blocks")
    groups = stage(_packed(ranked(_placed(asked, dim, sample, tree), ["dim"], order, "place"), dim, "group", group, k, (sample, ids)), "groups")
    chunks = -(-n // (block * CHUNK))

    def pairs(groups: DataFrame) -> DataFrame:
        mine = groups.select("group", "centre", "radius", "length", "worst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
        others = blocks.select(F.expr(f"block div {CHUNK}").alias("chunk"), "block", *(F.col(c).alias(f"of_{c}") for c in ("centre", "radius", "length")))
        return mine.join(others.hint("merge"), "chunk").withColumn("bound", _bound()).filter("bound >= worst").select("group", "block", "chunk", "bound")

    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("bound"), "block"))
    seeds = stage(pairs(groups).withColumn("nth", nth).filter(F.col("nth") <= SEEDS).drop("nth"), "pairs")
    groups = groups.withColumn("floors", F.lit(None).cast("array<long>"))
    found = stage(_search(seeds, groups, blocks, chunks, k), "found")
    #: A query's k-th score so far, of SEEDS * k at most; a group's are one array, in the order of its queries.
    floors = found.groupBy("group", "at").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("group", "at", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(LOWEST)).alias("floor"))
    floors = floors.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("at", "floor"))).alias("f"))
    known = F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda i: F.coalesce(F.try_element_at(F.map_from_entries("f"), i.cast("long")), F.lit(LOWEST)))
    floors = floors.select("group", known.alias("floors"))
    groups = stage(groups.drop("floors").join(floors.hint("merge"), "group", "left").transform(_raised), "groups")
    rest = stage(pairs(groups).join(seeds.select("group", "block").hint("merge"), ["group", "block"], "left_anti"), "pairs")
    return found.unionByName(_search(rest, groups, blocks, chunks, k)).select("query_id", "vec_id", "score")


def _raised(groups: DataFrame) -> DataFrame:
    """groups whose `worst` has learned from `floors`, cut to the group's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, worst = [], []
            for value, given, before in zip(batch.column(5), batch.column(6), batch.column(4), strict=True):
                own = pickle.loads(value.as_py())["floor"]
                floor = np.maximum(own, np.array(given.as_py(), np.int64)[: len(own)]) if given.is_valid else own
                floors.append(floor.tolist())
                worst.append(max(before.as_py(), float(floor.min())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(worst, pa.float64()), batch.column(5), pa.array(floors, pa.list_(pa.int64()))], names=batch.schema.names)

    return groups.mapInArrow(run, groups.schema)


def top_k(table: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id of table (vec_id, embedding) with is_query the k best of the other rows."""
    spark = table.sparkSession
    bounded_batches(spark)
    rows = stage(integers(table), "integers")
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    asked = stage(asked, "asked")
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for d in (r["dim"] for r in asked.filter("dim > 0").select("dim").distinct().collect()):
        found = found.unionByName(_top_of(rows.filter(F.col("dim") == d), asked.filter(F.col("dim") == d), d, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
