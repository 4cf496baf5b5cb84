"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (exact copies share a row, named by a hash of the set), columns are n-grams.
Two sets with Jaccard >= t must share a column among their first n - ceil(t n) + 1 in any common order of columns; the
order puts n-grams that very many rows hold last. Only that part of the matrix is shuffled, in blocks by column, and columns of a
single row go at once. Then:

* in columns of DENSE rows or more (of large groups of near copies, and those that unrelated sets share by chance) rows are compared by sketches, the
  parities of their n-grams over as many buckets as they have n-grams or more: sets differ in no fewer n-grams than their sketches in bits, so what
  sketches rule out can't link. What they leave open ties sets into clusters; unrelated sets are not chained, however many rows a column has. Columns
  that nearly the same rows hold are compared as one, long ones in tiles of SKETCHED n-grams. A cluster's full rows are parted by size, as sizes further apart than the threshold can't link, and dealt into tiles of TILE n-grams; pairs of tiles are
  blocks that a task multiplies in memory, row by row, discarding counts below the bound that the sizes ask for. First every
  tile meets itself and one of its part, which joins most of a group of near copies; then rows outside their part's largest group
  meet all tiles of their part and of its neighbours. A block emits only links that join something, fewer than it has rows;
* the other columns accumulate overlap counts for pairs of rows of different clusters; pairs whose count in the shared part
  cannot reach their bound are discarded, what passes is verified on the full rows.

Both are exhaustive: a linked pair shares a dense column, and so a cluster, or its count is complete without them; rows that don't meet are of
one group already. A part in which nothing links costs the square of its tiles, a dense column the square of its rows' sketches.

Defined cases: texts without words have the empty set and no links; fewer words than a shingle are one shingle; null doc_ids are
never a component's id unless it has no other; repeated rows are copies. Sets are told apart by 128 bits of hash, n-grams by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, has
from .common import binary, bounded_batches, hot_keys, over_batches, spare, spread_join, stage, text_hash, unstage
from .components import components
from .shingles import SHINGLE, WordCodes, shingle_set

PERCENT = 80
#: A chunk of rows counts its n-grams together; those that it holds so often are reported; so many of them are put last.
CHUNK, OFTEN, LAST = 1 << 21, 3, 1 << 17
#: Rows that make a column dense; n-grams of a tile (8 bytes each); partners of a row that meet in one task while pairs are verified.
DENSE, TILE, PARTNERS = 32, 1 << 19, 512
#: N-grams of a tile of sketches (an eighth to a quarter of a byte each), and what each of its rows counts besides its own.
SKETCHED, ROW = 1 << 25, 1 << 12


def set_names(shingles: np.ndarray) -> tuple[int, int]:
    """Two names of a set, signed 64-bit halves of one hash."""
    both = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return signed(both & (1 << 64) - 1), signed(both >> 64)


def set_name(shingles: np.ndarray, shared: frozenset[int]) -> int:
    """The first name, or where different sets share that, the second."""
    name, other = set_names(shingles)
    return other if name in shared else name


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def overlap_bound(a, b, percent: int):
    """Least overlap of sets of a and b members with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of a set's members over 2^k buckets, one for each member at least; the low bits of their hashes say which."""
    buckets = max(64, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set over fewer buckets."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def described(docs: DataFrame, size: int, *more: Column) -> DataFrame:
    """A staged table: (doc_id, n, sid, other, sketch, more long columns) of every document, and rows with kind 1 whose sid is an n-gram held n times by a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, total = WordCodes(), [], 0

        def often():
            values = np.concatenate(held)
            values.sort()
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
            counts, values = np.diff(np.append(starts, len(values))), values[starts]
            keep = counts >= OFTEN
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(counts[keep].astype(np.int64)), pa.array(values[keep].view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), *(pa.nulls(k, pa.int64()) for _ in extra)], names=names)

        names = ["kind", "doc_id", "n", "sid", "other", "sketch", *extra]
        for batch in batches:
            ns, sids, sketches = [], [], []
            for data in binary(batch.column(1)):
                s = shingle_set(data, codes, size)
                ns.append(len(s))
                sids.append(set_names(s))
                sketches.append(sketch(s) if len(s) else None)
                held.append(s)
                total += len(s)
                if total >= CHUNK:
                    yield often()
                    held, total = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int32)), batch.column(0), pa.array(ns, pa.int64()), *(pa.array([x[i] for x in sids], pa.int64()) for i in (0, 1)), pa.array(sketches, pa.binary()), *batch.columns[2:]], names=names)
        if held:
            yield often()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", *more)
    extra = rows.columns[2:]
    return stage(rows.mapInArrow(run, ", ".join(["kind int, doc_id long, n long, sid long, other long, sketch binary", *(f"{c} long" for c in extra)])), "sets")


def common_ngrams(rows: DataFrame) -> np.ndarray:
    """At most LAST n-grams in ascending order of their counts. They only steer the order of columns, the result is the same without."""
    top = rows.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * OFTEN).orderBy(F.desc("n"), "sid").limit(LAST)
    return top.orderBy("n", "sid").toArrow().column("sid").to_numpy().view(np.uint64)


def prefixes(docs: DataFrame, last: np.ndarray, size: int, percent: int, shared: frozenset[int]) -> DataFrame:
    """(gram, sid, n): the part of the incidence matrix that a linked pair must share a column of."""
    by_value = np.argsort(last)
    sent = docs.sparkSession.sparkContext.broadcast((last[by_value], by_value))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, ranks = sent.value
        codes, grams, sids, ns, seen = WordCodes(), [], [], [], set()
        for data in binary(batch.column(0)):
            s = shingle_set(data, codes, size)
            n, sid = len(s), set_name(s, shared)
            if not n or sid in seen:
                continue
            seen.add(sid)
            keep = n - (-(-percent * n // 100)) + 1
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                late = np.where(values[at] == s, ranks[at], -1)
                s = np.concatenate([s[late < 0], s[late >= 0][np.argsort(late[late >= 0])]])
            grams.append(s[:keep])
            sids.append(np.full(keep, sid, np.int64))
            ns.append(np.full(keep, n, np.int32))
        cat = lambda parts, kind: pa.array(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind))
        return pa.RecordBatch.from_arrays([cat(grams, np.int64), cat(sids, np.int64), cat(ns, np.int32)], names=["gram", "sid", "n"])

    return over_batches(docs.select("text"), run, "gram long, sid long, n int")


def shared_columns(part: DataFrame) -> DataFrame:
    """The rows of columns that at least two sets hold, each once: a streaming pass over blocks that are sorted by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            gram, sid = (batch.column(k).to_numpy() for k in ("gram", "sid"))
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])])  # not a repeated row
            first = np.concatenate([[True], gram[1:] != gram[:-1]])
            run_of = np.cumsum(first) - 1
            many = (np.bincount(run_of, weights=new) > 1)[run_of]
            end = int(np.flatnonzero(first)[-1])  # the last column may go on
            many[end:] = False
            if many.any():
                yield batch.filter(pa.array(many & new))
            rest = batch.slice(end).filter(pa.array(new[end:]))
            while rest.num_rows > 1 << 16:  # a column that fills batches: let it go but for two rows; these may come twice
                yield rest.slice(0, rest.num_rows - 1)
                rest = rest.slice(rest.num_rows - 2)
        if rest is not None and len(set(rest.column("sid").to_pylist())) > 1:
            sid = rest.column("sid").to_numpy()
            yield rest.filter(pa.array(np.concatenate([[True], sid[1:] != sid[:-1]])))

    dealt = part.repartition("gram").sortWithinPartitions("gram", "sid")
    return dealt.mapInArrow(run, "gram long, sid long, n int")


def sketch_links(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (positions in rows, which come by ascending size) that join rows where sketches leave a link open."""
    last = np.searchsorted(sizes, sizes * 100 // percent, "right")
    words, label, links = np.array([len(x) for x in sketches]), np.arange(len(sketches)), []
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        first = own[0]
        rows = np.stack([folded(x, w) for x in sketches[first : last[own[-1]]]])
        for r in own:
            at = r + 1 + np.flatnonzero(label[r + 1 : last[r]] != label[r])
            differ = np.bitwise_count(rows[at - first] ^ rows[r - first]).sum(axis=1, dtype=np.int64)
            at = at[differ <= sizes[r] + sizes[at] - 2 * overlap_bound(sizes[r], sizes[at], percent)]
            if len(at):
                others, one = np.unique(label[at], return_index=True)
                links += [(int(r), int(x)) for x in at[one]]
                label[np.isin(label, others)] = label[r]
    return links


def clusters_of(part: DataFrame, columns: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, cluster): what sketches tie together in dense columns (gram, block); columns of one block have nearly the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, sizes, sketches = None, [], [], []

        def done() -> pa.RecordBatch:
            links = sketch_links(np.array(sizes), sketches, percent) if len(sids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([sids[k[i]] for k in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("block", "i", "j", "n", "sid", "sketch")]
            for *key, n, sid, data in zip(*cols, strict=True):
                if key != now:
                    if len(sids) > 1:
                        yield done()
                    now, sids, sizes, sketches = key, [], [], []
                sids.append(sid)
                sizes.append(n)
                sketches.append(np.frombuffer(data, np.uint64))
        yield done()

    members = stage(part.join(columns, "gram").select("block", "sid", F.col("n").cast("long").alias("n")).distinct(), "met")
    blocks = stage(members.groupBy("block").agg(F.count("*").alias("n"), F.ceil(F.sum(F.col("n") + ROW) / SKETCHED).alias("tiles")), "blocks")
    routes = spread_join(members, blocks.select("block", "tiles"), "block", hot_keys(blocks, "block")).withColumn("tile", F.pmod(F.xxhash64("sid", F.lit("tile")), "tiles"))
    routes = routes.select("sid", "n", "block", "tile", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("other"))
    routes = routes.select("sid", "n", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    sketches = sets.filter("n > 0").groupBy("sid").agg(F.first("sketch").alias("sketch"))
    met = sketches.join(routes.hint("merge"), "sid").select("block", "i", "j", "n", "sid", "sketch")
    bounded_batches(part.sparkSession)
    open_ = met.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "sid").mapInArrow(run, "a long, b long")
    tied = components(open_).select(F.col("node").alias("sid"), F.col("label").alias("cluster"))
    unstage(members, blocks)
    return tied


def products(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, na, b, nb) for each shared column to the pairs whose count in the shared part can still reach their bound."""
    room = F.expr(f"na - ceil({percent} * na / 100) + 1"), F.expr(f"nb - ceil({percent} * nb / 100) + 1")
    pairs = pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("count"))
    #: Beyond the shared parts at most the smaller rest can be common: one part ends first, and after it only its own rest is left.
    most = F.col("count") + F.greatest(F.col("na") - room[0], F.col("nb") - room[1])
    bound = F.expr(f"ceil({percent} * (na + nb) / {100 + percent})")
    return pairs.filter((most >= bound) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b")


def full_rows(wanted: DataFrame, docs: DataFrame, names: DataFrame, size: int, shared: frozenset[int]) -> DataFrame:
    """(sid, n, row: the sorted n-grams as bytes) of the wanted sids and a few others, from the documents that name them; a bit set picks those."""
    ids = stage(names.join(wanted, "sid").select("doc_id", "sid"), "candidates")
    chosen = docs.sparkSession.sparkContext.broadcast(bloom_of(ids.select(F.xxhash64("doc_id").alias("k")), "k", ids.count()))

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(has(chosen.value, batch.column(0).to_numpy().astype(np.int64))))
        codes, sids, ns, sets, seen = WordCodes(), [], [], [], set()
        for data in binary(batch.column(1)):
            s = shingle_set(data, codes, size)
            if (sid := set_name(s, shared)) not in seen:
                seen.add(sid)
                sids.append(sid)
                ns.append(len(s))
                sets.append(s.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "n", "row"])

    rows = over_batches(docs.select(F.xxhash64(F.col("doc_id").cast("long")), "text"), full, "sid long, n long, row binary")
    return stage(rows, "rows")


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full rows link. A row travels once for each pair as b, as a once for each PARTNERS pairs."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    lead = spread.select(F.col("a").alias("sid"), "a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("b"))
    tail = pairs.join(spread, "a").select(F.col("b").alias("sid"), "a", F.pmod(F.xxhash64("b", F.lit("part")), "parts").alias("part"), "b")
    #: Rows and routes meet by a shuffle at every size.
    routed = rows.join(lead.unionByName(tail).hint("merge"), "sid").select("a", "part", "b", "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, None
        for batch in batches:
            out = []
            for a, b, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("row"), strict=True):
                got = np.frombuffer(data.as_buffer(), np.uint64)
                if b is None:
                    now, row = a, got.copy()
                elif a == now:
                    small, large = (got, row) if len(got) < len(row) else (row, got)
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * both >= percent * (len(got) + len(row) - both):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    #: Rows repeated by copies in other batches do no harm.
    return routed.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(compare, "a long, b long").distinct()


def block_product(rows: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions in rows) that join rows of different labels. What ends up in the largest group needn't be looked at row by row: any
    pair of different groups has a row outside of it."""
    sizes = np.array([len(r) for r in rows])
    grams, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(grams, kind="stable")
    ends = np.flatnonzero(np.concatenate([grams[order][1:] != grams[order][:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    column = np.empty(len(grams), np.int64)
    column[order] = np.repeat(np.arange(len(ends)), ends - starts)
    held, at = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    label, links, done = np.unique(labels, return_inverse=True)[1], [], np.zeros(len(rows), bool)
    while len(left := np.flatnonzero(~done & (label != np.bincount(label).argmax()))):
        r = left[0]
        done[r] = True
        c = column[at[r] : at[r + 1]]
        c = c[ends[c] - starts[c] > 1]
        width = ends[c] - starts[c]
        places = np.repeat(starts[c] - np.concatenate([[0], np.cumsum(width)[:-1]]) if len(c) else starts[:0], width) + np.arange(width.sum())
        counts = np.bincount(held[places], minlength=len(rows))
        linked = (100 * counts >= percent * (sizes + sizes[r] - counts)) & (label != label[r])
        for x in np.flatnonzero(linked):
            if label[x] != label[r]:
                links.append((int(r), int(x)))
                label[label == label[x]] = label[r]
    return links


def multiplied(routes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of blocks (i, j): routes (sid, label, i, j) say which rows meet in which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, labels, block = None, [], [], []

        def done() -> pa.RecordBatch:
            links = block_product(block, np.array(labels), percent) if len(block) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([sids[k[i]] for k in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("i", "j", "label", "sid")]
            for k, (i, j, label, sid) in enumerate(zip(*cols, strict=True)):
                if (i, j) != now:
                    yield done()
                    now, sids, labels, block = (i, j), [], [], []
                sids.append(sid)
                labels.append(label)
                block.append(np.frombuffer(batch.column("row")[k].as_buffer(), np.uint64).copy())
        yield done()

    met = rows.select("sid", "row").join(routes.hint("merge"), "sid").select("i", "j", "label", "sid", "row")
    return met.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long")


def cluster_links(clusters: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the clusters (sid, cluster) that join what was apart.

    Parts (gid) are clusters by size, in steps a little wider than the threshold's ratio: links are within a part or between neighbours."""
    step = math.log(100 / percent) * 1.001
    members = rows.select("sid", "n").distinct().join(clusters, "sid").withColumn("band", F.floor(F.log("n") / step))
    members = stage(members.withColumn("gid", F.xxhash64("cluster", "band")), "members")
    tiles = lambda n: F.ceil(n / TILE)
    parts = stage(members.groupBy("gid").agg(F.count("*").alias("n"), tiles(F.sum("n")).alias("tiles")), "parts")
    hot = hot_keys(parts, "gid")
    tile = F.pmod(F.xxhash64("sid", F.lit("tile")), "tiles")
    hub = spread_join(members, parts.select("gid", "tiles"), "gid", hot).withColumn("tile", tile)
    meets = F.when(F.col("tile") == 0, F.expr("sequence(0L, tiles - 1)")).otherwise(F.array("tile"))
    first = stage(multiplied(hub.select("sid", F.col("sid").alias("label"), F.col("gid").alias("i"), F.explode(meets).alias("j")), rows, percent), "links")

    found = components(first).withColumnRenamed("node", "sid")
    members = stage(members.join(found, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labelled")
    sums = members.groupBy("gid", "cluster", "band", "label").agg(F.sum("n").alias("n"))
    mains = sums.groupBy("gid", "cluster", "band").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    mains = stage(mains.select("gid", "cluster", "band", F.col("most.label").alias("main"), F.array(F.col("n") - F.col("most.n"), F.col("most.n")).alias("sizes"), tiles(F.col("n")).alias("whole")), "mains")
    halves = mains.select("gid", "cluster", "band", "main", "whole", F.posexplode("sizes").alias("kind", "n")).filter("n > 0").withColumn("tiles", tiles(F.col("n")))
    own, other = (halves.select(*(F.col(c).alias(f"{c}{k}") for c in halves.columns)) for k in ("", "_o"))
    near = (F.col("cluster") == F.col("cluster_o")) & (F.abs(F.col("band") - F.col("band_o")) <= 1)
    both = (F.col("kind") == 1) & (F.col("kind_o") == 1) & (F.col("main") == F.col("main_o"))
    settled = (F.col("gid") == F.col("gid_o")) & (F.col("whole") == 1)
    partners = own.join(other, near & ~both & ~settled).groupBy("gid", "kind", "tiles").agg(F.collect_list(F.struct("gid_o", "kind_o", "tiles_o")).alias("others"))  # 6 at most
    partners = stage(partners.select(F.xxhash64("gid", "kind").alias("half"), "tiles", "others"), "partners")
    if not partners.head(1):
        return edges_of(found).unionByName(first.limit(0))
    rest = spread_join(members, mains.select("gid", "main"), "gid", hot).withColumn("kind", (F.col("label") == F.col("main")).cast("int"))
    rest = stage(rest.select("sid", "label", "gid", "kind", F.xxhash64("gid", "kind").alias("half")), "halves")
    rest = spread_join(rest, partners, "half", hot_keys(rest.groupBy("half").agg(F.count("*").alias("n")), "half")).filter("others is not null")
    mine = F.xxhash64("gid", "kind", tile)
    rest = rest.select("sid", "label", mine.alias("mine"), F.inline("others"))
    rest = rest.select("sid", "label", "mine", "gid_o", "kind_o", F.explode(F.expr("sequence(0L, tiles_o - 1)")).alias("tile_o")).withColumn("theirs", F.xxhash64("gid_o", "kind_o", "tile_o"))
    rest = rest.select("sid", "label", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j")).distinct()
    return edges_of(found).unionByName(multiplied(rest, rows, percent))


def edges_of(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("sid").alias("a"), F.col("label").alias("b")).filter("a <> b")


def labelled_sets(docs: DataFrame, size: int, percent: int, *more: Column) -> tuple[DataFrame, DataFrame, list[int]]:
    """Staged tables: (doc_id, n, set, more) of every row of docs; (set, doc_id, copies, label) of each set that has words, with its least doc_id and
    its component's label; and the sets that very many rows have."""
    described_ = described(docs, size, *more)
    sets = described_.filter("kind = 0").drop("kind")

    def named(sets: DataFrame) -> DataFrame:
        return stage(sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("other").alias("low"), F.max("other").alias("high")), "names")

    names = named(sets)
    #: Different sets of one 64-bit name: of n sets about n^2 / 2^65.
    shared = frozenset(r["sid"] for r in names.filter("low <> high").select("sid").collect())
    if shared:
        sets = sets.withColumn("sid", F.when(F.col("sid").isin(*shared), F.col("other")).otherwise(F.col("sid")))
        names = named(sets)
    part = stage(shared_columns(prefixes(docs, common_ngrams(described_), size, percent, shared)), "columns")

    alike = F.xxhash64(*(F.min(F.xxhash64("sid", F.lit(k))) for k in range(3)))
    columns = part.groupBy("gram").agg(F.count("*").alias("rows"), alike.alias("block"))
    clusters = stage(clusters_of(part, columns.filter(F.col("rows") >= DENSE).drop("rows"), sets, percent), "clusters")
    sets = sets.drop("other", "sketch")

    sparse = part.join(columns.filter(F.col("rows") < DENSE).select("gram"), "gram", "left_semi").join(clusters, "sid", "left")
    left, right = (sparse.select("gram", *(F.col(c).alias(f"{k}{s}") for c, k in (("sid", ""), ("n", "n"), ("cluster", "c")))) for s in "ab")
    apart = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & ~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    pairs = stage(products(left.join(right, "gram").filter(apart).select("a", "na", "b", "nb"), percent), "pairs")

    unstage(part)

    wanted = clusters.select("sid").unionByName(pairs.select(F.col("a").alias("sid"))).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    rows = full_rows(wanted, docs, names, size, shared)
    labels = components(verified(pairs, rows, percent).unionByName(cluster_links(clusters, rows, percent)))
    unstage(rows)
    names = names.select(F.col("sid").alias("set"), "doc_id", F.col("n").alias("copies")).join(labels.hint("merge"), F.col("set") == F.col("node"), "left").drop("node")
    names = stage(names.withColumn("label", F.coalesce("label", "set")), "named")
    return sets.withColumnRenamed("sid", "set"), names, hot_keys(names.withColumnRenamed("copies", "n"), "set")


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    sets, names, hot = labelled_sets(docs, size, percent)
    ids = stage(names.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "ids")
    names = stage(spread_join(names.select("set", "label"), ids.select("label", "component_id"), "label", hot_keys(ids, "label")).select("set", "component_id"), "component-ids")
    rows = spread_join(sets.filter("n > 0"), names, "set", hot).unionByName(sets.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: of the least doc_id (null only where there is no other), then the least hash of the text.

    Rows are named by doc_id and text hash; where the chosen name repeats, one of its rows stays. Rows without words all stay."""
    th, d, t = spare(docs, "th", "d", "t")
    sets, names, hot = labelled_sets(docs, size, percent, text_hash("text").alias("text_hash"))
    keys = spread_join(sets.filter("n > 0"), names.select("set", "label"), "set", hot).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    keys = stage(keys, "keys")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    leads = stage(keys.groupBy("label").agg(F.min(name).alias("lead"), F.count("*").alias("n")), "leads")
    judged = spread_join(keys, leads.drop("n"), "label", hot_keys(leads, "label")).withColumn("kept", F.col("lead").eqNullSafe(name)).filter("not kept or copies > 1")
    judged = stage(judged.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), "kept"), "judged")
    repeated = stage(judged.filter("kept").drop("kept"), "repeated")

    #: Texts are shuffled of those rows only whose names a bit set of the judged ones lets pass; what it rules out is not among them.
    chosen = docs.sparkSession.sparkContext.broadcast(bloom_of(judged.select(F.xxhash64(d, t).alias("k")), "k", judged.count()))

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(has(chosen.value, keys.to_numpy(zero_copy_only=False)))

    bounded_batches(docs.sparkSession)
    rows = docs.withColumn(th, text_hash("text"))
    passes = may(F.xxhash64(F.col("doc_id").cast("long"), F.col(th)))
    others, rows = rows.filter(~passes).drop(th), rows.filter(passes)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = rows.join(repeated, same, "left_semi").groupBy("doc_id", th).agg(F.min_by(row, F.to_json(row)).alias(d)).select(f"{d}.*")
    return others.union(rows.join(judged.drop("kept"), same, "left_anti").drop(th)).union(once)
