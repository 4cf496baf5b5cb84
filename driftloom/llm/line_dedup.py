"""Line dedup by sharded minimal perfect hashes.

Line keys (the line stripped of [\\x20\\x09-\\x0D], A-Z lower-cased) are hashed to 128 bits. One aggregation
counts the documents that hold each key; keys of at least two rows (no other can be found again) are dealt by hash into shards of
about SHARD_KEYS keys, and each shard becomes a minimal perfect hash, placed by all 128 bits, that indexes arrays of
fingerprints (64 bits), saturated counts and keepers (the largest doc_id, as an offset), each in the narrowest type that holds
it: 8 + 1 + 1 to 8 bytes and 2 bits a key. Documents probe the arrays, and a line goes if its count reaches `min_docs`:

* an index of at most `index_bytes` is broadcast and every text is cleaned where it is read, without a shuffle;
* a larger one stays in its table, each document's distinct line hashes travel to the shards (by as many salts as a shard's counted load asks
  for), are probed as a stream behind their shard, and only the lines to drop travel back.

Defined cases: null or empty text is one empty line and returns as ''. Rows that share a doc_id count as one document (a null
doc_id too, which is below every other); rows that share the largest doc_id all keep the line. Keys are named by
128 bits of hash; a key that isn't in the index passes for one that is with a probability of 2^-64. Other columns pass through; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, binary, mix, over_batches, replaced, spare, stage, text_hash

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard; bytes of an index that may be broadcast; probes of a shard that meet in one task.
SHARD_KEYS, INDEX_BYTES, PROBES = 1 << 16, 32 << 20, 1 << 22
#: Counts are told apart up to this or min_docs.
SATURATED = 255
#: A null doc_id.
LOWEST = -(2**63)


def keyed(data: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines; the places and the 16-byte hashes of those whose keys are long enough."""
    lines = data.split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACES).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, at, digests


def pairs_of(digests: list[bytes]) -> np.ndarray:
    """n x 2 unsigned: fingerprint, hash."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, fp, n (documents that hold the key: distinct doc_ids, null as one), rows (that hold it), keeper (largest doc_id)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests = [], []
        for doc, data in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
            got = set(keyed(data, min_chars)[2])
            digests += got
            ids += [LOWEST if doc is None else doc] * len(got)
        p = pairs_of(digests).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 1]), pa.array(p[:, 0]), pa.array(ids, pa.int64())], names=["h", "fp", "doc"])

    rows = over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "h long, fp long, doc long")
    return rows.groupBy("h", "fp").agg(F.count_distinct("doc").alias("n"), F.count("*").alias("rows"), F.max("doc").alias("keeper"))


def places(h: np.ndarray, fp: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level has keys: from all 128 bits, so that different keys part at some level."""
    return (mix(h ^ mix(fp, 2 * level + 1), 2 * level) % np.uint64(size)).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the smallest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


class Shard:
    """A minimal perfect hash in levels of bit arrays (a key sits in the first level where nobody shares its place),
    over arrays of fingerprints, counts and keepers."""

    def __init__(self, h: np.ndarray, fp: np.ndarray, n: np.ndarray, keeper: np.ndarray, most: int = SATURATED):
        left, self.bits, order = np.arange(len(h)), [], []
        while len(left):
            size = max(64, int(1.5 * len(left)))
            place = places(h[left], fp[left], len(self.bits), size)
            alone = np.bincount(place, minlength=size) == 1
            here = alone[place]
            self.bits.append(alone)
            got = left[here]
            order.append(got[np.argsort(place[here], kind="stable")])
            left = left[~here]
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.least = int(keeper.min()) if len(keeper) else 0
        self.fp, self.n = fp[order], narrow(np.minimum(n[order], most))
        self.keeper = narrow(keeper[order].view(np.uint64) - np.int64(self.least).view(np.uint64))
        self.rank()

    def rank(self) -> None:
        self.starts, self.ranks, seen = [], [], 0
        for b in self.bits:
            self.ranks.append(np.cumsum(b, dtype=np.int32) - 1)
            self.starts.append(seen)
            seen += int(b.sum())

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array([len(b) for b in self.bits], np.int64), least=np.array([self.least]), fp=self.fp, n=self.n, keeper=self.keeper, **{f"b{i}": np.packbits(b) for i, b in enumerate(self.bits)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        got, self = np.load(io.BytesIO(blob)), cls.__new__(cls)
        self.bits = [np.unpackbits(got[f"b{i}"], count=int(n)).astype(bool) for i, n in enumerate(got["sizes"])]
        self.fp, self.n, self.keeper, self.least = got["fp"], got["n"], got["keeper"], int(got["least"][0])
        self.rank()
        return self

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key: documents that hold it, as far as counts are told apart (0: not in the index), keeper."""
        slot, open_ = np.full(len(h), -1), np.arange(len(h))
        for i, b in enumerate(self.bits):
            place = places(h[open_], fp[open_], i, len(b))
            here = b[place]
            slot[open_[here]] = self.starts[i] + self.ranks[i][place[here]]
            open_ = open_[~here]
        n, keeper, ok = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), slot >= 0
        ok[ok] = self.fp[slot[ok]] == fp[ok]
        n[ok] = self.n[slot[ok]]
        keeper[ok] = (self.keeper[slot[ok]].astype(np.uint64) + np.int64(self.least).view(np.uint64)).view(np.int64)
        return n, keeper


def line_index(counts: DataFrame, most: int = SATURATED) -> tuple[DataFrame, int, int, list[int]]:
    """A table (shard, blob) of the keys of at least two rows, the number of shards, the bytes, and each shard's salts: tasks that its probes need."""
    seen = Observation()
    counts = stage(counts.observe(seen, F.coalesce(F.sum("rows"), F.lit(0)).alias("probes")).filter("rows > 1"), "lines")
    probes = seen.get["probes"]
    shards = max(1, -(-counts.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        col = lambda k: table.column(k).to_numpy()
        blob = Shard(col("h").view(np.uint64), col("fp").view(np.uint64), col("n"), col("keeper"), most).dump()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "n": pa.array([int(col("rows").sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})

    index = stage(counts.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, n long, blob binary"), "line-index")
    loads = {r["shard"]: r["n"] for r in index.select("shard", "n").collect()}  # a number for each SHARD_KEYS keys
    others = (probes - sum(loads.values())) // shards  # keys of one document spread by their hash
    salts = [1 + (loads.get(k, 0) + others) // PROBES for k in range(shards)]
    return index, shards, int(index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("b")).first()["b"]), salts


def signed_mod(h: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(h.view(np.int64), np.int64(shards))


def cleaned(batch: pa.RecordBatch, dropped: list[set[int]], names: list[str]) -> pa.RecordBatch:
    """The batch with its text cut and its counts, as columns `names`."""
    texts, n_lines, n_dropped = [], [], []
    for data, gone in zip(binary(batch.column("text")), dropped, strict=True):
        lines = data.split(b"\n")
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else data)
    new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with the repeated lines cut from text, and n_lines, n_dropped."""
    index, shards, size, salts = line_index(line_counts(docs, min_chars), max(SATURATED, min_docs))
    schema = replaced(docs, n_lines=T.LongType(), n_dropped=T.LongType())
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name.lower() == "text" else f for f in schema])
    keep = docs.select(*(c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")))
    if size <= index_bytes:
        return probed_by_broadcast(keep, schema, index, shards, min_chars, min_docs)
    return probed_by_shuffle(keep, schema, index, salts, min_chars, min_docs)


def probed_by_broadcast(docs: DataFrame, schema: T.StructType, index: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.collect()})  # at most index_bytes
    loaded: dict[int, Shard] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, places, digests = [], [], []
        for i, data in enumerate(binary(batch.column("text"))):
            _, at, got = keyed(data, min_chars)
            owner += [i] * len(at)
            places += at
            digests += got
        dropped: list[set[int]] = [set() for _ in range(batch.num_rows)]
        if digests:
            p = pairs_of(digests)
            fp, h = p[:, 0].copy(), p[:, 1].copy()
            ids = np.array([LOWEST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            to = signed_mod(h, shards)
            order = np.argsort(to, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                k = int(to[mine[0]])
                if k not in sent.value:
                    continue
                if k not in loaded:
                    loaded[k] = Shard.load(sent.value[k])
                n, keeper = loaded[k].probe(h[mine], fp[mine])
                for j in mine[(n >= max(1, min_docs)) & (keeper != ids[np.array(owner)[mine]])]:
                    dropped[owner[j]].add(places[j])
        return cleaned(batch, dropped, schema.names)

    return over_batches(docs, run, schema)


def probed_by_shuffle(docs: DataFrame, schema: T.StructType, index: DataFrame, salts: list[int], min_chars: int, min_docs: int) -> DataFrame:
    th, gone, k_doc, k_th = spare(docs, "th", "gone", "k_doc", "k_th")
    of, names = np.array(salts, np.int64), ["shard", "salt", "h", "fp", "doc", "th", "lines"]

    def probes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, ths = {}, [], []
        for k, (doc, t, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True)):
            ids.append(LOWEST if doc is None else doc)
            ths.append(t)
            for i, key in zip(*keyed(data, min_chars)[1:], strict=True):
                rows.setdefault((k, key), []).append(i)
        p, owner = pairs_of([key for _, key in rows]), np.array([k for k, _ in rows], np.int64)
        h, ids, ths = p[:, 1].copy(), np.array(ids, np.int64)[owner], np.array(ths, np.int64)[owner]
        shard = signed_mod(h, len(of))
        salt = (mix(ids.view(np.uint64) ^ ths.view(np.uint64), 9) % of[shard].astype(np.uint64)).astype(np.int64)
        ends = np.cumsum([0, *map(len, rows.values())])
        lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([i for v in rows.values() for i in v], pa.int32()))
        return pa.RecordBatch.from_arrays([*map(pa.array, (shard, salt, h.view(np.int64), p[:, 0].copy().view(np.int64), ids, ths)), lines], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), text_hash("text"), "text")
    probes = over_batches(rows, probes_of, "shard long, salt long, h long, fp long, doc long, th long, lines array<int>").withColumn("blob", F.lit(None).cast("binary"))
    times = docs.sparkSession.createDataFrame(list(enumerate(salts)), "shard long, salts long")
    blobs = index.join(times, "shard").select("shard", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), *(F.lit(None).cast("array<int>" if c == "lines" else "long").alias(c) for c in names[2:]), "blob")

    def probe(batches):
        shard, now = None, None
        for batch in batches:
            blob_at = [i for i, x in enumerate(batch.column("blob").is_valid().to_pylist()) if x]
            for a, b in zip([0, *blob_at], [*blob_at, batch.num_rows], strict=True):  # a blob row opens its shard
                part = batch.slice(a, b - a)
                if part.num_rows and part.column("blob")[0].is_valid:
                    shard, now = part.column("shard")[0].as_py(), Shard.load(part.column("blob")[0].as_py())
                    part = part.slice(1)
                part = part.filter(pc.equal(part.column("shard"), shard)) if now else part.slice(0, 0)
                if part.num_rows:
                    col = lambda k, part=part: part.column(k).to_numpy(zero_copy_only=False)
                    n, keeper = now.probe(col("h").view(np.uint64), col("fp").view(np.uint64))
                    yield part.filter(pa.array((n >= max(1, min_docs)) & (keeper != col("doc")))).select(["doc", "th", "lines"])

    merged = probes.unionByName(blobs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    drops = merged.mapInArrow(probe, "doc long, th long, lines array<int>").groupBy(F.col("doc").alias(k_doc), F.col("th").alias(k_th)).agg(F.flatten(F.collect_list("lines")).alias(gone))
    joined = docs.withColumn(th, text_hash("text")).join(drops, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)) == F.col(k_doc)) & (F.col(th) == F.col(k_th)), "left").drop(k_doc, k_th, th)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return cleaned(batch, [set(x or ()) for x in batch.column(gone).to_pylist()], schema.names)

    return over_batches(joined, run, schema)
