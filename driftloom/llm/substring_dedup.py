"""Substring dedup by prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words of one document; every word covered by a window whose words also start anywhere else goes.

Which suffixes can matter: each window elects its ANCHOR-word n-gram of smallest hash, so equal windows elect equal n-grams at equal
offsets. Counting elected n-grams over all documents leaves those that occur twice; a bounded bit set of them (it only ever lets too many
pass) picks the places where suffixes start. A place carries its context: the words from which and to which a window over it can reach.

Partition by prefix: places are grouped by their n-gram, a prefix of ANCHOR words. Where the counted group of a prefix outgrows a step of
GROUPS, longer prefixes split it: the windows over a place are parted by how many words they reach back (lo to hi), and all of a part share
the words from lo before the place to WINDOW - hi after its start, 22, 29 or at last all WINDOW words, which become the part's prefix. So
a group has at most GROUPS[-1] different contexts, or, with whole windows as prefixes, WINDOW - ANCHOR + 1.

Contexts that a task meets twice are repeated as they are: their places are marked there and then, and only the context travels, so a passage
that very many documents share sends one row for each task, not its places. The same is done to groups that fill batches.

Subtrees: in each group the contexts' suffixes from the anchor on are sorted, neighbours' common prefix lengths make the suffix tree (a node
of depth d is a run of neighbours that share d words), and the same is done with the words before the anchor, read backwards. A window
that reaches a words back and WINDOW - a on is repeated if two places meet in the node of depth a and in the node of depth WINDOW - a.
Those deep nodes' windows are marked at all their places.

Defined cases: null text has no words; texts of fewer words than a window lose nothing; repeated rows repeat each other's windows; windows are
judged on the input. Kept words are joined by one space. Words are compared themselves, places are named by (doc_id, hash of the text).
Columns named n_words or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import Bloom, bloom_of, has
from .common import binary, bounded_batches, mix, over_batches, replaced, spare, stage
from .shingles import WordCodes, window_hashes

WINDOW, ANCHOR = 35, 8
#: Contexts of a group that its prefixes may have, step by step; rows that a task takes up at once; bytes of contexts that are collected before they go.
GROUPS, ROWS, CONTEXTS = (1 << 14, 1 << 16, 1 << 17), 1 << 13, 16 << 20
#: Contexts, or marked places of a text, whose words are looked at together.
AT_ONCE = 1 << 11
BACK = WINDOW - ANCHOR
LOWEST = -(2**63)


def parted(size: int) -> list[tuple[int, int]]:
    """The numbers of words that windows reach back, 0 to BACK, in parts of `size`."""
    return [(lo, min(lo + size - 1, BACK)) for lo in range(0, BACK + 1, size)]


#: Parts for each step: one, two, four, and every window on its own.
PARTS = [parted(BACK + 1), parted((BACK + 1) // 2), parted((BACK + 1) // 4), parted(1)]
#: Bits of the words that go when a context with so many words before and from its anchor on is repeated as it is.
WHOLE = np.zeros((BACK + 1, WINDOW + 1), np.uint64)
for _back in range(BACK + 1):
    for _ahead in range(WINDOW + 1):
        for _a in range(max(0, WINDOW - _ahead), _back + 1):
            WHOLE[_back, _ahead] |= np.uint64(((1 << WINDOW) - 1) << (BACK - _a))


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that some window elects, in ascending order, and their n-grams' hashes."""
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(codes, ANCHOR)
    bits = np.uint64((1 << 32) - 1)  # as many in every text, so that equal windows elect equal places
    low = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)  # the place takes the low bits, so ties go to the first
    reach = 1
    while 2 * reach <= BACK + 1:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if rest := BACK + 1 - reach:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & bits).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # elected places ascend with the window
    return at, grams[at]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("kid"), F.xxhash64("text").alias("th"), "text")


def context_hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each place's context, from prefix sums of codes times powers of an odd number (which has an inverse)."""
    with np.errstate(over="ignore"):
        odd, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), odd)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:-1])])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]))
        start, end = np.maximum(at - BACK, 0), np.minimum(at + WINDOW, len(codes))
        return (sums[end] - sums[start]) * back[start] + mix(start + BACK - at, 3)


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(gram, n, contexts) of the elected n-grams with at least two places: places, and contexts counted once for each batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, found = WordCodes(), [np.zeros((2, 0), np.uint64)]
        for data in binary(batch.column(0)):
            own = codes.of(data.split())
            at, grams = anchors(own)
            if len(at):
                found.append(np.stack([grams, context_hashes(own, at)]))
        both = np.concatenate(found, axis=1)
        both = both[:, np.lexsort(both[::-1])]
        first = np.concatenate([[True], both[0, 1:] != both[0, :-1]])[: both.shape[1]]
        starts = np.flatnonzero(first)
        new = first | np.concatenate([[True], both[1, 1:] != both[1, :-1]])[: both.shape[1]]
        n = np.diff(np.append(starts, both.shape[1]))
        contexts = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else n
        return pa.RecordBatch.from_arrays([pa.array(both[0, starts].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(contexts.astype(np.int64))], names=["gram", "n", "contexts"])

    rows = over_batches(docs.select("text"), run, "gram long, n long, contexts long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("contexts").alias("contexts")).filter("n > 1")


def places(docs: DataFrame, shared: Bloom, steps: list[Bloom]) -> DataFrame:
    """Two kinds of rows. (key, back, context, weight, kid, th, at): a context once for each CONTEXTS bytes, with its place, or with weight 2 and
    without; and (kid, th, at, words) of places whose context came twice: the words that go. The latter have a key by document."""
    sent = docs.sparkSession.sparkContext.broadcast((shared, steps))

    def packed(rows: dict) -> pa.RecordBatch:
        keys, held = list(rows), list(rows.values())
        twice = np.fromiter((len(h) > 3 for h in held), bool, len(held))
        own = np.array([h[:3] for h in held], np.int64).reshape(-1, 3)
        none = pa.nulls(len(keys), pa.int64())
        cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), pa.array(np.where(twice, 2, 1).astype(np.int32))]
        cols += [pa.array(own[:, i], mask=twice) for i in range(3)] + [none]
        context = pa.RecordBatch.from_arrays(cols, names=names)
        at = np.flatnonzero(twice)
        if not len(at):
            return context
        marks = np.array([x for i in at for x in held[i]], np.int64).reshape(-1, 3)
        bits = np.array([WHOLE[keys[i][1], keys[i][2].count(b" ") + 1 - keys[i][1]] for i in at], np.uint64).repeat([len(held[i]) // 3 for i in at])
        n = len(marks)
        cols = [pa.array(marks[:, 0] ^ marks[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int32)), *(pa.array(marks[:, i]) for i in range(3)), pa.array(bits.view(np.int64))]
        return pa.Table.from_batches([context, pa.RecordBatch.from_arrays(cols, names=names)]).combine_chunks().to_batches()[0]

    names = ["key", "back", "context", "weight", "kid", "th", "at", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, steps = sent.value
        codes, rows, size = WordCodes(), {}, 0
        for batch in batches:
            for kid, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
                words = data.split()
                own = codes.of(words)
                at, grams = anchors(own)
                keep = has(shared, grams)
                at, grams = at[keep], grams[keep]
                if not len(at):
                    continue
                step = np.zeros(len(at), np.int64)
                for k, s in enumerate(steps, 1):
                    step[has(s, grams)] = k
                plain, n = b" ".join(words), len(words)
                ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, n))
                begins = np.concatenate([[0], ends[:-1]])
                for k in np.unique(step):
                    for lo, hi in PARTS[k]:
                        p = at[(step == k) & (at >= lo) & (at + WINDOW - hi <= n)]
                        if not len(p):
                            continue
                        key = window_hashes(own, lo + WINDOW - hi)[p - lo]
                        if k:
                            key = mix(key, 100 * int(k) + lo)
                        first, until = np.maximum(p - hi, 0), np.minimum(p + WINDOW - lo, n) - 1
                        for g, back, s, e, place in zip(key.view(np.int64).tolist(), (p - first).tolist(), begins[first].tolist(), (ends[until] - 1).tolist(), p.tolist(), strict=True):
                            context = plain[s:e]
                            if not (held := rows.setdefault((g, back, context), [])):
                                size += len(context)
                            held += (kid, th, place)
                if size > CONTEXTS:
                    yield packed(rows)
                    rows, size = {}, 0
        if rows:
            yield packed(rows)

    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "key long, back int, context binary, weight int, kid long, th long, at long, words long")


def tree_nodes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The suffix tree of the rows of words within their groups: n x (depth + 1) names of the node that a row passes at each depth."""
    rows = np.empty((len(words), words.shape[1] + 1), ">u4")
    rows[:, 0], rows[:, 1:] = group, words
    order = np.argsort(rows.view(f"S{rows.strides[0]}").ravel(), kind="stable")
    rows = rows[order]
    same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)  # the path to a depth is that of the row before
    nodes = np.zeros(rows.shape, np.int32)
    nodes[order[1:]] = np.cumsum(~same, axis=0, dtype=np.int32)
    return nodes


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def repeated_words(group: np.ndarray, back: np.ndarray, contexts: list[bytes], weight: np.ndarray) -> np.ndarray:
    """For each context a bit for each word from BACK before the anchor on: set if a repeated window covers it."""
    n, width, numbers = len(contexts), BACK + WINDOW, Numbers()
    long_ = np.fromiter((c.count(b" ") + 1 for c in contexts), np.int64, n)
    words = (2**32 - 1 - np.arange(n * width, dtype=np.int64)).astype(np.uint32).reshape(n, width)  # outside a text all words differ
    for k in range(0, n, AT_ONCE):
        size, row = long_[k : k + AT_ONCE], np.arange(k, min(k + AT_ONCE, n))
        flat = np.fromiter(map(numbers.__getitem__, b" ".join(contexts[k : k + AT_ONCE]).split(b" ")), np.uint32, size.sum())
        first = np.repeat(BACK - back[row] - np.cumsum(size) + size, size)
        words[np.repeat(row, size), np.arange(len(flat)) + first] = flat
    ahead = long_ - back
    right, left = tree_nodes(group, words[:, BACK:]), tree_nodes(group, words[:, BACK - 1 :: -1])
    out = np.zeros(n, np.uint64)
    for a in range(BACK + 1):
        ok = np.flatnonzero((back >= a) & (ahead >= WINDOW - a))
        if len(ok):
            _, node = np.unique(left[ok, a].astype(np.int64) * (n + 1) + right[ok, WINDOW - a], return_inverse=True)
            again = np.bincount(node, weights=weight[ok])[node] > 1
            out[ok[again]] |= np.uint64(((1 << WINDOW) - 1) << (BACK - a))
    return out


def covered(placed: DataFrame) -> DataFrame:
    """(kid, th, at, words): for each place the bits of words that go."""
    names = ["kid", "th", "at", "words"]

    def marked(table: pa.Table, bits: np.ndarray) -> pa.Table:
        """Marks of the rows that have a place and bits."""
        keep = (bits != 0) & table.column("at").is_valid().to_numpy()
        out = table.select(names[:3]).append_column("words", pa.array(bits.view(np.int64)))
        return out.filter(pa.array(keep))

    def judged(table: pa.Table) -> pa.Table:
        group = np.unique(table.column("key").to_numpy(), return_inverse=True)[1]
        weight = table.column("weight").to_numpy()
        return marked(table, repeated_words(group, table.column("back").to_numpy().astype(np.int64), table.column("context").to_pylist(), weight))

    def squeezed(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """A part of one group: each context once, and the marks of those that came twice."""
        back, context = table.column("back").to_numpy(), table.column("context").combine_chunks().dictionary_encode()
        context = context.combine_chunks() if isinstance(context, pa.ChunkedArray) else context
        _, first, of = np.unique(back.astype(np.int64) << 32 | context.indices.to_numpy().astype(np.int64), return_index=True, return_inverse=True)
        total = np.bincount(of, weights=table.column("weight").to_numpy())
        long_ = np.fromiter((c.count(b" ") + 1 for c in context.dictionary.to_pylist()), np.int64, len(context.dictionary))[context.indices.to_numpy()]
        twice = total[of] > 1
        marks = marked(table, np.where(twice, WHOLE[back, long_ - back], np.uint64(0)))
        once, gone = table.take(pa.array(first)), pa.array(total > 1)
        for k in names[:3]:
            at = once.schema.get_field_index(k)
            once = once.set_column(at, k, pc.if_else(gone, pa.scalar(None, pa.int64()), once.column(k)))
        return once.set_column(once.schema.get_field_index("weight"), "weight", pa.array(np.minimum(total, 2).astype(np.int32))), marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, ROWS
        for batch in batches:
            ready = batch.column("words").is_valid()
            yield batch.select(names).filter(ready)
            batch = batch.filter(pc.invert(ready))
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.concat_tables(held)
            key = table.column("key").to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])  # the last group may go on
            if last:
                yield from judged(table.slice(0, last)).to_batches()
                table = table.slice(last)
            if table.num_rows >= 4 * ROWS:  # a group that fills batches
                table, marks = squeezed(table)
                yield from marks.to_batches()
            held, rows = [table], table.num_rows
            limit = max(ROWS, 2 * rows)
        if rows:
            yield from judged(pa.concat_tables(held)).to_batches()

    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kid long, th long, at long, words long")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the kept words, n_words, n_removed and removed: array<array<int>> of [first, end) words."""
    counts = stage(anchor_counts(docs), "anchors")
    n = counts.agg(F.count("*").alias("n"), *(F.count_if(F.col("contexts") > g).alias(f"over_{g}") for g in GROUPS)).first()
    shared = bloom_of(counts, "gram", n["n"])
    steps = [bloom_of(counts.filter(F.col("contexts") > g), "gram", n[f"over_{g}"]) for g in GROUPS if n[f"over_{g}"]]
    bounded_batches(docs.sparkSession)
    kid, th, gone = spare(docs, "kid", "th", "gone")
    #: Equal rows mark the same places: one mark of each, so that what a text gathers is bounded by its words, however many rows it has.
    marks = covered(places(docs, shared, steps)).groupBy("kid", "th", "at").agg(F.bit_or("words").alias("words"))
    marks = marks.groupBy(F.col("kid").alias(kid), F.col("th").alias(th)).agg(F.collect_list(F.struct("at", "words")).alias(gone))
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "removed": T.ArrayType(T.ArrayType(T.IntegerType()))}
    schema = replaced(docs, **added)
    left = docs.select(*(f"`{x}`" for x in schema.names if x not in added), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias(kid), F.xxhash64("text").alias(th))
    joined = left.join(marks, [kid, th], "left").drop(kid, th)
    reach = np.arange(BACK + WINDOW, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, totals, removed, spans = [], [], [], []
        column = batch.column(gone)
        for i, data in enumerate(binary(batch.column("text"))):
            words = data.split()
            out = np.zeros(len(words) + 2, bool)  # with an end on either side
            if column[i].is_valid:
                got = column[i].values
                at, bits = got.field("at").to_numpy(), got.field("words").to_numpy().view(np.uint64)
                for k in range(0, len(at), AT_ONCE):
                    rows, cols = np.nonzero((bits[k : k + AT_ONCE, None] >> reach) & np.uint64(1))
                    out[at[k : k + AT_ONCE][rows] - BACK + cols + 1] = True
            edges = np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2).astype(np.int32)
            kept = words if not len(edges) else [w for w, x in zip(words, out[1:-1].tolist(), strict=True) if not x]
            texts.append(b" ".join(kept))
            totals.append(len(words))
            removed.append(len(words) - len(kept))
            spans.append(edges.tolist())
        new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.list_(pa.int32())))}
        return pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in schema.names], names=schema.names)

    return over_batches(joined, run, schema)
