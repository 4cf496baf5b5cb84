"""A bit set of bounded size over longs, built by a distributed OR: a filter that lets all members and a few others pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Most bits of a filter (8 MB): a set too large for it makes it pass more, nothing else.
MOST_BITS, PROBES = 1 << 26, 3


#: The bits, 64 a word, and how many they are: plain values, so that a broadcast needs no class on the other side.
Bloom = tuple[np.ndarray, int]


def has(members: Bloom, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be members."""
    words, bits = members
    out, keys = np.ones(len(keys), bool), np.asarray(keys).view(np.uint64)
    for k in range(PROBES):
        at = mix(keys, k + 1) & np.uint64(bits - 1)
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bloom_of(keys: DataFrame, column: str, count: int) -> Bloom:
    """keys' column (long, no nulls), of about `count` values; at most MOST_BITS / 64 words reach the driver."""
    bits = 1 << 10
    while bits < min(MOST_BITS, 12 * count):
        bits *= 2

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([mix(values, k + 1) & np.uint64(bits - 1) for k in range(PROBES)])
            at = np.unique(at)
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    rows = keys.select(F.col(column).cast("long")).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return words, bits
