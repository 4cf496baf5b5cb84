"""Exclude patterns in any number: one automaton finds all that a text contains in one walk over it.

Few patterns stay an expression of the plan. More go to an Aho-Corasick automaton that each task builds from a broadcast list; a list beyond BYTES is parted by hash, each part is a pass of its own, so
that no broadcast grows with the patterns. Case doesn't count, empty and null patterns match nothing, a null text contains nothing."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import excluded
from .tables import cut

#: Patterns that an expression tests one by one; bytes of patterns that a broadcast may hold.
FEW, BYTES = 32, 8 << 20


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        found.add_word(p, k)
    found.make_automaton()
    return found


def contained(rows: DataFrame, key: str, column: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern) for each row and each distinct pattern (pattern, lower-cased) that its column contains."""
    wanted = cut(patterns.select(F.lower("pattern").alias("pattern")).filter("pattern <> ''").distinct(), "patterns")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("pattern") + 8), F.lit(0)).alias("n")).first()["n"]
    schema = T.StructType([rows.schema[key], T.StructField("pattern", T.StringType())])
    parts, out = max(1, -(-size // BYTES)), None
    for part in range(parts):
        own = [r["pattern"] for r in wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()]
        found = _walked(rows, key, column, own, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _walked(rows: DataFrame, key: str, column: str, patterns: list[str], schema: T.StructType) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        machine = _automaton(names) if names else None
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and machine is not None:
                    own = {k for _, k in machine.iter(text.lower())}
                    at += [i] * len(own)
                    hits += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([names[k] for k in hits], pa.string())], names=[key, "pattern"])

    return rows.select(key, column).mapInArrow(run, schema)


def flagged(rows: DataFrame, column: str, patterns: list[str], name: str) -> DataFrame:
    """rows with `name`: whether the column contains one of the patterns."""
    some = sorted({p.lower() for p in patterns if p})
    if len(some) <= FEW:
        return rows.withColumn(name, excluded(F.col(column), some))
    if sum(len(p.encode()) + 8 for p in some) > BYTES:
        raise ValueError(f"more than {BYTES} bytes of patterns: pass them as a table to contained()")
    sent, schema = rows.sparkSession.sparkContext.broadcast(some), T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])
    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent.value)
        for batch in batches:
            hit = [text is not None and next(machine.iter(text.lower()), None) is not None for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
