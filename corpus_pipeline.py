"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Stages judge the documents that their predecessors kept;
texts that line dedup has cut go on as they are then. The labels of the quality classifier come from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import aside, read, stage
from driftloom.llm.jaccard_join import drop_near_copies
from driftloom.llm.line_dedup import dedup_lines
from driftloom.llm.mixing import mix_sources
from driftloom.llm.quality import fit_quality, score_quality
from driftloom.llm.queries import byte_bpe_50k


def _kept(step: Callable[[DataFrame], DataFrame], docs: DataFrame, *names: str, only: Column | None = None) -> DataFrame:
    """step(docs) with docs' columns and no others; columns of docs that are named like the step's own are put aside meanwhile."""
    rows, were = aside(docs, *names)
    rows = step(rows) if only is None else step(rows).filter(only)
    back = {old: new for new, old in were.items()}
    return rows.select(*(F.col(f"`{back.get(c, c)}`").alias(c) for c in docs.columns))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that a classifier fitted with these labels predicts to be good."""
    model = fit_quality(docs, labels)
    return _kept(lambda rows: score_quality(rows, model), docs, "score", "held_out", "predicted", only=F.col("predicted") == 1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat; n_chars follows the text."""

    def cut(rows: DataFrame) -> DataFrame:
        out = dedup_lines(rows)
        if "n_chars" in out.columns:
            kind = out.schema["n_chars"].dataType
            out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
        return out

    return _kept(cut, docs, "n_lines", "n_dropped")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether the ids decode to the very bytes of the text."""
    rows = byte_bpe_50k().round_trip(docs.select("doc_id", "source", "text"))
    exact = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("mixing", mixing),
    ("byte_bpe", tokens),
]

#: SQL can't train the classifier; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
