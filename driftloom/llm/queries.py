"""The registered queries opN_<name>: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import read, stage
from .conversation_repair import damaged, repaired_conversations
from .cover_tree import top_k
from .fingerprints import edited_fingerprints, likeness, packed
from .jaccard_join import jaccard_groups
from .line_dedup import dedup_lines
from .mixing import mix_plan
from .quality import fit_quality, score_quality
from .secret_scan import dictionary_of, scan_secrets, train
from .substring_dedup import substring_dedup
from .toxicity import fit_toxicity, score_toxicity
from .vector_dedup import vector_groups
from .whitening import whiten


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain).select("doc_id", "held_out", *chain.categories[:-1], "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(read(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan_secrets(docs, train(spark, known=dictionary_of(docs)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"), likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"))


def byte_bpe_50k() -> ByteBpe:
    """The public 50k vocabulary, from where it is installed."""
    import public_tokenizers

    return ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe_50k().round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("starts").alias("starts_hash"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repaired_conversations(stage(damaged(turns), "damaged"), turns)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
}
