"""The operators bound to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, langid, licenses, line_dedup, mixing, packing, prefix_trie, quality_knn, quality_rules, simhash, token_store, vector_dedup
from .common import materialise, new_path
from .oracle import ORACLE_SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the folds of held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back."""
    path = new_path(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.token_digests(spark, path)


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four fifths of the ids."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.fit(docs, labels.where(remainder(5) != 0))
    scored = quality_knn.score(docs, model)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, sampling probability and draw of every document."""
    rows = mixing.annotate(documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens")
    rows = materialise(rows)
    drawn = mixing.sample(rows, mixing.calibrate(rows))
    return drawn.withColumn("probability", F.round("probability", 4))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated line runs."""
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "text", "n_lines", "n_deleted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that every document's text names, if any."""
    return licenses.scan(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir), radius=4, shingle=4)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_rules.judge(documents(spark, sf_dir))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*names)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def vocabulary() -> list[str]:
    """Pieces of the public 32k vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(remainder(4) != 2), vocabulary())
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every embedding."""
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, verdict and digest of every document's text."""
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two tokenizers, where they end together and how often over all documents."""
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    turns, conversations = prefix_trie.rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.build(turns, conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_quality_knn": op2_quality_knn,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "remainder", "vocabulary"]
