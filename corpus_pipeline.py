"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written
as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, line_dedup, mixing, packing, resemblance
from tessera.llm.common import discard, new_path
from tessera.llm.queries import remainder, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose likeliest language has less of the likelihood is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, and name it in ``lang``.

    The model is learned from three quarters of the labelled ids.  Rejected are null
    texts, texts without a letter and those whose likeliest language is unsure.
    """
    model = langid.fit(docs.where(remainder(4) != 2), vocabulary())
    named = langid.identify(docs.select(*COLUMNS), model)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents left without a word go."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    spent = (F.col("n_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.where(~F.coalesce(spent, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, keep the one with the smallest id.

    Linked are those whose five-word shingles have a Jaccard similarity of 0.8 or
    more, found by op6's SimHash index and, beyond its radius, by minimum hashes.  Rows with equal ids share a verdict.
    """
    grouped = resemblance.near_copies(docs)
    gone = grouped.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics get their target weights."""
    annotated = mixing.annotate(docs.select(*COLUMNS))
    cells = mixing.calibrate(annotated)
    return mixing.sample(annotated, cells).where("kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences of at most 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Models, fingerprints and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; stages meet in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(*before)  # the table that this stage has read
        docs = spark.read.parquet(path)
        before = [docs]
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
