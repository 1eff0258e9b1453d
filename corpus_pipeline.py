"""The corpus pipeline: each stage applies one corpus operator to all that the stage before it kept.

Language ID rejects documents without letters and those that the network takes for noise; exact and near
duplicates leave one document of each group; documents that hold a benchmark item go; what stays is packed.

Each stage passes on rows with null ids or texts as its operator defines it and works on empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from tarnfield.llm.common import crc32_of_id, fresh_path

#: A document goes if noise has a larger share of its positions.
MOST_NOISE = 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: with a letter, and with no more noise than MOST_NOISE. All, if no label was there to learn from."""
    net = language_id.fit(docs, F.coalesce(crc32_of_id("doc_id") % 5 != 0, F.lit(True)))
    if net is None:
        return docs
    own = {c: f"_own_{c}" for c in ("lang_pred", "score", "noise") if c in docs.columns}
    judged = language_id.identify(docs.withColumnsRenamed(own), net)
    judged = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("noise") <= MOST_NOISE)).drop("lang_pred", "score", "noise")
    return judged.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return near_dedup.keep_representatives(docs, width=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 ids, none of which crosses documents."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
