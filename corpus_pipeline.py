"""From raw documents to packed training sequences: five stages, each one operator of ``partlens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes a stage's rows to
shared storage before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partlens.llm import common, decontaminate, jaccard_join, language_id, packing, suffix_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told."""
    return language_id.recognised(spark, docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard_join.one_of_each(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that repeat across or within documents out of their texts."""
    return suffix_dedup.without_repeats(spark, docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate.clean(spark, docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences along a Hilbert curve."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(spark, docs, f"pipeline-{name}")
    return docs
