"""A corpus from raw documents to packed sequences: five stages, each kept as Parquet for the next.

Near duplicates are taken on five-word shingles at a similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnvol.llm._common import documents, stage
from tarnvol.llm.exact import drop_exact
from tarnvol.llm.minhash import drop_near
from tarnvol.llm.packing import cut, pack
from tarnvol.llm.quality import drop_low_quality
from tarnvol.llm.substrings import cut_repeated_words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rule or a learned rule rejects go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the smallest doc_id stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies the smallest doc_id stays."""
    return drop_near(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passages of 35 words that occur again anywhere are cut out of the texts."""
    return cut_repeated_words(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left, tokenised and packed into sequences of 2048."""
    return pack(stage(cut(docs), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, suffix structures and tokenisation are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
