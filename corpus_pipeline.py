"""The corpus pipeline: five stages over documents, each by one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again as the next one's documents. SQL can't express the stages (a trained network, token files), so tests
hold run() against a plain Python version instead of ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, id_files, jaccard_join, mixing, quality
from lodestone.llm.common import scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, 5, 80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, and the parts it takes."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in their file format and read back: a row per document of the mix."""
    path = scratch(spark, "corpus")
    id_files.write_ids(docs, path, "word_bpe_49k.json", 2)
    return id_files.read_ids(spark, path, with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to all documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage{k}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
