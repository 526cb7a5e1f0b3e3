"""The registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_wrappers, id_files, jaccard_join, mixing, pii, quality, sharding, tiff, token_counts
from .common import scratch, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in whole texts."""
    spans = pii.detect(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(F.array(*map(F.lit, pii.ALL_KINDS)), s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    n_secret = F.size(F.filter("added", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return spans.select(
        "doc_id", *map(_n_of, pii.KINDS), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(every).alias("spans"), F.size("added").cast("long").alias("n_added"), n_secret,
    )


def _n_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded, written as Huffman-coded files and read back."""
    path = scratch(spark, "id_files")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 2)
    return id_files.read_ids(spark, path, with_ids=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles overlap by 85 % of their union."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into 40 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights 5, 2, 1 takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole texts."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts stored as TIFF pages and read back from the stored bytes."""
    return tiff.media_digest(tiff.texts_to_tiff(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, be its numbers, names and units as they were or others."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_id_files": op2_id_files,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_quality": op7_quality,
    "op8_tiff": op8_tiff,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}
