"""The training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.llm import line_dedup, minhash, packing, quality, substring_dedup
from leadcurve.llm.frames import staged


def _not_emptied(docs: DataFrame) -> DataFrame:
    """Documents that still hold a word: what a stage emptied stands in earlier documents, and goes."""
    return docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that a host repeats over many documents are cut from the others."""
    return quality.cleaned(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; documents without anything else go."""
    return _not_emptied(line_dedup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that an earlier document has are cut; documents without anything else go."""
    return _not_emptied(substring_dedup.without_repeats(docs))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of whole documents."""
    return packing.batches_of(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", length_packing),
]

# bucket bounds come from a dynamic program over the lengths, which SQL cannot express;
# tests/llm/test_pipeline.py compares the stages with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
