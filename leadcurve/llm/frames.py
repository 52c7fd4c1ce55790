"""Staging and row identity for the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.session import stage

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEAST = "spark.sql.files.minPartitionNum"


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job run inside go when the job ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def read_in_parts(spark: SparkSession) -> Iterator[None]:
    """Tables read inside come in as many tasks as the session asks for, though their files are small."""
    before = spark.conf.get(_LEAST, None)
    spark.conf.set(_LEAST, str(partitions(spark)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LEAST)
        else:
            spark.conf.set(_LEAST, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back; ``session.owned_stages`` around a job removes it."""
    with tidy(df.sparkSession):
        return stage(df, name)


def text_key(text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; equal rows may share it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def own_columns(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
