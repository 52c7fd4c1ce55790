"""Deterministic samples: the rows whose hashed key comes first.

The same rows are drawn on every run and any cluster, and no step passes the
data through one task: rows are counted per hash prefix, the running count tells
in which prefix a rank falls, and ranks are given inside one prefix at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.session import stage

PREFIX_DIGITS = 4  # at most 16^4 prefixes, so the count table is bounded


def _prefix_offsets(hashed: DataFrame) -> DataFrame:
    before = (
        Window.partitionBy(F.lit(0)).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hashed.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .select("_prefix", "_before")
    )


def hash_rank(
    df: DataFrame, hex_hash: Column, name: str, ties: Sequence[str] = (), first: int | None = None
) -> DataFrame:
    """Add the 1-based rank of each row in hash order; with ``first``, keep only that many."""
    hashed = df.withColumn("_hash", hex_hash).withColumn(
        "_prefix", F.substring("_hash", 1, PREFIX_DIGITS)
    )
    hashed = stage(hashed, "hashed")  # read for the counts and for the ranks
    offsets = F.broadcast(_prefix_offsets(hashed))  # at most 65,536 rows
    joined = hashed.join(offsets, "_prefix")
    if first is not None:
        joined = joined.filter(F.col("_before") < first)
    inside = Window.partitionBy("_prefix").orderBy("_hash", *ties)
    ranked = joined.withColumn(name, F.row_number().over(inside) + F.col("_before"))
    if first is not None:
        ranked = ranked.filter(F.col(name) <= first)
    return ranked.drop("_hash", "_prefix", "_before")


def hash_sample(df: DataFrame, hex_hash: Column, size: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``size`` rows that come first in hash order. Writes the hashed rows once."""
    return hash_rank(df, hex_hash, "_rank", ties, first=size).drop("_rank")
