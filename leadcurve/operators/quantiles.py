"""Exact weighted quantiles that hold no group in memory.

Callers first count equal values, so a hot group arrives as its distinct values.
``weighted_quantiles`` is for many groups of few distinct values: a running count over
the sorted values of a group marks the row that covers each rank. ``ranked_quantiles``
is for groups of any size: values are dealt to ranges, the sizes of a group's ranges tell
in which of them a rank falls, and only there values are counted on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.session import spread_by_range, stage


def weighted_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    quantiles: Mapping[str, float],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with the named quantiles (linear interpolation) of ``value``.

    ``counted`` holds how often each value occurs. Rows with a null value carry no
    weight but still count towards the ``extra`` aggregates.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(F.col(value).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    held = F.expr(f"CAST(IF(`{value}` IS NULL, 0, `{weight}`) AS BIGINT)")
    ranked = counted.withColumn("_held", held).withColumns(
        {"_end": F.sum("_held").over(upto), "_total": F.sum("_held").over(group)}
    )

    def at(rank: str) -> str:
        return f"max(CASE WHEN _end - _held <= {rank} AND {rank} < _end THEN `{value}` END)"

    aggregates, picks = [], []
    for name, p in quantiles.items():
        place = f"({float(p)!r}D * (_total - 1))"
        aggregates += [
            F.expr(f"{at(f'floor{place}')} AS _{name}_lo"),
            F.expr(f"{at(f'ceil{place}')} AS _{name}_hi"),
            F.expr(f"max({place} - floor{place}) AS _{name}_step"),
        ]
        picks.append(F.expr(f"_{name}_lo + (_{name}_hi - _{name}_lo) * _{name}_step AS {name}"))
    grouped = ranked.groupBy(*keys).agg(*aggregates, *extra)
    kept = [c for c in grouped.columns if not c.startswith("_")]
    return grouped.select(*kept, *picks)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs per key; nulls are left out."""
    present = df.filter(F.col(value).isNotNull())
    return present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _ranges(ordered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and range the weight of its values, told as one row per group: an array of at most one entry per range."""
    sizes = ordered.groupBy(*keys, "_range").agg(F.sum("_held").alias("_size"))
    size = F.struct(F.col("_range").alias("range"), F.col("_size").alias("size"))
    return sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(size)).alias("_sizes"), F.sum("_size").alias("_total"))


def _place(rank: Column) -> Column:
    """The range in which a rank falls, and the weight of the ranges before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("int").alias("range"), F.lit(0).cast("bigint").alias("skipped"))

    def step(state: Column, size: Column) -> Column:
        end = state["before"] + size["size"]
        here = state["range"].isNull() & (rank < end)
        return F.struct(
            end.alias("before"),
            F.when(here, size["range"]).otherwise(state["range"]).alias("range"),
            F.when(here, state["before"]).otherwise(state["skipped"]).alias("skipped"),
        )

    return F.aggregate("_sizes", start, step)


def ranked_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    quantiles: Mapping[str, float],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """As ``weighted_quantiles``, without a task or window that sees a whole group.

    Values are stored in ranges of key and value, so a group of a million distinct values
    spreads over the ranges. A group's ranks are found in its ranges' sizes; then the
    ranges that hold a rank, and no others, are ordered and counted.
    """
    keys = list(keys)
    held = F.expr(f"CAST(IF(`{value}` IS NULL, 0, `{weight}`) AS BIGINT)")
    dealt = spread_by_range(counted.withColumn("_held", held), *keys, value)
    placed = stage(dealt.withColumn("_range", F.spark_partition_id()), "value-ranges")
    present = placed.filter(F.col("_held") > 0)
    groups = _ranges(present, keys)
    wanted = []
    for name, p in quantiles.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        wanted += [
            F.struct(F.lit(f"{name} {end}").alias("pick"), rank.cast("bigint").alias("rank"), (at - F.floor(at)).alias("step"))
            for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at)))
        ]
    ranks = groups.select(*keys, "_sizes", F.inline(F.array(*wanted)))
    ranks = ranks.withColumn("_at", _place(F.col("rank"))).select(
        *keys, F.col("_at.range").alias("_range"), F.struct("pick", (F.col("rank") - F.col("_at.skipped")).alias("rank"), "step").alias("_rank")
    )
    # at most two ranks per quantile and range
    ranks = stage(ranks.groupBy(*keys, "_range").agg(F.collect_list("_rank").alias("_ranks")), "ranks")
    asked = ranks.select(*[F.col(c).alias(f"_asked_{c}") for c in keys], F.col("_range").alias("_asked_range"), "_ranks")
    same = F.col("_range") == F.col("_asked_range")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_asked_{c}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted_on = present.join(asked, same).withColumn("_end", F.sum("_held").over(inside))
    hit = F.filter("_ranks", lambda r: (r["rank"] < F.col("_end")) & (r["rank"] >= F.col("_end") - F.col("_held")))
    hits = counted_on.select(*keys, F.col(value).alias("_value"), F.explode(hit).alias("_hit"))

    def at(pick: str, column: Column) -> Column:
        return F.max(F.when(F.col("_hit.pick") == pick, column))

    def between(name: str) -> Column:
        low, high = at(f"{name} lo", F.col("_value")), at(f"{name} hi", F.col("_value"))
        return low + (high - low) * at(f"{name} lo", F.col("_hit.step"))

    found = hits.groupBy(*keys).agg(*[between(name).alias(name) for name in quantiles])
    if not extra and keys:
        return found
    # one row per group; groups without any value have no quantiles
    totals = placed.groupBy(*keys).agg(*(extra or [F.lit(1).alias("_one")]))
    both = totals.select("*", *[F.col(c).alias(f"_own_{c}") for c in keys]).drop(*keys)
    match = F.lit(True)
    for c in keys:
        match = match & F.col(f"_own_{c}").eqNullSafe(F.col(c))
    joined = both.join(found, match, "left").drop(*keys, "_one")
    return joined.withColumnsRenamed({f"_own_{c}": c for c in keys})


def equal_bins(counted: DataFrame, keys: Sequence[str], value: str, weight: str, bins: int) -> DataFrame:
    """At most ``bins`` bins per key with about equally many rows, from all values: ``low`` and ``high`` of each.

    A value goes where the middle of its rows falls, so one that fills two bins or more stands
    alone. ``values`` and ``rows`` are the key's. Rows with a null key are left out. As with
    ``ranked_quantiles``, no task or window sees the values of a whole key.
    """
    keys = list(keys)
    held = F.expr(f"CAST(IF(`{value}` IS NULL, 0, `{weight}`) AS BIGINT)")
    dealt = spread_by_range(counted.withColumn("_held", held).filter("_held > 0"), *keys, value)
    placed = stage(dealt.withColumn("_range", F.spark_partition_id()), "value-ranges")
    # one row per key and range
    sizes = placed.groupBy(*keys, "_range").agg(F.sum("_held").alias("_size"), F.count(F.lit(1)).alias("_distinct"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias("rows"),
        F.sum("_distinct").over(group).alias("values"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted_on = placed.join(ranges, [*keys, "_range"]).withColumn("_end", F.col("_before") + F.sum("_held").over(inside))
    binned = counted_on.withColumn("bin", F.expr(f"((2 * _end - _held) * {int(bins)}) div (2 * rows)"))
    return binned.groupBy(*keys, "rows", "values", "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def global_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """One row with the named quantiles over all rows, without a task that sees all values."""
    counted = value_counts(df, [], value).withColumn(value, F.col(value).cast("double"))
    return ranked_quantiles(counted, [], value, "n", quantiles)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    if not list(keys):
        return global_quantiles(df, value, quantiles)
    return weighted_quantiles(value_counts(df, keys, value), keys, value, "n", quantiles)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
