"""Policy summaries, bootstrap intervals and the choice of the saving threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.operators.quantiles import ranked_quantiles
from leadcurve.operators.simulate import apply_threshold

# The probabilities of at most 0, 1, 2, ... draws at a mean of one; what lies beyond is below 1e-9.
POISSON_BOUNDS = tuple(accumulate(exp(-1) / factorial(k) for k in range(12)))

# policy -> (savings column, action column)
POLICIES = {
    "model": ("model_savings", "model_action"),
    "always_buy": ("always_buy_savings", "always_buy_action"),
    "always_wait": ("always_wait_savings", "always_wait_action"),
    "trailing_median_heuristic": ("heuristic_savings", "heuristic_action"),
    "random": ("random_savings", "random_action"),
    "oracle_reference": ("oracle_savings", "actual_best_action"),
}


def policy_rows(decisions: DataFrame) -> DataFrame:
    """One row per decision and policy."""
    rows = [
        F.struct(F.lit(name).alias("policy"), F.col(s).alias("savings"), F.col(a).alias("action"))
        for name, (s, a) in POLICIES.items()
    ]
    return decisions.select("decision_id", F.inline(F.array(*rows)))


def summarize(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten figures per group of rows with ``savings`` and ``action``.

    Equal savings are counted first; the groups are few and may be large, so ranks are
    found over ranges of amounts.
    """
    counted = rows.groupBy(*keys, "savings").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "WAIT").alias("waits")
    )
    saved, n = F.col("savings"), F.col("n")

    def having(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0)))

    figures = ranked_quantiles(
        counted,
        keys,
        "savings",
        "n",
        {"median_savings": 0.5, "savings_p05": 0.05},
        extra=[
            F.sum("n").alias("observations"),
            F.sum("waits").alias("waits"),
            F.sum(saved * n).alias("saved"),
            having(saved > 0).alias("wins"),
            having(saved == 0).alias("ties"),
            having(saved < 0).alias("losses"),
            F.sum(F.when(saved < 0, saved * n)).alias("lost"),
        ],
    )

    def share(column: str) -> Column:
        return F.col(column) / F.col("observations")

    return figures.select(
        *keys,
        "observations",
        share("waits").alias("wait_rate"),
        share("saved").alias("mean_savings"),
        "median_savings",
        share("wins").alias("win_rate"),
        share("ties").alias("tie_rate"),
        share("losses").alias("loss_rate"),
        F.coalesce(F.try_divide("lost", "losses"), F.lit(0.0)).alias("mean_loss_when_wrong"),
        "savings_p05",
    )


def policy_summary(decisions: DataFrame) -> DataFrame:
    return summarize(policy_rows(decisions), ["policy"])


DRAWS_PER_HASH = 4  # eight hex digits of an md5 for each


def _hash(seed: int) -> Column:
    """The hash of a decision from which ``DRAWS_PER_HASH`` neighbouring resamples draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("quartet").cast("string"), "decision_id"))


def _draws(digits: Column) -> Column:
    """How often a resample draws a decision: Poisson with mean one, fixed by its digits of the hash."""
    uniform = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    return F.aggregate(
        F.array(*[F.lit(b) for b in POISSON_BOUNDS]), F.lit(0), lambda n, b: n + F.when(b <= uniform, 1).otherwise(0)
    )


def bootstrap_intervals(
    decisions: DataFrame,
    columns: Mapping[str, str],
    samples: int = C.BOOTSTRAP_SAMPLES,
    seed: int = C.SEED,
) -> DataFrame:
    """95 % interval of the mean of each column, by resampling decisions.

    In each resample a decision counts as often as a Poisson draw says, which follows
    drawing with replacement. A draw is fixed by seed, resample and decision, and all
    columns share it; one hash serves four resamples. Sums are made where the decisions are: each task passes on one row
    per resample, and no decision is shuffled or joined.
    """
    wanted = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())]
    quartets = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS_PER_HASH)))
    hashed = decisions.select("decision_id", *wanted, quartets.alias("quartet")).withColumn("hash", _hash(seed))
    drawn = hashed.withColumn("nth", F.explode(F.array(*[F.lit(i) for i in range(DRAWS_PER_HASH)])))
    drawn = drawn.withColumn("resample", F.col("quartet") * DRAWS_PER_HASH + F.col("nth")).filter(F.col("resample") < samples)
    drawn = drawn.withColumn("weight", _draws(F.substring("hash", F.col("nth") * 8 + 1, F.lit(8))))
    sums = drawn.groupBy("resample").agg(
        F.sum("weight").alias("weight"), *[F.sum(F.col(f"v{i}") * F.col("weight")).alias(f"v{i}") for i in range(len(wanted))]
    )
    means = sums.filter("weight > 0")
    rows = [
        F.struct(F.lit(name).alias("policy"), (F.col(f"v{i}") / F.col("weight")).alias("mean"))
        for i, name in enumerate(columns)
    ]
    # one mean per resample and policy: a fixed, small number of rows
    return means.select(F.inline(F.array(*rows))).groupBy("policy").agg(
        F.percentile("mean", F.lit(0.025)).alias("mean_savings_ci95_low"),
        F.percentile("mean", F.lit(0.975)).alias("mean_savings_ci95_high"),
    )


def full_summary(
    decisions: DataFrame, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED
) -> DataFrame:
    """The eleven figures of every policy."""
    columns = {name: savings for name, (savings, _) in POLICIES.items()}
    intervals = bootstrap_intervals(decisions, columns, samples, seed)
    return policy_summary(decisions).join(intervals, "policy")


def threshold_search(
    decisions: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS
) -> DataFrame:
    """Mean saving, wait rate and 5th percentile of the model at each threshold, in one pass."""
    options = F.array(*[F.lit(float(t)) for t in thresholds])
    tried = apply_threshold(
        decisions.withColumn("threshold", F.explode(options)), F.col("threshold")
    )
    rows = tried.select(
        "threshold", F.col("model_savings").alias("savings"), F.col("model_action").alias("action")
    )
    return summarize(rows, ["threshold"]).select(
        "threshold", "mean_savings", "wait_rate", "savings_p05"
    )


def select_threshold(search: DataFrame, minimum_wait_rate: float = C.MINIMUM_WAIT_RATE) -> DataFrame:
    """The best threshold among those that wait often enough, or among all if none does."""
    everything = Window.partitionBy(F.lit(0))
    enough = F.col("wait_rate") >= minimum_wait_rate
    pool = search.withColumn("enough", enough).withColumn("any", F.max(enough).over(everything))
    ranked = pool.filter(F.col("enough") | ~F.col("any"))
    order = [F.desc("mean_savings"), F.desc("savings_p05"), F.asc("threshold")]
    return ranked.orderBy(*order).limit(1).select("threshold")
