"""Scorers: anything that adds ``predicted_relative`` to feature rows.

A scorer is a function from DataFrame to DataFrame: a fitted Spark ML pipeline, or a
closed formula over the feature columns. A formula can also be worked out for a whole
curve inside one row; see ``FormulaScorer.at``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.functions.fares import clip_relative

Scorer = Callable[[DataFrame], DataFrame]


class FormulaScorer:
    """Scorer from a formula of lead day, as-of day and stop type.

    ``output`` is ``predicted_relative``, clipped, or ``predicted_fare``: dollars, as they are.
    """

    def __init__(self, formula: Callable[[Column, Column, Column], Column], output: str = "predicted_relative"):
        self.formula, self.output = formula, output

    def at(self, days: Column, as_of: Column, nonstop: Column) -> Column:
        """The prediction for given values, as an expression."""
        value = self.formula(days.cast("double"), as_of.cast("double"), nonstop)
        return clip_relative(value) if self.output == "predicted_relative" else value

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.output, self.at(F.col("days_before_departure"), F.col("as_of_days"), F.col("is_nonstop")))


def formula_scorer(formula: Callable[[Column, Column, Column], Column]) -> FormulaScorer:
    return FormulaScorer(formula)


def _falling(days: Column, as_of: Column) -> Column:
    return F.lit(0.70) + F.lit(0.30) * days / F.greatest(as_of, F.lit(1.0))


def falling() -> FormulaScorer:
    """Fares fall linearly to 70 % of today's."""
    return formula_scorer(lambda days, as_of, nonstop: _falling(days, as_of))


def by_stop() -> FormulaScorer:
    """Connecting fares fall, nonstop fares stay flat."""
    return formula_scorer(
        lambda days, as_of, nonstop: F.when(nonstop, F.lit(1.05)).otherwise(_falling(days, as_of))
    )


def drift() -> FormulaScorer:
    """Relative fare grows with the lead day, whatever the as-of day."""
    return formula_scorer(lambda days, as_of, nonstop: F.lit(0.50) + F.lit(0.01) * days)


def dip() -> FormulaScorer:
    """Cheapest ten days before departure."""
    return formula_scorer(lambda days, as_of, nonstop: F.lit(0.80) + F.lit(0.02) * F.abs(days - 10))


def dollars() -> FormulaScorer:
    """Fares in dollars: cheapest ten days before departure, whatever today's fare."""
    return FormulaScorer(lambda days, as_of, nonstop: F.lit(120.0) + F.lit(2.5) * F.abs(days - 10), "predicted_fare")


def model_scorer(model: PipelineModel, output: str = "predicted_relative", clip: bool = True) -> Scorer:
    """Scorer from a fitted pipeline whose prediction column is ``prediction``."""

    def score(rows: DataFrame) -> DataFrame:
        wanted = rows.columns
        value = F.col("prediction")
        return model.transform(rows).select(
            *wanted, (clip_relative(value) if clip else value).alias(output)
        )

    return score
