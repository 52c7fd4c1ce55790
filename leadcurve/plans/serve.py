"""Serving: answers of a stored bundle. The bundle says what its model predicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from leadcurve.operators import recommend
from leadcurve.plans.train import dollar_scorer_of, scorer_of
from leadcurve.sources.bundle import ABSOLUTE_KIND, MODEL_KIND, Bundle


def answer(
    requests: DataFrame, bundle: Bundle, find_published: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Recommendations for ``requests``; see ``recommend.recommend_requests``."""
    if bundle.kind not in (MODEL_KIND, ABSOLUTE_KIND):
        raise ValueError(f"unknown kind of model: {bundle.kind}")
    absolute = bundle.kind == ABSOLUTE_KIND
    scorer = (dollar_scorer_of if absolute else scorer_of)(bundle.model)
    return recommend.recommend_requests(
        requests, scorer, bundle.route_lookup, bundle.global_lookup, absolute=absolute, find_published=find_published
    )
