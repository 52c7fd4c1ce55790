"""Training: pairs, chronological split, boosted trees, selection on timing, refit."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby, pairwise

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Bucketizer, Imputer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.functions.dates import day_of_week
from leadcurve.functions.fares import clip_relative
from leadcurve.operators import market, metrics, pairs, split
from leadcurve.operators.features import attach_features, departure_features
from leadcurve.operators.quantiles import equal_bins, value_counts
from leadcurve.operators.sampling import hash_sample
from leadcurve.operators.scorers import Scorer, model_scorer
from leadcurve.session import checkpoint_folder, stage

# Named configurations. Spark's trees grow by depth and have no L2 penalty, so leaf
# counts of 31 and 15 become depths 5 and 4.
CONFIGURATIONS: dict[str, dict[str, float]] = {
    "default": {"maxIter": 300, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 20},
    "more trees, lower lr": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 20},
    "shallower + regularized": {"maxIter": 300, "stepSize": 0.08, "maxDepth": 4, "minInstancesPerNode": 50},
}

BINS = 64  # of an input, or as many as there are routes
MAX_BINS_READ = 46_340  # Spark squares its number of bins in 32 bits
CHECKPOINT_TREES = 10  # lineage of the residuals and node ids is cut after so many trees

_NUMERIC = [
    "is_nonstop",
    "days_before_departure",
    "as_of_days",
    "log_current_fare",
    "departure_day_of_week",
    "departure_month",
    "search_day_of_week",
    "departure_is_weekend",
    "near_holiday",
]


def route_indexer(daily: DataFrame) -> StringIndexerModel:
    """Fixed route categories; a route that is not among them counts as missing."""
    indexer = StringIndexer(
        inputCol="route_cat",
        outputCol="route_index",
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    routes = market.with_market_columns(daily).select(F.col("route").alias("route_cat")).distinct()
    return indexer.fit(routes)


_ABSOLUTE_NUMERIC = [c for c in C.ABSOLUTE_FEATURE_COLUMNS if c not in ("route_cat", "totalTravelDistance")]


def numeric_inputs(features: DataFrame, numeric: list[str] = _NUMERIC) -> DataFrame:
    """Model inputs as doubles; other columns stay as they are."""
    inputs = {f"x_{c}": F.col(c).cast("double") for c in numeric}
    return features.withColumns(inputs).withColumn(
        "x_distance", F.col("totalTravelDistance").cast("double")
    )


@dataclass(frozen=True)
class InputSteps:
    steps: list[Transformer]  # fitted: route, distance, bins, vector
    max_bins: int


def bin_edges(inputs: DataFrame, columns: list[str], bins: int) -> tuple[dict[str, list[float]], int]:
    """Edges between the bins of each column with more than ``bins`` values, and the number of rows."""
    named = ", ".join(f"'{c}', {c}" for c in columns)
    values = inputs.select(F.expr(f"stack({len(columns)}, {named}) AS (input, value)"))
    found = equal_bins(value_counts(values, ["input"], "value"), ["input"], "value", "n", bins)
    edges, rows = {}, 0
    # at most as many rows as columns and bins
    for name, ranges in groupby(found.orderBy("input", "bin").collect(), key=lambda r: r["input"]):
        ranges = list(ranges)
        rows = max(rows, ranges[0]["rows"])
        if ranges[0]["values"] > bins:
            middles = [((a["high"] + b["low"]) / 2, a["high"], b["low"]) for a, b in pairwise(ranges)]
            edges[name] = [middle if middle > high else low for middle, high, low in middles]
    return edges, rows


def input_steps(features: DataFrame, indexer: StringIndexerModel, numeric: list[str] = _NUMERIC) -> InputSteps:
    """Steps from features to the vector of inputs; a missing distance takes the median.

    Trees split between any two values of an input, or between equally filled bins if it has
    more than ``BINS`` values (or routes). Values and bins are those of all rows: Spark alone
    looks for splits among the squared number of bins of rows, or 10,000. Bins leave few values, so
    the number of bins may be raised until that square covers all rows and splits stay as many.
    """
    imputer = Imputer(inputCols=["x_distance"], outputCols=["x_distance_known"], strategy="median").fit(features)
    columns = [*[f"x_{c}" for c in numeric], "x_distance_known"]
    bins = max(BINS, len(indexer.labels) + 1)
    edges, rows = bin_edges(imputer.transform(features), columns, bins)
    steps = [indexer, imputer]
    if edges:
        splits = [[-math.inf, *inner, math.inf] for inner in edges.values()]
        steps.append(Bucketizer(splitsArray=splits, inputCols=list(edges), outputCols=[f"{c}_bin" for c in edges]))
        # a sum is a number for the trees; a bucket's own column would be taken for a category
        ordered = ", ".join(f"{c}_bin + 0D AS {c}_ordered" for c in edges)
        steps.append(SQLTransformer(statement=f"SELECT *, {ordered} FROM __THIS__"))
    inputs = ["route_index", *[f"{c}_ordered" if c in edges else c for c in columns]]
    steps.append(VectorAssembler(inputCols=inputs, outputCol="inputs"))
    return InputSteps(steps, max(bins, min(MAX_BINS_READ, math.isqrt(rows) + 1)))


def fit_model(
    features: DataFrame,
    indexer: StringIndexerModel,
    label: str = "rel_fare",
    numeric: list[str] = _NUMERIC,
    ready: InputSteps | None = None,
    **settings: float,
) -> PipelineModel:
    """Boosted trees over all given features, route and distance; ``ready`` are their input steps, if known.

    Node ids are kept between the levels of a tree, and they and the residuals are
    checkpointed in the shared folder, so that a lost executor costs a few trees.
    """
    checkpoint_folder(features.sparkSession)
    ready = ready or input_steps(features, indexer, numeric)
    trees = GBTRegressor(
        featuresCol="inputs",
        labelCol=label,
        predictionCol="prediction",
        maxBins=ready.max_bins,
        seed=C.SEED,
        cacheNodeIds=True,
        checkpointInterval=CHECKPOINT_TREES,
        **settings,
    )
    before = PipelineModel(ready.steps)
    return PipelineModel([*ready.steps, trees.fit(before.transform(features))])


def fit_absolute(daily: DataFrame, max_pairs: int = C.MAX_FITTING_PAIRS, **settings: float) -> PipelineModel:
    """A model of fares in dollars from the five features of a daily row and its route.

    At most ``max_pairs`` daily rows are read, the first by hash.
    """
    rows = departure_features(market.with_market_columns(daily)).withColumns(
        {"route_cat": F.col("route"), "search_day_of_week": day_of_week(F.col("searchDate"))}
    )
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (*C.CURVE_KEYS, "days_before_departure")]))
    features = numeric_inputs(hash_sample(rows, key, max_pairs), _ABSOLUTE_NUMERIC)
    return fit_model(features, route_indexer(daily), "best_fare", _ABSOLUTE_NUMERIC, **settings)


def _prepared(score: Scorer, numeric: list[str]) -> Scorer:
    def scored(rows: DataFrame) -> DataFrame:
        return score(numeric_inputs(rows, numeric)).drop(*[f"x_{c}" for c in numeric], "x_distance")

    return scored


def scorer_of(model: PipelineModel) -> Scorer:
    """Scorer of a model of relative fares."""
    return _prepared(model_scorer(model), _NUMERIC)


def scorer_of_all(models: dict[str, PipelineModel]) -> tuple[Scorer, dict[str, str]]:
    """One scorer of several models of relative fares, and the column in which it puts each.

    The models must be fitted on the same rows: they share the stages before the trees.
    """
    columns = {name: f"score_{i}" for i, name in enumerate(models)}

    def score(rows: DataFrame) -> DataFrame:
        wanted, ready = rows.columns, numeric_inputs(rows)
        for step in next(iter(models.values())).stages[:-1]:
            ready = step.transform(ready)
        for name, model in models.items():
            ready = model.stages[-1].copy().setPredictionCol(columns[name]).transform(ready)
        return ready.select(*wanted, *[clip_relative(F.col(c)).alias(c) for c in columns.values()])

    return score, columns


def dollar_scorer_of(model: PipelineModel) -> Scorer:
    """Scorer of a model of fares in dollars."""
    return _prepared(model_scorer(model, "predicted_fare", clip=False), _ABSOLUTE_NUMERIC)


def timing_rows(daily: DataFrame, curves: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of the long enough curves, stored: every configuration is scored on them.

    With ``curves`` only a sample of so many.
    """
    lengths = market.curve_lengths(daily)
    kept = lengths if curves is None else split.curve_sample(lengths, curves, seed)
    return stage(split.rows_of_curves(daily, kept), "timing-rows")


def timing_on(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Timing figures of a scorer over sampled curves."""
    scored = metrics.scored_curves(rows, scorer)
    return metrics.timing_score(stage(metrics.curve_metrics(scored), "curve-metrics"))


def timing_on_each(rows: DataFrame, models: dict[str, PipelineModel]) -> dict[str, DataFrame]:
    """Timing figures of every model; the rows are read, unfolded and scored once."""
    scored = metrics.compared_curves(rows, *scorer_of_all(models))
    kept = stage(metrics.curve_metrics(scored, [*metrics.SCORED_KEYS, "configuration"]), "curve-metrics")
    return {name: metrics.timing_score(kept.filter(F.col("configuration") == name)) for name in models}


def selection_key(score: DataFrame) -> tuple[float, float, float]:
    """What configurations are compared by; larger is better."""
    row = score.first()
    return row["buy_wait"], -row["median_best_day_err"], row["median_spearman"]


def best_configuration(keys: dict[str, tuple[float, float, float]]) -> str:
    """The first configuration with the largest key."""
    return max(keys, key=keys.__getitem__)


def _test_record(
    daily: DataFrame, parts: DataFrame, cutoffs: DataFrame, scorer: Scorer, name: str
) -> DataFrame:
    held_out = timing_rows(split.held_out_days(daily, cutoffs))
    timing = stage(timing_on(held_out, scorer), "timing")
    test = parts.filter("part = 'test'")
    errors = stage(metrics.pair_errors(test, scorer), "errors")
    return metrics.evaluation_record(parts, cutoffs, timing, errors, name)


def _parts(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs with their part of the split, and the cutoffs."""
    rows = stage(pairs.remaining_pairs(daily), "pairs")
    cutoffs = stage(split.split_cutoffs(rows, "as_of_date"), "cutoffs")
    return split.chrono_split(rows, cutoffs), cutoffs


def evaluate_scorer(daily: DataFrame, scorer: Scorer, name: str) -> DataFrame:
    """Evaluation record of a given scorer over the whole test part."""
    parts, cutoffs = _parts(daily)
    return _test_record(daily, parts, cutoffs, scorer, name)


@dataclass(frozen=True)
class Training:
    model: PipelineModel  # refitted on training and validation pairs
    configuration: str
    record: DataFrame  # one evaluation row
    refit_errors: DataFrame  # mae, rmse and pairs of the refitted model on the test pairs
    route_lookup: DataFrame
    global_lookup: DataFrame


def train(
    daily: DataFrame,
    configurations: dict[str, dict[str, float]] | None = None,
    max_pairs: int | None = None,
) -> Training:
    """Fit each configuration, select by timing on validation, test, refit.

    ``daily`` should be a stored table. Every step reads all pairs of its part. With
    ``max_pairs`` each fit reads only a fixed sample of so many.
    """
    configurations = configurations or CONFIGURATIONS
    parts, cutoffs = _parts(daily)
    indexer = route_indexer(daily)
    validation = timing_rows(split.validation_days(daily, cutoffs))

    def inputs(rows: DataFrame) -> DataFrame:
        kept = rows if max_pairs is None else split.pair_sample(rows, max_pairs)
        return stage(numeric_inputs(attach_features(kept)), "features")

    def fit(rows: DataFrame, names: Iterable[str]) -> dict[str, PipelineModel]:
        ready = input_steps(rows, indexer)
        return {name: fit_model(rows, indexer, ready=ready, **configurations[name]) for name in names}

    models = fit(inputs(parts.filter("part = 'train'")), configurations)
    keys = {name: selection_key(score) for name, score in timing_on_each(validation, models).items()}
    chosen = best_configuration(keys)
    record = _test_record(daily, parts, cutoffs, scorer_of(models[chosen]), chosen)
    both = inputs(parts.filter("part <> 'test'"))
    counts = stage(market.lookup_counts(daily), "lookup-counts")
    model = fit(both, [chosen])[chosen]
    return Training(
        model=model,
        configuration=chosen,
        record=record,
        refit_errors=stage(metrics.pair_errors(parts.filter("part = 'test'"), scorer_of(model)), "refit-errors"),
        route_lookup=market.route_lookups(counts),
        global_lookup=market.global_lookups(counts),
    )
