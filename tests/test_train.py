import dataclasses
import pathlib
from datetime import date, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from leadcurve.operators import market, metrics
from leadcurve.operators.features import attach_features
from leadcurve.operators.pairs import remaining_pairs
from leadcurve.plans import backtest, serve, train
from leadcurve.session import checkpoint_folder, shared_folder, stage
from leadcurve.sources import bundle
from tests.helpers import daily


@pytest.fixture(scope="module")
def table(spark):
    first = date(2022, 8, 1)
    curves = {}
    for i in range(24):
        for o, d in (("ATL", "LAX"), ("BOS", "ORD")):
            curves[(o, d, first + timedelta(days=3 * i), i % 2 == 0)] = {
                day: 150 + 2 * abs(day - 12) + i % 5 for day in range(1, 31, 2)
            }
    return stage(daily(spark, curves), "train-test")


def test_training_selects_scores_and_survives_a_round_trip(spark, table, tmp_path):
    small = {
        "weak": {"maxIter": 1, "stepSize": 0.1, "maxDepth": 1},
        "strong": {"maxIter": 4, "stepSize": 0.3, "maxDepth": 4},
    }
    result = train.train(table, small)
    assert result.configuration in small
    record = result.record.first()
    assert record.train_rows + record.validation_rows + record.test_rows == remaining_pairs(table).count()
    assert 0 <= record.test_buy_wait_agreement <= 1
    refit = result.refit_errors.first()
    assert refit.pairs == record.test_rows and 0 < refit.rmse < 100
    path = str(tmp_path / "bundle")
    bundle.save_bundle(
        path, result.model, market.with_market_columns(table), result.route_lookup, result.global_lookup, result.record
    )
    loaded = bundle.load_bundle(spark, path)
    assert (loaded.kind, loaded.routes.count(), loaded.evaluation.count()) == ("relative_remaining", 2, 1)
    assert loaded.route_lookup.count() == 2 and len(loaded.feature_columns) == 11
    rows = attach_features(remaining_pairs(table)).withColumn(
        "route_cat", F.when(F.col("route") == "ATL-LAX", "NEW-NEW").otherwise(F.col("route"))
    )
    scored = train.scorer_of(loaded.model)(rows)
    assert set(scored.columns) == {*rows.columns, "predicted_relative"}
    bounds = scored.agg(F.min("predicted_relative"), F.max("predicted_relative"), F.count("predicted_relative")).first()
    assert bounds[0] >= 0.3 and bounds[1] <= 3.0 and bounds[2] == rows.count()


def test_all_configurations_are_scored_side_by_side(spark, table):
    rows = stage(numeric_rows(table), "side-by-side")
    models = {
        name: train.fit_model(rows, train.route_indexer(table), maxIter=n, maxDepth=3, stepSize=0.3) for name, n in (("few", 1), ("more", 4))
    }
    validation = train.timing_rows(table)
    together = {name: train.selection_key(score) for name, score in train.timing_on_each(validation, models).items()}
    assert together == {name: train.selection_key(train.timing_on(validation, train.scorer_of(m))) for name, m in models.items()}
    scored = metrics.compared_curves(validation, *train.scorer_of_all(models))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1  # the curves are read once for both
    assert {r.configuration for r in scored.select("configuration").distinct().collect()} == set(models)


def test_fits_cut_their_lineage_in_the_shared_folder(spark, table, monkeypatch):
    monkeypatch.setattr(train, "CHECKPOINT_TREES", 1)
    model = train.fit_model(numeric_rows(table), train.route_indexer(table), maxIter=3, maxDepth=2)
    trees = model.stages[-1]
    assert trees.getCacheNodeIds() and trees.getCheckpointInterval() == 1
    assert shared_folder(spark).removeprefix("file://") in checkpoint_folder(spark).removeprefix("file:")


def test_the_first_best_configuration_wins():
    keys = {"a": (0.5, -2.0, 0.1), "b": (0.6, -9.0, 0.0), "c": (0.6, -9.0, 0.0)}
    assert train.best_configuration(keys) == "b"
    assert set(train.CONFIGURATIONS) == {"default", "more trees, lower lr", "shallower + regularized"}


def test_the_bundle_decides_how_requests_are_answered(spark, table, tmp_path):
    settings = {"maxIter": 2, "maxDepth": 3}
    counts = market.lookup_counts(table)
    lookups = market.route_lookups(counts), market.global_lookups(counts)
    evaluation = spark.range(1)
    rows = numeric_rows(table)
    models = {
        bundle.MODEL_KIND: train.fit_model(rows, train.route_indexer(table), **settings),
        bundle.ABSOLUTE_KIND: train.fit_absolute(table, **settings),
    }
    today = date(2022, 9, 1)
    requests = spark.createDataFrame(
        [(1, "ATL", "LAX", today, today + timedelta(days=20), 500.0, "all")],
        "request_id int, origin string, destination string, today date, flight_date date, current_price double, stops string",
    )
    prices = {}
    for kind, model in models.items():
        path = str(tmp_path / kind)
        bundle.save_bundle(path, model, market.with_market_columns(table), *lookups, evaluation, kind=kind)
        kept = bundle.load_bundle(spark, path)
        assert kept.kind == kind and len(kept.feature_columns) == (11 if kind == bundle.MODEL_KIND else 6)
        prices[kind] = serve.answer(requests, kept).first().current_price
    assert prices[bundle.MODEL_KIND] == 500.0  # pinned
    assert 140 < prices[bundle.ABSOLUTE_KIND] < 200  # the model's own dollars
    other = dataclasses.replace(kept, kind="other")
    with pytest.raises(ValueError, match="unknown kind"):
        serve.answer(requests, other)


def numeric_rows(table):
    return train.numeric_inputs(attach_features(remaining_pairs(table)))


def test_a_backtest_is_written_and_leaves_nothing_staged(spark, table, tmp_path):
    model = train.fit_model(numeric_rows(table), train.route_indexer(table), maxIter=2, maxDepth=3)
    counts = market.lookup_counts(table)
    path = str(tmp_path / "bundle")
    bundle.save_bundle(
        path, model, market.with_market_columns(table), market.route_lookups(counts), market.global_lookups(counts), spark.range(1)
    )
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    market_rows = stage(market.with_market_columns(table), "market-test")
    kept = {*before, *shared.iterdir()}
    backtest.write_backtest(market_rows, bundle.load_bundle(spark, path), str(tmp_path / "out"), bootstrap_samples=20)
    assert set(shared.iterdir()) == kept
    assert spark.read.json(str(tmp_path / "out/policies")).count() == 6
    decisions = spark.read.option("header", True).csv(str(tmp_path / "out/decisions"))
    assert decisions.count() == int(spark.read.json(str(tmp_path / "out/record")).first().booking_decisions)


def test_fitting_reads_a_bounded_sample_and_the_record_reads_all(spark, table):
    small = {"one": {"maxIter": 1, "maxDepth": 1}}
    record = train.train(table, small, max_pairs=50).record.first()
    assert record.train_rows + record.validation_rows + record.test_rows == remaining_pairs(table).count() > 50


def test_training_fits_every_pair_of_its_parts(spark, table, monkeypatch):
    read, fit = [], train.fit_model

    def sampled(*args, **settings):
        raise AssertionError("a sample was drawn")

    def counted(rows, *args, **settings):
        read.append(rows.count())
        return fit(rows, *args, **settings)

    monkeypatch.setattr(train.split, "pair_sample", sampled)
    monkeypatch.setattr(train, "fit_model", counted)
    record = train.train(table, {"one": {"maxIter": 1, "maxDepth": 1}}).record.first()
    assert read == [record.train_rows, record.train_rows + record.validation_rows]


def many_pairs(spark, rows):
    """Pairs of one route with ``rows`` different fares; the one dear pair is the only one of December."""
    dear = F.col("id") == rows // 2
    features = spark.range(0, rows, 1, 4).select(
        F.lit("ATL-LAX").alias("route_cat"),
        (F.col("id") % 2 == 0).alias("is_nonstop"),
        (F.col("id") % 20).alias("days_before_departure"),
        F.lit(21).alias("as_of_days"),
        F.log(F.col("id") + 20.0).alias("log_current_fare"),
        F.lit(3).alias("departure_day_of_week"),
        F.when(dear, 12).otherwise(6).alias("departure_month"),
        (F.col("id") % 7).alias("search_day_of_week"),
        F.lit(1940.0).alias("totalTravelDistance"),
        F.lit(False).alias("departure_is_weekend"),
        F.lit(False).alias("near_holiday"),
        F.when(dear, 3.0).otherwise(1.0).alias("rel_fare"),
    )
    return stage(train.numeric_inputs(features), "many-pairs")


def test_splits_are_found_among_all_rows(spark, table):
    rows = many_pairs(spark, 60_000)  # more than the 10,000 that Spark looks at
    model = train.fit_model(rows, train.route_indexer(table), maxIter=1, maxDepth=1)
    found = model.transform(rows).groupBy("departure_month").agg(F.min("prediction"), F.max("prediction")).collect()
    assert {r[0]: r[1:] for r in found} == {6: (1.0, 1.0), 12: (3.0, 3.0)}


def test_inputs_of_many_values_are_binned_in_their_order(spark, table, tmp_path):
    rows = many_pairs(spark, 20_000).withColumn("rel_fare", F.when(F.col("log_current_fare") < F.log(F.lit(5020.0)), 1.0).otherwise(2.0))
    ready = train.input_steps(rows, train.route_indexer(table))
    assert ready.max_bins**2 > 20_000
    (bins,) = [s for s in ready.steps if s.__class__.__name__ == "Bucketizer"]
    assert bins.getInputCols() == ["x_log_current_fare"]
    (splits,) = bins.getSplitsArray()
    assert len(splits) == train.BINS + 1 and splits == sorted(splits)
    model = train.fit_model(rows, train.route_indexer(table), ready=ready, maxIter=1, maxDepth=1)
    path = str(tmp_path / "model")
    model.write().save(path)
    found = PipelineModel.load(path).transform(rows).withColumn("dear", F.col("rel_fare") > 1).groupBy("dear", "prediction").count()
    # 5,000 of 20,000 values lie below, an edge of bins, and one split tells them apart
    assert {(r.dear, r.prediction): r["count"] for r in found.collect()} == {(False, 1.0): 5000, (True, 2.0): 15000}
    assert model.stages[-1].trees[0].depth == 1 and "not in" not in model.stages[-1].toDebugString
