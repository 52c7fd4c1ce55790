import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from leadcurve.operators import sampling
from leadcurve.operators.quantiles import equal_bins, exact_quantiles, ranked_quantiles, value_counts


def test_quantiles_match_numpy_with_a_hot_group_and_nulls(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randint(0, 40))) for _ in range(3000)]
    rows += [(f"k{i % 50}", rng.random() * 100) for i in range(2000)]
    rows += [("k1", None), ("alone", 4.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = exact_quantiles(df, ["k"], "v", {"med": 0.5, "low": 0.05}).collect()
    expected = {}
    for k, v in rows:
        if v is not None:
            expected.setdefault(k, []).append(v)
    assert {r.k for r in got} == set(expected)
    for r in got:
        assert np.isclose(r.med, np.median(expected[r.k]))
        assert np.isclose(r.low, np.quantile(expected[r.k], 0.05))
    whole = exact_quantiles(df, [], "v", {"med": 0.5}).collect()
    assert np.isclose(whole[0].med, np.median([v for _, v in rows if v is not None]))


def test_ranked_quantiles_match_numpy(spark):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1), rng.randint(1, 3)) for _ in range(20000)]
    rows += [(f"k{i % 40}", float(rng.randint(0, 6)), 1) for i in range(400)] + [(None, 2.5, 4), (None, 3.5, 1), ("gap", None, 7), ("k1", None, 2), ("zero", 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(3)
    extra = [F.sum("n").alias("rows"), F.count_if(F.col("v") > 0).alias("above")]
    wanted = {"low": 0.05, "med": 0.5, "top": 1.0, "first": 0.0}
    got = {r.k: r for r in ranked_quantiles(df, ["k"], "v", "n", wanted, extra).collect()}
    assert set(got) == {k for k, _, _ in rows}
    for k, r in got.items():
        own = [v for key, v, n in rows if key == k and v is not None for _ in range(n)]
        assert r.rows == sum(n for key, _, n in rows if key == k)
        assert r.above == sum(v is not None and v > 0 for key, v, _ in rows if key == k)
        for name, p in wanted.items():
            assert (r[name] is None) if not own else np.isclose(r[name], np.quantile(own, p))
    assert {r.k for r in ranked_quantiles(df, ["k"], "v", "n", {"med": 0.5}).collect()} == set(got) - {"gap", "zero"}
    empty = ranked_quantiles(df.limit(0), [], "v", "n", {"med": 0.5}).collect()
    assert [r.med for r in empty] == [None]


def test_one_key_of_a_million_amounts_is_ranked_in_ranges(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(
        F.lit("only").alias("policy"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 7.0).alias("savings"), F.lit(1).alias("n")
    )
    found = ranked_quantiles(rows, ["policy"], "savings", "n", {"median": 0.5, "low": 0.05})
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line.rsplit("[", 2)[-2] for line in windows)  # no window over a key alone
    values = np.array([(i * 7919 % 1_000_003) / 7.0 for i in range(1_000_000)])
    (row,) = found.collect()
    assert np.isclose(row["median"], np.quantile(values, 0.5)) and np.isclose(row.low, np.quantile(values, 0.05))


def test_hash_sample_is_the_head_of_the_hash_order(spark):
    ids = [f"id{i}" for i in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    order = sorted(ids, key=lambda i: hashlib.sha256(i.encode()).hexdigest())
    hashed = F.sha2("id", 256)
    small = {r.id for r in sampling.hash_sample(df, hashed, 70).collect()}
    assert small == set(order[:70])
    for size in (70, 3999, 4000, 9000):
        large = [r.id for r in sampling.hash_sample(df, hashed, size).collect()]
        assert sorted(large) == sorted(order[:size])
    ranks = {r.id: r.place for r in sampling.hash_rank(df, hashed, "place").collect()}
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == order
    assert sorted(ranks.values()) == list(range(1, 4001))


def test_equal_bins_match_a_running_count(spark):
    rng = random.Random(7)
    rows = [("spread", rng.gauss(0, 1)) for _ in range(3000)] + [("heavy", float(min(rng.randint(0, 400), 200))) for _ in range(2000)]
    rows += [("few", float(i % 3)) for i in range(30)] + [("few", None), ("gap", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(r["k"], r["bin"]): r for r in equal_bins(value_counts(df, ["k"], "v"), ["k"], "v", "n", 8).collect()}
    expected = {}
    for k in ("spread", "heavy", "few"):
        own = sorted(v for key, v in rows if key == k and v is not None)
        for v in sorted(set(own)):
            middle = own.index(v) + own.count(v) / 2
            expected.setdefault((k, int(middle * 8 / len(own))), []).append(v)
        assert {(r["rows"], r["values"]) for key, r in got.items() if key[0] == k} == {(len(own), len(set(own)))}
    assert {key: (r["low"], r["high"]) for key, r in got.items()} == {key: (vs[0], vs[-1]) for key, vs in expected.items()}
    assert [r["low"] for key, r in got.items() if r["high"] == 200.0 and key[0] == "heavy"] == [200.0]
