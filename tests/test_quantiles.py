import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.plans import quantiles
from spendlens.plans.quantiles import _bucket, bucket_counts, exact_quantiles, plain_figures

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def check(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: r for r in exact_quantiles(df, "k", "v", PROBS).collect()}
    for k, vs in groups.items():
        want = np.quantile(np.array(vs, dtype=float), list(PROBS.values()))
        assert [got[k][name] for name in PROBS] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_hot_values_signs_and_singletons(spark):
    rng = np.random.default_rng(3)
    check(
        spark,
        {
            "third is one value": np.where(rng.random(900) < 0.34, 7.0, rng.normal(0, 1e6, 900)),
            "signs": np.concatenate([-rng.lognormal(0, 8, 300), [0.0] * 50, rng.lognormal(0, 8, 300)]),
            "single": [42.5],
            "two": [1.0, 2.0],
            "same": [5.0] * 40,
            "tiny": [1e-300, -1e-300, 0.0, 1e300],
        },
    )


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60))
def test_matches_numpy(spark, values):
    check(spark, {"k": values})


def test_buckets_never_decrease(spark):
    rng = np.random.default_rng(5)
    values = sorted([float(v) for v in rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-12, 12, 2000)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r[0] for r in df.orderBy("i").select(_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_nulls_are_ignored(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 9.0)], "k string, v double")
    assert [tuple(r) for r in exact_quantiles(df, "k", "v", {"m": 0.5}).collect()] == [("a", 2.0)]


def test_close_values_are_cut_again_before_any_are_sorted(spark, monkeypatch):
    """Ten thousand different values inside a part of one bucket, next to far ones."""
    rng = np.random.default_rng(9)
    close = (1.0 + rng.random(10_000) * 1e-6).tolist()
    rows = [("close", v) for v in close] + [("far", v) for v in rng.lognormal(0, 20, 500).tolist()] + [("one", 3.0)] * 5000
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    seen = []
    real = quantiles._rows_in

    def counting(df, key, value, ranges):
        seen.append([r.held for r in ranges])
        return real(df, key, value, ranges)

    monkeypatch.setattr(quantiles, "_rows_in", counting)
    got = {r["k"]: [r[n] for n in PROBS] for r in exact_quantiles(df, "k", "v", PROBS, most_rows=20).collect()}
    for k in ("close", "far", "one"):
        want = np.quantile(np.array([v for x, v in rows if x == k]), list(PROBS.values()))
        assert got[k] == pytest.approx(list(want), rel=1e-12)
    assert max(seen[0]) > 5000 and max(seen[-1]) <= 20


def test_plain_figures_come_from_the_buckets(spark):
    rng = np.random.default_rng(4)
    values = (1e9 + rng.normal(0, 1, 4000)).tolist()
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "k string, v double")
    got = {r["k"]: r for r in plain_figures(bucket_counts(df, "k", "v"), "k").collect()}
    assert got["a"]["n"] == 4000 and got["a"]["std"] == pytest.approx(np.std(values, ddof=1), rel=1e-7)
    assert got["a"]["mean"] == pytest.approx(np.mean(values), rel=1e-12)
    assert (got["a"]["min"], got["a"]["max"]) == (min(values), max(values))
    assert got["b"]["std"] is None
