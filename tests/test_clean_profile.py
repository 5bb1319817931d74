import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.expressions import adjusted_kurtosis, adjusted_skewness, buckets, label, ratio, safe_corr
from tidegrid.functions.metrics import all_metrics, weighted_mean
from tidegrid.operators import clean as cl
from tidegrid.operators import profile as pr


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_exact_quantiles(spark, n):
    x = np.random.default_rng(n).integers(0, 50, n) / 3
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = cl.exact_quantiles(df, "v", [0, 0.25, 0.5, 0.999, 1])
    assert got == ([None] * 5 if not n else pytest.approx(list(np.quantile(x, [0, 0.25, 0.5, 0.999, 1]))))


def test_fence_modes(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 1000]], "v double")
    assert cl.fence(df, "v").count() == 20
    assert cl.fence(df, "v", how="cap").agg(F.max("v")).first()[0] == pytest.approx(30.0)
    assert cl.fence(df, "v", how="zero").count() == 21 and cl.fence(df, "v", how="null").where("v is null").count() == 1


def test_rules_and_report(spark):
    df = spark.createDataFrame([(1, None), (5, 2.0), (None, 3.0), (-1, 4.0)], "a int, b double")
    assert {r["rule"]: r["n"] for r in cl.rule_counts(df, {"neg": F.col("a") < 0, "big": F.col("b") > 2}).collect()} == {"neg": 1, "big": 2}
    report = {r[0]: r[1] for r in cl.cleaning_report(df, {"a": F.col("a") > 0, "b": F.col("b") > 0}).collect()}
    assert report == {"input": 4, "a": 2, "b": 1, "kept": 1}
    assert df.where(cl.in_range(F.col("b"), 2, 3, null_ok=True)).count() == 3 and df.where(cl.in_range(F.col("b"), 2, 3)).count() == 2


def test_moments_and_correlation(spark):
    x = pd.Series(np.random.default_rng(2).gamma(2, size=50))
    df = spark.createDataFrame([(float(v), float(v * v), 1.0) for v in x], "x double, y double, c double")
    got = df.agg(adjusted_skewness(F.col("x")), adjusted_kurtosis(F.col("x")), safe_corr(F.col("x"), F.col("y")), safe_corr(F.col("x"), F.col("c")), adjusted_skewness(F.col("c"))).first()
    assert list(got[:4]) == pytest.approx([x.skew(), x.kurt(), x.corr(x * x), 0.0]) and got[4] is None


def test_buckets_labels_ratio(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (6,), (None,)], "v int")
    got = [tuple(r) for r in df.select(buckets(F.col("v"), [0, 1, 5], ["a", "b"]), label(F.col("v"), {1: "one"}, "?"), ratio(F.lit(1.0), F.col("v"))).collect()]
    assert got == [(None, "?", None), ("a", "one", 1.0), ("b", "?", 0.2), (None, "?", 1 / 6), (None, "?", None)]


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "y double, p double")
    m = df.agg(*all_metrics(F.col("y"), F.col("p"))).first().asDict()
    assert m["mae"] == pytest.approx(2 / 3) and m["mape"] == pytest.approx(25.0) and m["wmape"] == pytest.approx(200 / 6) and m["r2"] == pytest.approx(0.75)
    w = spark.createDataFrame([(1.0, 1), (float("nan"), 9), (None, 9), (4.0, 3)], "v double, w int").agg(weighted_mean(F.col("v"), F.col("w"))).first()[0]
    assert w == pytest.approx(3.25)


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 100)], "k string, v int")
    assert sum(r["pct"] for r in pr.value_shares(df, ["k"]).collect()) == pytest.approx(100)
    assert {r["v"] for r in pr.top_k(df, 1, ["k"], [F.desc("v")]).collect()} == {2, 100}
    assert {r["bucket"]: r["n"] for r in pr.histogram(df, "v", 0, 10, 5).collect()} == {0: 1, 1: 2, 4: 1}


def test_ks_normal(spark):
    x = np.random.default_rng(0).normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    from math import erf

    cdf = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in z])
    want = max(np.abs(np.arange(1, 2001) / 2000 - cdf).max(), np.abs(cdf - np.arange(2000) / 2000).max())
    assert pr.ks_normal(df, "v").first()["ks"] == pytest.approx(want, abs=1e-6)


def test_grouped_quantiles_against_numpy(spark):

    rng = np.random.default_rng(2)
    groups = {"few": rng.normal(size=7), "many": np.round(rng.exponential(size=4000), 2), "same": np.ones(50), None: rng.normal(size=300)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    for accuracy in (10_000, 100):
        got = {r.g: list(r.q) for r in cl.grouped_quantiles(df, F.col("v"), probs, ["g"], accuracy).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, probs)), (g, accuracy)
    assert cl.exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]
