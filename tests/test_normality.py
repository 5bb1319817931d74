import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.normal import normal_above, normal_quantile
from tidegrid.operators import normality as no
from tidegrid.operators import sketches as sk


def frame(spark, values, extra=()):
    return spark.createDataFrame([(i, None if v is None else float(v), *extra) for i, v in enumerate(values)], "id long, v double" + ", g string" * bool(extra))


def test_quantile_and_tail(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.925, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"), normal_above(normal_quantile(F.col("p"))).alias("above")).collect()
    for r in got:
        if r.p > 1e-200:
            assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-8 * max(1, abs(r.z))
        assert abs(r.above - 0.5 * math.erfc(r.z / 2**0.5)) <= 3e-7 * max(r.above, 0.5 * math.erfc(r.z / 2**0.5))
    assert spark.range(1).select(normal_quantile(F.lit(0.0))).first()[0] is None


# Published: the weights of eleven men in Shapiro and Wilk's paper, and what statistics packages give for other samples.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_published_example(spark):
    r = no.shapiro_wilk(frame(spark, MEN), "v", "id").first()
    assert r.n == 11 and round(r.w, 4) == 0.7888 and round(r.p_value, 6) == 0.006704


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 12, 25, 5000])
def test_normal_and_skewed_samples(spark, n):
    z = [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]
    normal, skewed = (no.shapiro_wilk(frame(spark, v), "v", "id").first() for v in (z, np.exp(2 * np.array(z))))
    assert normal.w > 0.95 and normal.p_value > 0.5 and skewed.w < normal.w and skewed.p_value < normal.p_value
    mirrored = no.shapiro_wilk(frame(spark, [-3 * v + 7 for v in np.exp(2 * np.array(z))]), "v", "id").first()
    assert abs(mirrored.w - skewed.w) < 1e-9


def test_p_values_of_normal_samples_are_uniform(spark):
    rng = np.random.default_rng(0)
    rows = [(g * 1000 + i, float(v), f"g{g}") for g in range(200) for i, v in enumerate(rng.normal(5, 2, 40))]
    p = np.array([r.p_value for r in no.shapiro_wilk(spark.createDataFrame(rows, "id long, v double, g string"), "v", "id", ["g"]).collect()])
    assert len(p) == 200 and abs((p < 0.5).mean() - 0.5) < 0.12 and (p < 0.05).mean() < 0.11


def test_sample_is_fixed(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.exponential(size=9000))
    a, b = (no.shapiro_wilk(df.repartition(k), "v", "id").first() for k in (1, 7))
    assert a.n == 5000 and abs(a.w - b.w) < 1e-12 and a.p_value < 1e-10


def test_odd_groups(spark):
    rows = [(0, 1.0, "flat"), (1, 1.0, "flat"), (2, 1.0, "flat"), (3, 5.0, "two"), (4, 6.0, "two"), (5, None, "none"), (6, 1.0, None), (7, 2.0, None), (8, 4.0, None), (9, float("nan"), None)]
    df = spark.createDataFrame(rows, "id long, v double, g string")
    got = {r.g: r for r in no.shapiro_wilk(df, "v", "id", ["g"]).collect()}
    assert set(got) == {"flat", "two", None} and got["flat"].w is None and got["two"].p_value is None and got[None].n == 3 and 0 < got[None].p_value < 1
    assert [tuple(r) for r in no.shapiro_wilk(df.where("false"), "v", "id").collect()] == [(0, None, None)] and no.shapiro_wilk(df.where("false"), "v", "id", ["g"]).collect() == []


def test_kolmogorov(spark):
    # Published percentage points of the limiting distribution.
    for x, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01), (0.8276, 0.5)):
        got = spark.range(1).select(no.kolmogorov_above(F.lit(x / 10), F.lit(100))).first()[0]
        assert abs(got - p) < 1e-4
    assert spark.range(1).select(no.kolmogorov_above(F.lit(0.001), F.lit(10)), no.kolmogorov_above(F.lit(0.9), F.lit(10_000))).first() == (1.0, 0.0)
    r = no.jarque_bera_test(frame(spark, [NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)]), "v").first()
    assert abs(r.p_value - math.exp(-r.jb / 2)) < 1e-12 and r.p_value > 0.5


def test_sketches_merge_within_their_bound(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), f"k{k}", float(v)) for d in range(6) for k in range(3) for v in rng.lognormal(k, 1, 700)]
    df = spark.createDataFrame([*rows, (1, "k0", None), (1, "k0", float("nan")), (9, "only", None)], "day int, key string, v double").repartition(6)
    stored = sk.sketches(df, "v", ["day", "key"])
    assert stored.count() == 18
    for by, where in ((["key"], "true"), ([], "day between 2 and 4")):
        got = sk.percentiles(stored.where(where), {"p0": 0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1}, by).collect()
        for r in got:
            own = np.sort([v for d, k, v in rows if (not by or k == r.key) and (by or 2 <= d <= 4)])
            assert r.n == len(own) and r.p0 == own[0] and r.p100 == own[-1]
            for name, p in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99)):
                assert abs(np.searchsorted(own, r[name], side="right") / len(own) - p) < 0.0265
    share = sk.share_below(stored, 1.0, ["key"]).collect()
    assert all(abs(r.share - np.mean([v <= 1.0 for _, k, v in rows if k == r.key])) < 0.0265 for r in share)
    none = sk.percentiles(stored.where("false"), {"p50": 0.5}).collect()
    assert [tuple(r) for r in none] == [(0, None)]
