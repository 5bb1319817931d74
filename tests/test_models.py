from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import cluster as cu
from tidegrid.operators import forecast as fc
from tidegrid.operators import kshape as ks


def seasonal(n=240, level=20.0, slope=0.05):
    t = np.arange(n)
    return level + slope * t + 6 * np.sin(2 * np.pi * t / 24)


def frame(spark, series):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=i), float(v)) for k, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "key string, bin timestamp_ntz, demand double")


def test_holt_winters_follows_a_season(spark):
    out = fc.holt_winters(frame(spark, {"a": seasonal(), "b": seasonal(level=5), "short": seasonal(71)}), "key").toPandas()
    assert set(out.key) == {"a", "b"} and np.abs(out.actual - out.prediction).mean() < 0.5 and len(out) == 2 * 72


def sse(y, fits):
    return float(((y - fits) ** 2).sum())


def test_estimated_start_is_never_worse():
    rng = np.random.default_rng(0)
    series = [seasonal(120) + rng.normal(0, 1, 120), rng.poisson(3, 90).astype(float), np.zeros(72), np.r_[np.zeros(60), np.ones(60) * 50], rng.normal(size=100) * 1e6, np.arange(80.0) ** 2, np.tile([0.0, 0, 9, 0], 30)]
    for m in (4, 24):
        for y in series:
            means, best, estimated = (sse(y, fc.fit_holt_winters(y, m, how)[0]) for how in ("means", "best", "estimated"))
            assert estimated <= best * (1 + 1e-9) + 1e-9 and best <= means * (1 + 1e-9) + 1e-9


def test_estimated_start_evens_out_a_noisy_first_season():
    rng = np.random.default_rng(2)
    y = seasonal(240, slope=0.0) + rng.normal(0, 2, 240)
    assert sse(y, fc.fit_holt_winters(y)[0]) < 0.9 * sse(y, fc.fit_holt_winters(y, start="means")[0])


def test_start_is_recovered_and_optimal():
    m, params = 6, np.array([[0.3, 0.1, 0.2]])
    rng = np.random.default_rng(1)
    level, trend, season = 40.0, 0.5, rng.normal(0, 5, m)
    season -= season.mean()
    y, parts, lev, tr = [], season.copy(), level, trend
    for t in range(90):  # a series without errors follows its start
        y.append(lev + tr + parts[t % m])
        lev, tr = lev + tr, tr
    found, starts = fc.least_squares_start(np.array(y), m, params)
    assert found[0] < 1e-6 and np.allclose(np.r_[starts[0][:2], starts[0][2]], np.r_[level, trend, season], atol=1e-4)
    noisy = np.array(y) + rng.normal(0, 3, 90)
    found, starts = fc.least_squares_start(noisy, m, params)
    c = np.r_[starts[0][0], starts[0][1], starts[0][2][:-1]]
    error = lambda c: fc._smooth(noisy, m, params, (c[0], c[1], np.r_[c[2:], -c[2:].sum()]))[0][0]
    assert np.isclose(error(c), found[0])
    for i in range(len(c)):
        for step in (0.05, -0.05):
            assert error(c + step * (np.arange(len(c)) == i)) > found[0]


def test_start_of_odd_series(spark):
    out = fc.holt_winters_start(frame(spark, {"a": [1.0] * 3, "flat": [5.0] * 12, "null": [2.0] * 12}).withColumn("demand", F.expr("if(key = 'null' and hour(bin) = 3, null, demand)")), "key", 0.4, 0.2, 0.3, season=4).toPandas()
    assert sorted(out["key"]) == ["flat", "null"] and out[out["key"] == "flat"].sse.iloc[0] < 1e-9 and np.isfinite(out.sse).all()
    assert fc.holt_winters_start(spark.createDataFrame([], "key string, bin timestamp_ntz, demand double"), "key", 0.4, 0.2, 0.3).count() == 0


def test_feature_never_leaks_the_actual(spark):
    out = fc.add_holt_winters_feature(frame(spark, {"a": seasonal(), "short": seasonal(40)}), "key").toPandas().sort_values(["key", "bin"])
    short = out[out.key == "short"]
    assert short.hw_fallback.all() and (short.hw_forecast.iloc[24:].to_numpy() == short.demand.iloc[:16].to_numpy()).all() and not out[out.key == "a"].hw_fallback.any()


def test_kshape_groups_shifted_waves():
    t, rng = np.arange(96), np.random.default_rng(0)
    x = [np.sin(2 * np.pi * (t + s) / 48) for s in range(4)] + [np.where((t + s) % 24 < 4, 1.0, 0.0) for s in range(4)] + [(t + s) / 96.0 for s in range(4)]
    x = np.array(x) + 0.02 * rng.normal(size=(12, 96))
    best = max(sum(len(set(cu.kshape_labels(x, 3, seed)[i : i + 4])) == 1 for i in (0, 4, 8)) for seed in range(5))
    assert best == 3


def waves():
    t, rng = np.arange(48), np.random.default_rng(0)
    x = [np.sin(2 * np.pi * (t + s) / 24) for s in range(5)] + [np.where((t + s) % 12 < 2, 1.0, 0.0) for s in range(5)] + [(t + s) / 48.0 for s in range(5)]
    return np.array(x) + 0.02 * rng.normal(size=(15, 48))


def test_kshape_over_partitions(spark):
    x = waves()
    df = frame(spark, {f"s{i:02d}": v for i, v in enumerate(x)})
    found = [{r.key: r.cluster_id for r in ks.kshape(df.repartition(n), "key", 3, seed).collect()} for n, seed in ((1, 1), (7, 1), (3, 2), (3, 3), (3, 4))]
    assert found[0] == found[1]
    whole = max(sum(len({f[f"s{i:02d}"] for i in range(a, a + 5)}) == 1 for a in (0, 5, 10)) for f in found)
    assert whole == 3


def test_kshape_round_sums_equal_those_of_all_series(spark):
    x = waves()
    rows = spark.createDataFrame([([float(a) for a in v], f"s{i:02d}", i % 3) for i, v in enumerate(x)], "v array<double>, name string, first long").repartition(4)
    z = cu.standardise(x)
    centres = z[[0, 5, 10]]
    sums, sizes = ks._round(rows, 3, 48, centres)
    dist = np.stack([cu._aligned(z, c)[0] for c in centres], axis=1)
    for j in range(3):
        own = cu.standardise(cu._aligned(z[dist.argmin(axis=1) == j], centres[j])[1])
        assert np.allclose(sums[j, :48], own.T @ own) and np.allclose(sums[j, 48], own.sum(axis=0)) and sizes[j] == len(own)
    assert np.allclose(ks.farthest(rows, 48, centres), z[dist.min(axis=1).argmax()])


def test_kshape_of_odd_series(spark):
    df = frame(spark, {"flat": np.ones(12), "a": np.arange(12.0), "b": np.arange(12.0) * 3})
    found = {r.key: r.cluster_id for r in ks.kshape(df, "key", 9).collect()}
    assert set(found) == {"flat", "a", "b"} and found["a"] == found["b"] and all(0 <= v < 3 for v in found.values())
    assert ks.kshape(df.where("false"), "key").count() == 0
    with pytest.raises(ValueError):
        ks.kshape(frame(spark, {"a": np.ones(3), "b": np.ones(4)}), "key").count()


def test_kernel_pca_separates_opposites():
    t = np.arange(48)
    x = np.array([np.sin(t / 4 + 0.01 * i) for i in range(5)] + [-np.sin(t / 4 + 0.01 * i) for i in range(5)])
    pcs = cu.kernel_pca(cu.correlation_kernel(x), 1)[:, 0]
    assert len({*np.sign(pcs[:5])}) == 1 and np.sign(pcs[0]) != np.sign(pcs[5])
    assert np.isfinite(cu.correlation_kernel(np.ones((3, 8)))).all()


def test_stitch_and_disaggregate(spark):
    wave = seasonal(slope=0.0)  # trees don't follow a trend
    clusters = frame(spark, {"c": wave * 3}).withColumnRenamed("key", "cluster")
    keys = frame(spark, {"a": wave, "b": wave * 2}).withColumn("cluster", F.lit("c"))
    out = fc.disaggregate(keys, clusters, "key", "cluster", "demand").toPandas()
    assert np.abs(out.actual - out.prediction).mean() < 1 and (out.prediction >= 0).all()


def test_stack_marks_in_sample(spark):
    rows = spark.createDataFrame([(i, "validation" if i < 20 else "test", float(i)) for i in range(40)], "id int, split string, y double")
    base = rows.withColumn("prediction", F.col("y") + 1)
    out = fc.stack(base, base.select("id", (F.col("prediction") - 2).alias("prediction")), ["id"], "y", "validation")
    assert out.where("in_sample").count() == 20 and out.where("prediction < 0").count() == 0


def test_multi_output_forest_shares_splits():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(300, 4))
    y = np.column_stack([np.where(x[:, 0] > 0.5, 10.0, 0.0), np.where(x[:, 0] > 0.5, -3.0, 4.0)])
    got = fc.multi_forest(x[:200], y[:200], x[200:], trees=20, depth=6)
    assert np.abs(got - y[200:]).mean() < 1 and got.shape == (100, 2)
    assert (fc.multi_forest(np.ones((5, 2)), np.ones((5, 3)), np.ones((2, 2)), 3, 3) == 1).all()


def test_forest_from_products_equals_splits_on_outputs():
    """Splits by the outputs themselves, one tree without bagging, in plain recursion."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 5))
    y[:, 0] += 4 * (x[:, 1] > 0)

    def best(rows):
        errors = {}
        for f in range(3):
            for cut in sorted(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                errors[f, float(cut)] = sum(((y[part] - y[part].mean(axis=0)) ** 2).sum() for part in (left, right))
        return min(errors.items(), key=lambda e: e[1])

    tree = fc._grow(x, y @ y.T, np.arange(40), type("All", (), {"permutation": lambda self, n: np.arange(n)})(), 1, 1)
    rows = np.arange(40)
    of_first = {k: v for k, v in [best(rows)]}  # the first third of three inputs is the first one alone
    own = min(((cut, sum(((y[p] - y[p].mean(axis=0)) ** 2).sum() for p in (rows[x[:, 0] <= cut], rows[x[:, 0] > cut]))) for cut in sorted(x[:, 0])[:-1]), key=lambda e: e[1])
    assert tree[0] == 0 and (x[:, 0] <= tree[1]).sum() == (x[:, 0] <= own[0]).sum() and next(iter(of_first))[0] == 1
    w = fc.forest_weights(x, y @ y.T, x[:4], trees=5, depth=4)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w @ y, fc.multi_forest(x, y, x[:4], 5, 4))


def test_disaggregate_equals_one_forest_a_cluster(spark):
    rng = np.random.default_rng(5)
    series = {k: np.round(seasonal(60, slope=0.0) * (1 + i) + rng.normal(0, 1, 60)) for i, k in enumerate("abc")}
    keys = frame(spark, series).withColumn("cluster", F.lit("c")).where("not (key = 'b' and hour(bin) = 5)").repartition(5)
    total = frame(spark, {"c": sum(series.values())}).withColumnRenamed("key", "cluster")
    got = {(r.key, r.bin): (r.actual, r.prediction) for r in fc.disaggregate(keys, total, "key", "cluster", "demand", n=4, trees=7, depth=5).collect()}
    whole = sum(series.values())
    x = np.array([whole[i - 4 : i][::-1] for i in range(4, 60)])
    hours = np.arange(4, 60) % 24
    y = np.column_stack([np.where((hours == 5) & (k == "b"), 0.0, series[k][4:]) for k in "abc"])
    cut = int(56 * 0.8)
    want = np.maximum(np.round(fc.multi_forest(x[:cut], y[:cut], x[cut:], 7, 5)), 0)
    start = datetime(2024, 1, 1)
    assert got == {(k, start + timedelta(hours=4 + i)): (series[k][4 + i], want[i - cut, j]) for j, k in enumerate("abc") for i in range(cut, 56) if not (k == "b" and hours[i] == 5)}


def test_long_series_are_fitted_whole(spark):
    y = np.r_[np.full(1500, 5.0), np.full(1500, 50.0)] + seasonal(3000, 0, 0)
    out = fc.holt_winters(frame(spark, {"a": y}), "key").toPandas()
    assert out.n_train.iloc[0] == int(3000 * 0.7) and np.abs(out.actual - out.prediction).mean() < 5


def test_series_are_checked_before_a_kernel(spark):
    uneven = frame(spark, {"a": seasonal(30), "b": seasonal(20)})
    with pytest.raises(ValueError):
        cu.series_matrix(uneven, "key")


def test_search_takes_the_setting_of_least_error(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(3 * (a > 0.5) + 2 * (b > 0.3))) for a, b in rng.uniform(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model, best, tried = fc.search(df, ["a", "b"], "y", "forest", {"maxDepth": [1, 4], "numTrees": [8]}, folds=2)
    assert best == {"maxDepth": 4, "numTrees": 8} and tried == 2 and model.stages[-1].getOrDefault("maxDepth") == 4
    error = {d: fc.search(df, ["a", "b"], "y", "forest", {"maxDepth": [d], "numTrees": [8]}, folds=2)[0].transform(df).selectExpr("avg(power(prediction - y, 2))").first()[0] for d in (1, 4)}
    assert error[4] < error[1]


def test_metrics_come_best_first_and_kmeans_rows_are_nearest(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(20)], "id int, y double")
    frames = {name: df.withColumn("prediction", F.col("y") * f) for name, f in (("far", 2.0), ("near", 1.1), ("mid", 1.5))}
    assert [r.model for r in fc.model_metrics(frames, "y").collect()] == ["near", "mid", "far"]
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(float(c + rng.normal()), float(-c + rng.normal())) for c in (0, 20, 40) for _ in range(40)], "a double, b double")
    got = cu.kmeans(points, ["a", "b"], k=3).toPandas()
    x, label = got[["a", "b"]].to_numpy(), got.cluster_id.to_numpy()
    centres = np.stack([x[label == j].mean(axis=0) for j in range(3)])
    assert (((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == label).all()


def test_rank_split_keeps_its_least_sides(spark):
    from tidegrid.operators.splits import rank_split

    df = frame(spark, {"long": np.zeros(100), "short": np.zeros(50), "tiny": np.zeros(3)})
    cut = {r.key: r.cut for r in rank_split(df, "key", least_train=48, least_test=1).groupBy("key").agg(F.max("train_cut").alias("cut")).collect()}
    assert cut == {"long": 70, "short": 48, "tiny": 2}
