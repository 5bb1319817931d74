import numpy as np
import pandas as pd
import pytest

from tidegrid.operators import boosting as bo


def brute(x, y, s: bo.Settings):
    """Predictions of exact greedy boosting over all cuts between values, in plain recursion."""

    def tree(own, g, depth):
        value = -g[own].sum() / (own.sum() + s.l2)
        best = (max(s.least_gain, 1e-12), None)
        for f in range(x.shape[1]) if depth else ():
            v = x[:, f]
            for cut in sorted(set(x[~np.isnan(v), f]))[1:]:
                for missing in (False, True):
                    left = own & np.where(np.isnan(v), missing, v < cut)
                    right = own & ~left
                    if left.sum() < s.least_weight or right.sum() < s.least_weight:
                        continue
                    gain = 0.5 * sum(sign * g[m].sum() ** 2 / (m.sum() + s.l2) for sign, m in ((1, left), (1, right), (-1, own)))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (left, right))
        if best[1] is None:
            return np.where(own, value, 0.0)
        return sum(tree(m, g, depth - 1) for m in best[1])

    margin = np.full(len(y), y.mean())
    for _ in range(s.trees):
        margin = margin + s.rate * tree(np.ones(len(y), bool), margin - y, s.depth)
    return margin


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 7, n), rng.integers(0, 3, n)]).astype(float)
    y = 3 * (x[:, 0] > 5) + x[:, 1] * (x[:, 2] == 1) + rng.normal(0, 0.3, n)
    x[rng.random(x.shape) < 0.15] = np.nan
    y[np.isnan(x[:, 1])] += 4
    return x, y


def frame(spark, x, y):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double")


@pytest.mark.parametrize("depth,trees", [(1, 3), (3, 6)])
def test_equals_exact_boosting(spark, depth, trees):
    x, y = data()
    s = bo.Settings(trees=trees, depth=depth, rate=0.3)
    df = frame(spark, x, y)
    model = bo.fit(df.repartition(3), ["a", "b", "c"], "y", s)
    assert np.allclose(model.predict(x), brute(x, y, s))
    got = bo.predict(df, model).toPandas()
    assert np.allclose(got["prediction"], model.predict(got[["a", "b", "c"]].to_numpy(float)))


def test_missing_value_and_sampling(spark):
    x, y = data(400)
    df = frame(spark, np.nan_to_num(x + 1), y)  # 0 is missing
    s = bo.Settings(trees=8, depth=3, rate=0.3, missing=0.0)
    model = bo.fit(df, ["a", "b", "c"], "y", s)
    assert np.allclose(model.predict(x + 1), brute(x + 1, y, s))
    sampled = bo.fit(df, ["a", "b", "c"], "y", bo.Settings(trees=30, depth=3, rate=0.3, rows=0.8, columns=0.7, missing=0.0))
    assert np.mean((sampled.predict(x + 1) - y) ** 2) < 0.25 * y.var()
    used = {n.feature for n in sampled.trees[0].values() if n.feature is not None}
    assert len(used) <= 2


def test_many_values_take_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 1))
    y = np.where(x[:, 0] > 0.5, 2.0, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "y": y}))
    model = bo.fit(df, ["a"], "y", bo.Settings(trees=20, depth=2, rate=0.5, bins=64))
    assert np.mean((model.predict(x) - y) ** 2) < 0.05 and len(bo.cuts_of(df, ["a"], 64)[0]) <= 65


def test_odd_rows(spark):
    schema = "a double, b double, y double"
    none = bo.fit(spark.createDataFrame([], schema), ["a", "b"], "y", bo.Settings(trees=2))
    assert none.base is None and none.trees == [] and np.isnan(none.predict(np.ones((1, 2)))).all()
    rows = spark.createDataFrame([(None, 1.0, 2.0), (float("nan"), 1.0, 4.0), (None, 1.0, None)], schema)
    flat = bo.fit(rows, ["a", "b"], "y", bo.Settings(trees=2, depth=2))
    assert flat.predict(np.array([[np.nan, 1.0]])).tolist() == [3.0] and bo.nodes(spark, flat).where("feature is not null").count() == 0
    tied = bo.fit(spark.createDataFrame([(float(i % 2), float(i % 2), float(i % 2)) for i in range(8)] * 2, schema), ["a", "b"], "y", bo.Settings(trees=1, depth=1))
    assert tied.trees[0][0].feature == 0 and not tied.trees[0][0].missing_left
