import numpy as np
import pytest

from tidegrid.operators import sequence_model as sm


def data(n=200, steps=6, inputs=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, steps, inputs))
    y = 2 * np.maximum(x[:, -1, 0] - x[:, -2, 0], 0) + 0.5 * x[:, 2, 1]
    return x, y


def frame(spark, x, y, held=lambda i: i % 4 == 0):
    rows = [([float(v) for v in r.ravel()], float(t), held(i)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "s array<double>, y double, held boolean")


def test_gradient_equals_finite_differences():
    x, y = data(30)
    model = sm.SequenceModel.start(6, 2, 3, 3, seed=1)
    _, grad = model.gradient(x, y, 0.7)
    base = model.weights.copy()
    for i in range(len(base)):
        losses = []
        for step in (1e-6, -1e-6):
            model.weights = base + step * (np.arange(len(base)) == i)
            losses.append(model.gradient(x, y, 0.7)[0])
        assert abs((losses[0] - losses[1]) / 2e-6 - grad[i]) < 1e-3 * max(1, abs(grad[i]))


def test_nothing_sees_a_later_step():
    x, _ = data(5)
    model = sm.SequenceModel.start(6, 2, 4, 3, seed=2)
    changed = x.copy()
    changed[:, 4:] += 10
    assert np.array_equal(model._forward(x)[1][:, :4], model._forward(changed)[1][:, :4]) and not np.array_equal(model._forward(x)[1][:, 4:], model._forward(changed)[1][:, 4:])


def test_training(spark):
    x, y = data(400)
    df = frame(spark, x, y)
    fits = [sm.fit(df.repartition(k), "s", "y", "held", 6, 2, filters=6, epochs=25, rate=0.05) for k in (1, 8)]
    assert np.allclose(fits[0].weights, fits[1].weights, atol=1e-6)
    losses = fits[0].losses
    assert losses[-1][0] < 0.3 * losses[0][0] and losses[-1][1] < 0.4 * losses[0][1]
    got = sm.predict(df, fits[0], "s").toPandas()
    assert np.allclose(got.prediction, fits[0].predict(np.stack(got.s.map(list)).reshape(-1, 6, 2)))


def test_one_step_sums_over_all_rows(spark):
    x, y = data(101)
    model = sm.SequenceModel.start(6, 2, 3, 2, seed=3)
    df = frame(spark, x, y).selectExpr("s as sequence", "y as label", "held").repartition(5)
    sums, grad = sm.step_sums(df, model, 1.0)
    held = np.arange(101) % 4 == 0
    loss, want = model.gradient(x[~held], y[~held], 1.0)
    assert np.allclose(grad, want) and np.allclose(sums, [[loss, (~held).sum()], [model.gradient(x[held], y[held], 1.0)[0], held.sum()]])


def test_odd_rows(spark):
    schema = "s array<double>, y double, held boolean"
    none = sm.fit(spark.createDataFrame([], schema), "s", "y", "held", 2, 1, epochs=2)
    assert none.predict(np.ones((1, 2, 1))).tolist() == [0.0]
    rows = spark.createDataFrame([([1.0, None], 1.0, False), ([1.0], 2.0, False), (None, 3.0, None), ([2.0, float("nan")], None, False), ([1.0, 0.0], 1.0, None)], schema)
    model = sm.fit(rows, "s", "y", "held", 2, 1, filters=2, epochs=3)
    assert np.isfinite(model.weights).all() and [r.prediction is None for r in sm.predict(rows, model, "s").collect()] == [False, True, True, False, False]
    assert [np.isnan(v) for _, v in model.losses] == [True] * 3


@pytest.mark.parametrize("kernel", [1, 2, 5])
def test_kernels(kernel):
    x, y = data(10)
    assert sm.SequenceModel.start(6, 2, 3, kernel, 0).predict(x).shape == (10,)
