"""Forecasts: additive Holt-Winters for each key, Spark ML regressors, stacking, and cluster forecasts handed down to keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.metrics import all_metrics
from tidegrid.operators.features import lag_array
from tidegrid.sources.io import scratch

SEASON = 24


#: Level and trend before the first value, and the first season's seasonal parts.
Start = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mean_start(y: np.ndarray, m: int) -> Start:
    """A start from the means of the first two seasons."""
    return y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m, y[:m] - y[:m].mean()


def _smooth(y: np.ndarray, m: int, params: np.ndarray, start: Start | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared error, one-step fits, and last level, trend and seasons of each row (alpha, beta, gamma) of ``params``."""
    alpha, beta, gamma = params.T
    level0, trend0, season0 = _mean_start(y, m) if start is None else start
    level, trend = np.full(len(params), level0), np.full(len(params), trend0)
    season = np.repeat(np.asarray(season0)[:, None], len(params), axis=1)
    fits = np.empty((len(y), len(params)))
    sse = np.zeros(len(params))
    for t, v in enumerate(y):
        s = season[t % m]
        fits[t] = level + trend + s
        sse += (v - fits[t]) ** 2
        grown = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (grown - level) + (1 - beta) * trend
        season[t % m] = gamma * (v - grown) + (1 - gamma) * s
        level = grown
    return sse, fits, level, trend, season


def _grid_search(y: np.ndarray, m: int) -> np.ndarray:
    """The best smoothing parameters from a start of means: a grid, then two finer ones around its best."""
    centre, width, steps = np.array([0.4, 0.2, 0.3]), np.array([0.39, 0.19, 0.29]), 5
    for _ in range(3):
        axes = [np.unique(np.clip(np.linspace(c - w, c + w, steps), 0.0, 0.99)) for c, w in zip(centre, width, strict=True)]
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)
        k = int(np.nan_to_num(_smooth(y, m, grid)[0], nan=np.inf).argmin())
        centre, width = grid[k], width / steps * 1.5
    return centre


def least_squares_start(y: np.ndarray, m: int, params: np.ndarray) -> tuple[np.ndarray, list[Start]]:
    """For each row of ``params`` the start with the least squared error, and that error.

    At given parameters the one-step errors are linear in the start: they are those of a start of zeros plus
    multiples of what each part of the start alone adds. Only the products of these summed over the series are
    kept, so memory doesn't grow with its length. Seasonal parts sum to 0, since the level holds their mean.
    """
    n, k = len(params), m + 2
    alpha, beta, gamma = (p[:, None] for p in params.T)
    # Columns: the series from a start of zeros, then level, trend and all seasonal parts but the last alone.
    level, trend, season = np.zeros((n, k)), np.zeros((n, k)), np.zeros((m, n, k))
    level[:, 1] = trend[:, 2] = 1.0
    for i in range(m - 1):
        season[i, :, 3 + i], season[m - 1, :, 3 + i] = 1.0, -1.0
    products = np.zeros((n, k, k))
    value = np.zeros((1, k))
    for t, v in enumerate(y):
        value[0, 0] = v
        s = season[t % m]
        error = value - level - trend - s
        products += error[:, :, None] * error[:, None, :]
        grown = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (grown - level) + (1 - beta) * trend
        season[t % m] = gamma * (value - grown) + (1 - gamma) * s
        level = grown
    sse, starts = np.full(n, np.inf), []
    for i, p in enumerate(products):
        # Parts that hardly show in the series stay near 0.
        c = np.linalg.lstsq(p[1:, 1:], -p[1:, 0], rcond=1e-12)[0] if np.isfinite(p).all() else np.zeros(k - 1)
        starts.append((c[0], c[1], np.r_[c[2:], -c[2:].sum()]))
        sse[i] = max(p[0, 0] + 2 * c @ p[1:, 0] + c @ p[1:, 1:] @ c, 0.0) if np.isfinite(p).all() else np.inf
    return sse, starts


def fit_holt_winters(y: np.ndarray, m: int = SEASON, start: str = "best") -> tuple[np.ndarray, float, float, np.ndarray]:
    """One-step fits and the final state for the best smoothing parameters.

    ``start``: ``means``; ``estimated``, where the parameters found from means are refined together with the start that
    fits best at each; or ``best``, the one of lower information criterion, as an estimated start has ``m + 1``
    more free numbers. Neither has a larger squared error than ``means``.
    """
    best = _grid_search(y, m)
    found = [(best, None)]
    if start != "means":
        width = np.array([0.3, 0.15, 0.25])
        for _ in range(4):
            axes = [np.unique(np.clip([c - w, c, c + w], 0.0, 0.99)) for c, w in zip(best, width, strict=True)]
            grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)
            sse, starts = least_squares_start(y, m, grid)
            k = int(sse.argmin())
            best, width = grid[k], width / 2.5
            found.append((best, starts[k]))
    runs = [_smooth(y, m, p[None], s) for p, s in found]
    errors = np.nan_to_num([r[0][0] for r in runs], nan=np.inf)
    k = int(errors.argmin())
    if start == "best" and len(y) * np.log(max(errors[0], 1e-300) / max(errors[k], 1e-300)) <= 2 * (m + 1):
        k = 0
    _, fits, level, trend, season = runs[k]
    return fits[:, 0], float(level[0]), float(trend[0]), season[:, 0]


def holt_winters_start(panel: DataFrame, key: str, alpha: float, beta: float, gamma: float, ts: str = "bin", value: str = "demand", season: int = SEASON) -> DataFrame:
    """The start with the least squared error at given smoothing parameters: key, level, trend, season, sse; shorter than two seasons: none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].fillna(0.0).to_numpy(float)
        if len(y) < 2 * season:
            return pd.DataFrame({key: pdf[key].iloc[:0], "level": [], "trend": [], "season": pd.Series([], dtype=object), "sse": []})
        sse, starts = least_squares_start(y, season, np.array([[alpha, beta, gamma]]))
        level, trend, parts = starts[0]
        return pd.DataFrame({key: pdf[key].iloc[:1], "level": level, "trend": trend, "season": [parts.tolist()], "sse": sse})

    kinds = dict(panel.dtypes)
    return panel.select(key, ts, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, level double, trend double, season array<double>, sse double")


def forecast_ahead(level: float, trend: float, season: np.ndarray, start: int, n: int) -> np.ndarray:
    m = len(season)
    return np.array([level + trend * (h + 1) + season[(start + h) % m] for h in range(n)])


def holt_winters(panel: DataFrame, key: str, ts: str = "bin", value: str = "demand", season: int = SEASON, train: float = 0.7, min_rows: int = 72) -> DataFrame:
    """Forecast of each key's last rows from its first ``train`` share: key, bin, actual, prediction, n_train, n_test.

    Keys are fitted independently in Arrow groups; a key has one row for each bin, so a group's size is
    that of the time grid. Keys below ``min_rows`` rows give none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].fillna(0.0).to_numpy(float)
        n_train = min(max(int(len(y) * train), 2 * season), len(y) - 1)
        if len(y) < min_rows or n_train < 2 * season:
            return pd.DataFrame({key: pdf[key].iloc[:0], ts: pdf[ts].iloc[:0], "actual": [], "prediction": [], "n_train": [], "n_test": []})
        past = y[:n_train]
        _, level, trend, seasons = fit_holt_winters(past, season)
        ahead = np.maximum(forecast_ahead(level, trend, seasons, len(past), len(y) - n_train), 0.0)
        rest = pdf.iloc[n_train:]
        return pd.DataFrame({key: rest[key], ts: rest[ts], "actual": y[n_train:], "prediction": ahead, "n_train": n_train, "n_test": len(y) - n_train})

    kinds = dict(panel.dtypes)
    rows = panel.select(key, ts, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, actual double, prediction double, n_train int, n_test int")


def add_holt_winters_feature(panel: DataFrame, key: str, ts: str = "bin", value: str = "demand", season: int = SEASON, train: float = 0.7) -> DataFrame:
    """``panel`` with ``hw_forecast`` and ``hw_fallback``: fits in the train rows, forecasts after them.

    A key too short to fit gets its value a season ago, and is flagged; the actual value is never used.
    """
    names = panel.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].fillna(0.0).to_numpy(float)
        n_train = int(len(y) * train)
        short = len(y) < 3 * season or n_train < 2 * season
        if short:
            out = np.r_[np.zeros(min(season, len(y))), y[: max(0, len(y) - season)]]
        else:
            fits, level, trend, seasons = fit_holt_winters(y[:n_train], season)
            out = np.r_[fits, forecast_ahead(level, trend, seasons, n_train, len(y) - n_train)]
        return pdf[names].assign(hw_forecast=np.maximum(out, 0.0), hw_fallback=short)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return panel.groupBy(key).applyInPandas(run, f"{kinds}, hw_forecast double, hw_fallback boolean")


def smoothed(panel: DataFrame, key: str, alpha: float, beta: float, gamma: float, ts: str = "bin", value: str = "demand", season: int = SEASON) -> DataFrame:
    """One-step fits of each key's whole series at given smoothing parameters: key, bin, fit; shorter than two seasons: none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].fillna(0.0).to_numpy(float)
        if len(y) < 2 * season:
            return pd.DataFrame({key: pdf[key].iloc[:0], ts: pdf[ts].iloc[:0], "fit": []})
        return pd.DataFrame({key: pdf[key], ts: pdf[ts], "fit": _smooth(y, season, np.array([[alpha, beta, gamma]]))[1][:, 0]})

    kinds = dict(panel.dtypes)
    return panel.select(key, ts, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, fit double")


def regressors(label: str, features: str = "features") -> dict:
    """The base learners; their settings are fixed values."""
    return {
        "linear": LinearRegression(featuresCol=features, labelCol=label, maxIter=50, regParam=0.1, elasticNetParam=0.0, aggregationDepth=3),
        "forest": RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=30, maxDepth=6, maxBins=32, seed=42),
        "boosted": GBTRegressor(featuresCol=features, labelCol=label, maxIter=40, maxDepth=5, stepSize=0.05, subsamplingRate=0.7, seed=42),
        "sampled": GBTRegressor(featuresCol=features, labelCol=label, maxIter=10, maxDepth=5, stepSize=0.03, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=42),
    }


def train_and_score(train: DataFrame, test: DataFrame, inputs: Sequence[str], label: str, models: Iterable[str] = ("linear", "forest", "boosted")) -> dict[str, DataFrame]:
    """Predictions of each model for ``test``, at least 0."""
    out, known = {}, regressors(label)
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip")
    for name in models:
        fitted = Pipeline(stages=[assembler, known[name]]).fit(train)
        out[name] = fitted.transform(test).withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0))).drop("features")
    return out


def model_metrics(predictions: dict[str, DataFrame], label: str) -> DataFrame:
    """(model, n, mae, rmse, mape, smape, wmape, r2), one row for each model, best MAPE first."""
    y, p = F.col(label), F.col("prediction")
    frames = [df.agg(F.count(F.lit(1)).alias("n"), *all_metrics(y, p)).select(F.lit(name).alias("model"), "*") for name, df in predictions.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.col("mape").asc_nulls_last(), "model")


def stack(first: DataFrame, second: DataFrame, keys: Sequence[str], label: str, fit_on: str, split: str = "split") -> DataFrame:
    """Ridge regression on two base predictions, fitted on one split; that split's own rows are marked in-sample."""
    base = first.select(*keys, split, label, F.col("prediction").alias("p1")).join(second.select(*keys, F.col("prediction").alias("p2")), list(keys))
    rows = VectorAssembler(inputCols=["p1", "p2"], outputCol="features").transform(base)
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=1.0, elasticNetParam=0.0).fit(rows.where(F.col(split) == fit_on))
    return model.transform(rows).select(*keys, split, label, "p1", "p2", F.greatest("prediction", F.lit(0.0)).alias("prediction"), (F.col(split) == fit_on).alias("in_sample"))


def search(train: DataFrame, inputs: Sequence[str], label: str, kind: str, grid: Mapping[str, Sequence], folds: int = 3, draws: int | None = None, seed: int = 42):
    """Cross-validated search over a learner's parameters: all of ``grid``, or ``draws`` settings of it by chance.

    Returns the best fitted pipeline, its settings, and how many settings were tried.
    """
    learner = regressors(label)[kind]
    settings = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    if draws is not None and draws < len(settings):
        settings = [settings[i] for i in sorted(np.random.default_rng(seed).choice(len(settings), draws, replace=False).tolist())]
    maps = [{learner.getParam(name): v for name, v in s.items()} for s in settings]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip"), learner])
    tuned = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, seed=seed).fit(train)
    return tuned.bestModel, settings[int(np.argmin(tuned.avgMetrics))], len(settings)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tuned_forest(train: DataFrame, inputs: Sequence[str], label: str, depths: Sequence[int] = (3, 5), trees: Sequence[int] = (10,), folds: int = 3):
    """Cross-validated random forest and its importances, as (name, importance) from the largest."""
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="skip")
    forest = RandomForestRegressor(featuresCol="features", labelCol=label, seed=42)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    tuned = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, seed=42).fit(assembler.transform(train))
    weights = tuned.bestModel.featureImportances.toArray()
    return tuned.bestModel, sorted(zip(inputs, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))


def lag_dataset(series: DataFrame, key: str, value: str, n: int, ts: str = "bin") -> DataFrame:
    """Rows with all of ``n`` lags, newest first, as an array and as columns l1..ln, and the row's index."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = series.withColumns({"history": lag_array(value, n, w), "idx": F.row_number().over(w)}).where(F.col("idx") > n)
    return rows.withColumns({f"l{k}": F.col("history")[k - 1].cast("double") for k in range(1, n + 1)})


def chronological(rows: DataFrame, key: str, train: float = 0.8, ts: str = "bin") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return rows.withColumn("split", F.when(rn <= F.floor(n * train), "train").otherwise("test"))


def cluster_forecast(series: DataFrame, cluster: str, value: str, n: int = 12, ts: str = "bin", trees: int = 20, depth: int = 6) -> DataFrame:
    """One forest over scaled lags for each cluster; whole, non-negative predictions of the last fifth of its rows."""
    made = chronological(lag_dataset(series, cluster, value, n, ts), cluster, ts=ts)
    path = scratch(series.sparkSession, "cluster-lags")
    made.write.parquet(path)  # once, for all clusters' fits and for whoever reads the forecast
    rows = series.sparkSession.read.schema(made.schema).parquet(path)
    assembler = VectorAssembler(inputCols=[f"l{k}" for k in range(1, n + 1)], outputCol="raw")
    out = None
    for name in sorted(r[0] for r in rows.select(cluster).distinct().collect()):  # clusters are few by their making
        own = rows.where(F.col(cluster) == name)
        forest = RandomForestRegressor(featuresCol="features", labelCol=value, numTrees=trees, maxDepth=depth, seed=42)
        model = Pipeline(stages=[assembler, MinMaxScaler(inputCol="raw", outputCol="features"), forest]).fit(own.where("split = 'train'"))
        got = model.transform(own.where("split = 'test'")).select(cluster, ts, F.col(value).alias("actual"), F.greatest(F.round("prediction"), F.lit(0.0)).alias("prediction"))
        out = got if out is None else out.unionByName(got)
    return out


def stitch(history: DataFrame, predicted: DataFrame, cluster: str, value: str, ts: str = "bin") -> DataFrame:
    """Actual values, with predicted ones wherever there are any."""
    p = predicted.select(cluster, ts, F.col("prediction").alias("_p"))
    return history.join(p, [cluster, ts], "left").withColumn(value, F.coalesce("_p", F.col(value).cast("double"))).drop("_p")


def _grow(x: np.ndarray, gram: np.ndarray, drawn: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple:
    """A tree of (feature, cut, low, high) over leaves, which are the rows of ``drawn`` in them; a split lowers the summed squares of all outputs most.

    ``gram`` holds the outputs' products of each two rows, which is all that splits depend on.
    """
    best = None
    if depth and len(drawn) >= 2 * least:
        own = gram[np.ix_(drawn, drawn)]
        total = own.sum()
        spread = np.diag(own).sum() - total / len(drawn)
        for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 3)].tolist() if spread > 1e-9 * max(abs(total), 1e-300) / len(drawn) else ():
            order = np.argsort(x[drawn, f], kind="stable")
            v = x[drawn[order], f]
            sorted_ = own[np.ix_(order, order)]
            upto = np.cumsum(2 * np.tril(sorted_).sum(axis=1) - np.diag(sorted_))[:-1]  # squares of the sums of the first rows
            with_all = np.cumsum(sorted_.sum(axis=1))[:-1]
            n = np.arange(1, len(drawn))
            gain = upto / n + (total - 2 * with_all + upto) / (len(drawn) - n)
            gain[(v[1:] == v[:-1]) | (n < least) | (len(drawn) - n < least)] = -np.inf
            k = int(gain.argmax())
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    if best is None:
        return (drawn,)
    low = x[drawn, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, gram, drawn[low], rng, depth - 1, least), _grow(x, gram, drawn[~low], rng, depth - 1, least))


def _leaves(tree: tuple, x: np.ndarray, of: Callable[[np.ndarray], np.ndarray], out: np.ndarray, at: np.ndarray) -> None:
    """Add to each row of ``out`` what ``of`` says of the learned rows in its leaf."""
    if len(tree) == 1:
        out[at] += of(tree[0])
        return
    low = x[at, tree[0]] <= tree[1]
    _leaves(tree[2], x, of, out, at[low])
    _leaves(tree[3], x, of, out, at[~low])


def _forest(x: np.ndarray, gram: np.ndarray, ahead: np.ndarray, of: Callable[[np.ndarray], np.ndarray], width: int, trees: int, depth: int, least: int, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), np.zeros((len(ahead), width))
    for _ in range(trees):
        _leaves(_grow(x, gram, rng.integers(0, len(x), len(x)), rng, depth, least), ahead, of, out, np.arange(len(ahead)))
    return out / trees


def forest_weights(x: np.ndarray, gram: np.ndarray, ahead: np.ndarray, trees: int, depth: int, least: int = 1, seed: int = 42) -> np.ndarray:
    """What each row of ``x`` counts for in the mean prediction of ``trees`` bagged trees for each row of ``ahead``, whatever the outputs' number."""
    return _forest(x, gram, ahead, lambda leaf: np.bincount(leaf, minlength=len(x)) / len(leaf), len(x), trees, depth, least, seed)


def multi_forest(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, trees: int, depth: int, least: int = 1, seed: int = 42) -> np.ndarray:
    """Mean prediction of ``trees`` bagged trees that share their splits among all columns of ``y``."""
    return _forest(x, y @ y.T, ahead, lambda leaf: y[leaf].mean(axis=0), y.shape[1], trees, depth, least, seed)


#: Cells of all clusters' matrices of products that are gathered.
MAX_GRAM_CELLS = 12_000_000


def disaggregate(keys: DataFrame, stitched: DataFrame, key: str, cluster: str, value: str, n: int = 12, ts: str = "bin", trees: int = 50, depth: int = 10) -> DataFrame:
    """Each key's value from its cluster's history: one multi-output forest for each cluster, learned on the first 80 % of its bins.

    The history holds ``n`` cluster values newest first. A forest's splits depend on its outputs, the keys, only by the products of
    each two bins over all keys, and its predictions are the same weighted means of bins for every key. So one pass sums
    each cluster's matrix of bins x bins, forests are grown from that, and a second pass applies their weights to each key's row.
    No task holds more than a part of a cluster's keys, and what is gathered depends on the bins alone, of which there
    may be as many as give ``MAX_GRAM_CELLS``. A key without a row in a bin counts as 0 there and gets no row.
    """
    spark, kinds = keys.sparkSession, dict(keys.dtypes)
    past = lag_dataset(stitched, cluster, value, n, ts).select(cluster, ts, F.col("history").cast("array<double>").alias("history"))
    rows = keys.select(key, cluster, ts, F.col(value).cast("double").alias(value)).join(past, [cluster, ts])
    path = scratch(spark, "disaggregate")
    rows.select(key, cluster, ts, F.coalesce(value, F.lit(0.0)).alias(value), "history").write.parquet(path)
    rows = spark.read.parquet(path)
    bins = rows.groupBy(cluster, ts).agg(F.first("history").alias("history"))
    bins = bins.withColumn("at", F.row_number().over(Window.partitionBy(cluster).orderBy(ts)) - 1)
    sizes = bins.groupBy(cluster).count().collect()  # clusters are few by their making
    if sum(r["count"] ** 2 for r in sizes) > MAX_GRAM_CELLS:
        raise ValueError("too many bins for matrices of bins x bins; resample first")
    histories: dict = {}
    for r in bins.orderBy(cluster, "at").collect():
        histories.setdefault(r[cluster], []).append(r["history"])
    pairs = rows.join(bins.select(cluster, ts, "at"), [cluster, ts]).groupBy(cluster, key, "at").agg(F.sum(value).alias("v"))
    vectors = pairs.groupBy(cluster, key).agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v"))
    path = scratch(spark, "disaggregate-rows")
    vectors.write.parquet(path)
    vectors = spark.read.schema(vectors.schema).parquet(path)
    lengths = {c: len(h) for c, h in histories.items()}

    def dense(batch: pa.RecordBatch) -> Iterator[tuple[int, object, np.ndarray]]:
        for i, (c, at, v) in enumerate(zip(batch.column(cluster).to_pylist(), batch.column("at").to_pylist(), batch.column("v").to_pylist(), strict=True)):
            row = np.zeros(lengths[c])
            row[at] = v
            yield i, c, row

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for _, c, row in dense(batch):
                own = row[: int(lengths[c] * 0.8)]
                sums.setdefault(c, np.zeros((len(own), len(own))))
                sums[c] += np.outer(own, own)
        flat = [(names.index(c), i, m[i]) for c, m in sums.items() for i in range(len(m))]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.list_(pa.float64()))], ["c", "i", "row"])

    names = list(histories)
    found = vectors.mapInArrow(products, "c long, i long, row array<double>").select("c", "i", F.posexplode("row").alias("j", "v")).groupBy("c", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    weights = {}
    for k, c in enumerate(names):
        cut, x, own = int(lengths[c] * 0.8), np.array(histories[c], float).reshape(lengths[c], n), found[found["c"] == k]
        gram = np.zeros((cut, cut))
        gram[own["i"], own["j"]] = own["v"]
        weights[c] = forest_weights(x[:cut], gram, x[cut:], trees, depth) if cut else np.zeros((lengths[c], 0))
    sent = spark.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, at, got = [], [], []
            for i, c, row in dense(batch):
                cut = int(lengths[c] * 0.8)
                ahead = np.maximum(np.round(sent.value[c] @ row[:cut]), 0.0)
                late = [a for a in batch.column("at")[i].as_py() if a >= cut]
                origin += [i] * len(late)
                at += late
                got += ahead[np.array(late, np.int64) - cut].tolist()
            take = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(take), batch.column(cluster).take(take), pa.array(at, pa.int64()), pa.array(got, pa.float64())], [key, cluster, "at", "prediction"])

    predicted = vectors.select(key, cluster, F.col("at").cast("array<bigint>").alias("at"), "v").mapInArrow(apply, f"`{key}` {kinds[key]}, `{cluster}` {kinds[cluster]}, at long, prediction double")
    named = predicted.join(bins.select(cluster, ts, F.col("at").cast("long").alias("at")), [cluster, "at"]).select(key, cluster, ts, "prediction")
    return rows.join(named, [key, cluster, ts]).select(key, cluster, ts, F.col(value).alias("actual"), "prediction")
