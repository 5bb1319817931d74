"""Queries that fit models: checked by invariants and synthetic series in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import cluster as cu
from tidegrid.operators import forecast as fc
from tidegrid.operators import kshape as ks
from tidegrid.operators.features import by_time, ewma, lags, trailing
from tidegrid.operators.splits import rank_split
from tidegrid.plans.panel_queries import NATIONS_SQL, nation_series
from tidegrid.plans.registry import PANEL_SQL, panel, query, r, table
from tidegrid.sources import io

INPUTS = ["lag_1", "lag_2", "lag_3", "lag_24", "roll_mean_18", "ewma_60", "hour", "dow"]


def feature_rows(spark, sf_dir):
    w = by_time("event_type")
    rows = panel(spark, sf_dir).withColumns(lags("demand", [1, 2, 3, 24], w) | {"roll_mean_18": F.avg("demand").over(trailing(w, 18)), "ewma_60": ewma("demand", w), "hour": F.hour("bin"), "dow": F.dayofweek("bin")})
    return rank_split(rows.dropna(), "event_type")


@query()
def holt_winters(spark, sf_dir):
    return fc.holt_winters(panel(spark, sf_dir), "event_type")


@query()
def holt_winters_feature(spark, sf_dir):
    return fc.add_holt_winters_feature(panel(spark, sf_dir), "event_type")


@query()
def regressors(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    return fc.model_metrics(fc.train_and_score(rows.where("split = 'train'"), rows.where("split = 'test'"), INPUTS, "demand"), "demand")


@query()
def stacked_ensemble(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    idx = F.col("rn") / F.col("n_key")
    rows = rows.withColumn("split", F.when(idx <= 0.6, "train").when(idx <= 0.8, "validation").otherwise("test"))
    base = fc.train_and_score(rows.where("split = 'train'"), rows.where("split <> 'train'"), INPUTS, "demand", ["linear", "forest"])
    return fc.stack(base["linear"], base["forest"], ["event_type", "bin"], "demand", fit_on="validation")


@query()
def tuned_regressor(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    _, weights = fc.tuned_forest(rows.where("split = 'train'"), INPUTS, "demand")
    return spark.createDataFrame(weights, "feature string, importance double")


@query()
def sequence_model(spark, sf_dir):
    """Demand from the 24 bins before, scaled by the train rows' moments, by a causal convolution and a dense layer."""
    from tidegrid.operators import sequence_model as sm
    from tidegrid.operators.features import sequence_windows

    rows = rank_split(sequence_windows(panel(spark, sf_dir), ["demand"], 24, by_time("event_type")), "event_type")
    mean, deviation = rows.where("split = 'train'").agg(F.avg("demand"), F.stddev_pop("demand")).first()
    rows = rows.select("event_type", "bin", "demand", "split", F.transform(F.flatten("sequence"), lambda v: (v - mean) / deviation).alias("sequence"), ((F.col("demand") - mean) / deviation).alias("scaled"))
    path = io.scratch(spark, "sequences")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    model = sm.fit(rows.withColumn("held", F.col("split") == "test"), "sequence", "scaled", "held", 24, 1, filters=8, epochs=12, rate=0.02)
    ahead = sm.predict(rows.where("split = 'test'"), model, "sequence")
    return ahead.select("event_type", "bin", "demand", F.greatest(F.col("prediction") * deviation + mean, F.lit(0.0)).alias("prediction"))


@query()
def kmeans_zones(spark, sf_dir):
    return cu.kmeans(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("zone")), ["zone"], k=5)


def dense_nations(spark, sf_dir):
    """Each nation's months from the first to the last of all, without orders 0."""
    s = nation_series(spark, sf_dir)
    lo, hi = s.agg(F.min("bin")).scalar(), s.agg(F.max("bin")).scalar()
    grid = s.select("zone").distinct().select("zone", F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("bin"))
    return grid.join(s.select("zone", "bin", "demand"), ["zone", "bin"], "left").select("bin", "zone", F.coalesce("demand", F.lit(0.0)).alias("demand"))


@query()
def kshape(spark, sf_dir):
    return ks.kshape(dense_nations(spark, sf_dir), "zone", k=3)


@query()
def kernel_pca_clusters(spark, sf_dir):
    return cu.kernel_pca_clusters(dense_nations(spark, sf_dir), "zone", k=3)


def grouped(spark, sf_dir):
    keys = nation_series(spark, sf_dir)
    return keys, keys.groupBy("cluster_id", "bin").agg(F.sum("demand").alias("demand"))


@query()
def cluster_forecast(spark, sf_dir):
    return fc.cluster_forecast(grouped(spark, sf_dir)[1], "cluster_id", "demand")


@query()
def disaggregate(spark, sf_dir):
    keys, clusters = grouped(spark, sf_dir)
    stitched = fc.stitch(clusters, fc.cluster_forecast(clusters, "cluster_id", "demand"), "cluster_id", "demand")
    return fc.disaggregate(keys, stitched, "zone", "cluster_id", "demand")


# What of a fitted model is determined, beside SQL: rows, splits, flags and bounds of the queries above.


@query(PANEL_SQL + ", n as (select event_type, count(*) as n, greatest(floor(count(*) * 0.7::double), 48)::int as n_train from d group by 1) select event_type, n_train, (n - n_train)::int as n_test, (n - n_train)::bigint as n_rows, true as non_negative, (select min(bin) from d) + n_train * interval '1 hour' as first_bin from n")
def holt_winters_facts(spark, sf_dir):
    out = holt_winters(spark, sf_dir)
    return out.groupBy("event_type").agg(F.max("n_train").alias("n_train"), F.max("n_test").alias("n_test"), F.count("prediction").alias("n_rows"), F.every(F.col("prediction") >= 0).alias("non_negative"), F.min("bin").alias("first_bin"))


@query(PANEL_SQL + "select event_type, count(*) as n_rows, false as hw_fallback, true as non_negative, sum(demand) as demand from d group by 1")
def holt_winters_feature_facts(spark, sf_dir):
    out = holt_winters_feature(spark, sf_dir)
    return out.groupBy("event_type").agg(F.count("hw_forecast").alias("n_rows"), F.bool_or("hw_fallback").alias("hw_fallback"), F.every(F.col("hw_forecast") >= 0).alias("non_negative"), F.sum("demand").alias("demand"))


@query(f"""with recursive {PANEL_SQL[5:]}, y as (select event_type, list(demand order by bin) as y, list(bin order by bin) as b from d group by 1),
i as (select *, list_avg(y[1:24]) as l0, (list_avg(y[25:48]) - list_avg(y[1:24])) / 24 as t0, list_transform(y[1:24], lambda v: v - list_avg(y[1:24])) as s0 from y),
h as (select event_type, y, b, 0 as t, l0 as level, t0 as trend, s0 as season, 0.0::double as fit from i
  union all
  select event_type, y, b, t + 1, grown, 0.2 * (grown - level) + 0.8 * trend, list_concat(list_concat(season[1:k], [0.3 * (y[t + 1] - grown) + 0.7 * season[k + 1]]), season[k + 2:24]), level + trend + season[k + 1]
  from (select *, t % 24 as k, 0.4 * (y[t + 1] - season[t % 24 + 1]) + 0.6 * (level + trend) as grown from h where t < len(y)))
select event_type, b[t] as bin, round(fit, 6) as fit from h where t > 0""")
def smoothed(spark, sf_dir):
    """Holt-Winters at given parameters, one step ahead."""
    return fc.smoothed(panel(spark, sf_dir), "event_type", 0.4, 0.2, 0.3).withColumn("fit", r("fit"))


@query(f"""with recursive {PANEL_SQL[5:]}, y as (select event_type, list(demand order by bin) as y from d group by 1),
h as (select event_type, y, r, 0 as t, (r = 1)::int::double as level, (r = 2)::int::double as trend, (r = 3)::int::double as s_now, -(r = 3)::int::double as s_next, 0.0::double as e from y, range(4) x(r)
  union all
  select event_type, y, r, t + 1, grown, 0.2 * (grown - level) + 0.8 * trend, s_next, 0.3 * (v - grown) + 0.7 * s_now, v - level - trend - s_now
  from (select *, 0.4 * (v - s_now) + 0.6 * (level + trend) as grown from (select *, case when r = 0 then y[t + 1] else 0 end as v from h where t < len(y)))),
e as (select event_type, t, sum(e) filter (r = 0) as e0, sum(e) filter (r = 1) as e1, sum(e) filter (r = 2) as e2, sum(e) filter (r = 3) as e3 from h where t > 0 group by 1, 2),
q as (select event_type, sum(e1*e1) as a, sum(e1*e2) as b, sum(e1*e3) as c, sum(e2*e2) as d, sum(e2*e3) as f, sum(e3*e3) as g, -sum(e0*e1) as u, -sum(e0*e2) as v, -sum(e0*e3) as w, sum(e0*e0) as z from e group by 1),
x as (select *, a*(d*g-f*f) - b*(b*g-f*c) + c*(b*f-d*c) as det from q),
s as (select *, (u*(d*g-f*f) - b*(v*g-f*w) + c*(v*f-d*w)) / det as l, (a*(v*g-f*w) - u*(b*g-f*c) + c*(b*w-v*c)) / det as k, (a*(d*w-v*f) - b*(b*w-v*c) + u*(b*f-d*c)) / det as p from x)
select event_type, round(l, 5) as level, round(k, 5) as trend, round(p, 5) as season_1, round(-p, 5) as season_2, round(z - l*u - k*v - p*w, 4) as sse from s""")
def holt_winters_start(spark, sf_dir):
    """The start of level, trend and a season of two bins that fits best at given parameters."""
    out = fc.holt_winters_start(panel(spark, sf_dir), "event_type", 0.4, 0.2, 0.3, season=2)
    return out.select("event_type", r("level", 5).alias("level"), r("trend", 5).alias("trend"), F.round(F.col("season")[0], 5).alias("season_1"), F.round(F.col("season")[1], 5).alias("season_2"), r("sse", 4).alias("sse"))


ROWS_SQL = PANEL_SQL + ", f as (select *, row_number() over (partition by event_type order by bin) - 24 as rn, count(*) over (partition by event_type) - 24 as n from d), "


def _ridge_sql(rows: str, name: str, penalty: float) -> str:
    """SQL of ridge regression of y on x1 and x2 over ``rows``, by its normal equations; the penalty is on inputs and label of deviation 1."""
    return f"""{name}_m as (select count(*)::double as n, avg(x1) as a1, avg(x2) as a2, avg(y) as ay, var_pop(x1) as v1, var_pop(x2) as v2, stddev_pop(y) as sy from {rows}),
{name}_c as (select sum((x1 - a1) * (x1 - a1)) / any_value(n) + {penalty} / any_value(sy) * any_value(v1) as s11, sum((x2 - a2) * (x2 - a2)) / any_value(n) + {penalty} / any_value(sy) * any_value(v2) as s22, sum((x1 - a1) * (x2 - a2)) / any_value(n) as s12, sum((x1 - a1) * (y - ay)) / any_value(n) as b1, sum((x2 - a2) * (y - ay)) / any_value(n) as b2 from {rows}, {name}_m),
{name} as (select (b1 * s22 - b2 * s12) / (s11 * s22 - s12 * s12) as w1, (b2 * s11 - b1 * s12) / (s11 * s22 - s12 * s12) as w2 from {name}_c),
{name}_w as (select w1, w2, ay - w1 * a1 - w2 * a2 as w0 from {name}, {name}_m)"""


_PAIR_SQL = PANEL_SQL + """, f as (select event_type, bin, demand as y, lag(demand, 1) over w as x1, lag(demand, 24) over w as x2, row_number() over w - 24 as rn, count(*) over (partition by event_type) - 24 as n from d window w as (partition by event_type order by bin)),
pr as (select event_type, bin, y, x1, x2, case when rn / n <= 0.6 then 'train' when rn / n <= 0.8 then 'validation' else 'test' end as split from f where rn > 0),
v as (select * from pr where split = 'validation'), """


@query(_PAIR_SQL + _ridge_sql("t", "q", 0.1).replace("q_m as", "t as (select * from pr where split = 'train'), q_m as", 1) + " select round(w0, 5) as intercept, round(w1, 6) as lag_1, round(w2, 6) as lag_24 from q_w")
def linear_weights(spark, sf_dir):
    """The linear learner's weights on two lags."""
    from pyspark.ml.feature import VectorAssembler

    rows = _pair_rows(spark, sf_dir).where("split = 'train'")
    model = fc.regressors("demand")["linear"].fit(VectorAssembler(inputCols=["lag_1", "lag_24"], outputCol="features").transform(rows))
    w = [float(x) for x in model.coefficients]
    return spark.createDataFrame([(round(float(model.intercept), 5), round(w[0], 6), round(w[1], 6))], "intercept double, lag_1 double, lag_24 double")


@query(_PAIR_SQL + _ridge_sql("v", "q", 1.0) + " select event_type, bin, split, round(greatest(w0 + w1 * x1 + w2 * x2, 0), 5) as prediction, split = 'validation' as in_sample from pr, q_w")
def stacked_lags(spark, sf_dir):
    """Two base forecasts, the demand a bin and a season ago, stacked by ridge regression on the validation rows."""
    rows = _pair_rows(spark, sf_dir)
    first, second = (rows.withColumn("prediction", F.col(c)) for c in ("lag_1", "lag_24"))
    out = fc.stack(first, second, ["event_type", "bin"], "demand", fit_on="validation")
    return out.select("event_type", "bin", "split", r("prediction", 5).alias("prediction"), "in_sample")


def _pair_rows(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    idx = F.col("rn") / F.col("n_key")
    return rows.select("event_type", "bin", "demand", "lag_1", "lag_24", F.when(idx <= 0.6, "train").when(idx <= 0.8, "validation").otherwise("test").alias("split"))


@query(ROWS_SQL + "x as (select count(*) as n from f where rn > floor(n * 0.7)) select unnest(['linear', 'forest', 'boosted', 'sampled']) as model, n, true as sound from x")
def regressors_facts(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    rows = rows.select("event_type", "bin", "demand", "split", *[c for c in INPUTS])
    out = fc.model_metrics(fc.train_and_score(rows.where("split = 'train'"), rows.where("split = 'test'"), INPUTS, "demand", ["linear", "forest", "boosted", "sampled"]), "demand")
    return out.select("model", "n", ((F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)).alias("sound"))


@query(ROWS_SQL + "x as (select case when rn / n <= 0.6 then 'train' when rn / n <= 0.8 then 'validation' else 'test' end as split from f where rn > 0) select split, split = 'validation' as in_sample, count(*) as n, true as non_negative from x where split <> 'train' group by 1, 2")
def stacked_facts(spark, sf_dir):
    return stacked_ensemble(spark, sf_dir).groupBy("split", "in_sample").agg(F.count("prediction").alias("n"), F.every(F.col("prediction") >= 0).alias("non_negative"))


@query(f"select unnest({INPUTS}) as feature, true as shared, 1.0::double as total")
def tuned_facts(spark, sf_dir):
    out = tuned_regressor(spark, sf_dir)
    return out.select("feature", F.col("importance").between(0, 1).alias("shared"), F.round(out.agg(F.sum("importance")).scalar(), 6).alias("total"))


@query("select unnest(['linear', 'forest', 'boosted']) as model, unnest([4, 2, 3])::int as settings, true as best_of_grid")
def model_searches(spark, sf_dir):
    """Searches over each learner: whole grids, and draws from one."""
    rows = feature_rows(spark, sf_dir).where("split = 'train'").select(*INPUTS, "demand").persist()
    grids = {
        "linear": ({"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, None),
        "forest": ({"maxDepth": [3, 5], "numTrees": [5]}, None),
        "boosted": ({"maxDepth": [2, 3], "maxIter": [3, 5], "stepSize": [0.05, 0.1]}, 3),
    }
    found = []
    try:
        for kind, (grid, draws) in grids.items():
            model, best, n = fc.search(rows, INPUTS, "demand", kind, grid, folds=2, draws=draws)
            found.append((kind, n, all(v in grid[k] and model.stages[-1].getOrDefault(k) == v for k, v in best.items())))
    finally:
        rows.unpersist()
    return spark.createDataFrame(found, "model string, settings int, best_of_grid boolean")


@query(ROWS_SQL + "x as (select event_type, count(*) as n from f where rn > floor(n * 0.7) group by 1) select event_type, n, 0.0::double as gap from x")
def saved_model(spark, sf_dir):
    """A fitted pipeline is saved and loaded, and predicts as before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = feature_rows(spark, sf_dir)
    model = Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), fc.regressors("demand")["linear"]]).fit(rows.where("split = 'train'"))
    path = io.scratch(spark, "model")
    fc.save_model(model, path)
    test = rows.where("split = 'test'")
    both = fc.load_model(path).transform(model.transform(test).withColumnRenamed("prediction", "before").drop("features"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prediction") - F.col("before"))).alias("gap"))


@query("select count(*) as n, 5::bigint as clusters from customer")
def kmeans_facts(spark, sf_dir):
    return kmeans_zones(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters"))


@query(NATIONS_SQL + "select method, zone, true as placed from (select distinct zone from s), (select unnest(['kshape', 'kernel_pca']) as method)")
def cluster_facts(spark, sf_dir):
    out = None
    for name, found in (("kshape", kshape(spark, sf_dir)), ("kernel_pca", kernel_pca_clusters(spark, sf_dir))):
        part = found.select(F.lit(name).alias("method"), "zone", F.col("cluster_id").between(0, 2).alias("placed"))
        out = part if out is None else out.unionByName(part)
    return out


_LATE = "l as (select cluster_id, bin, row_number() over (partition by cluster_id order by bin) - 12 as idx, count(*) over (partition by cluster_id) - 12 as n from c)"


@query(NATIONS_SQL + f", c as (select cluster_id, bin, sum(demand) as demand from s group by 1, 2), {_LATE} select cluster_id, count(*) as n, min(bin) as first_bin, true as whole from l where idx > floor(n * 0.8) group by 1")
def cluster_forecast_facts(spark, sf_dir):
    whole = (F.col("prediction") >= 0) & (F.col("prediction") == F.round("prediction"))
    return cluster_forecast(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("first_bin"), F.every(whole).alias("whole"))


@query(NATIONS_SQL + f", c as (select cluster_id, bin, sum(demand) as demand from s group by 1, 2), {_LATE}, t as (select cluster_id, bin from l where idx > floor(n * 0.8)) select s.zone, count(*) as n, sum(s.demand) as actual, true as whole from s join t using (cluster_id, bin) group by 1")
def disaggregate_facts(spark, sf_dir):
    whole = (F.col("prediction") >= 0) & (F.col("prediction") == F.round("prediction"))
    return disaggregate(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("actual"), F.every(whole).alias("whole"))
