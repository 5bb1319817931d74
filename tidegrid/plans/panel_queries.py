"""Queries over demand panels: bins, grids, windows, splits, active keys and cluster features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.metrics import all_metrics, mae, mape, nan_mean, rmse, weighted_mean
from tidegrid.functions.timebins import calendar, half_hour_slot, time_bin, time_index
from tidegrid.operators import features as ft
from tidegrid.operators import panel as pn
from tidegrid.operators import splits as sp
from tidegrid.operators.clean import fence
from tidegrid.operators.cluster import busy_score as busy
from tidegrid.operators.cluster import difference_features
from tidegrid.operators.forecast import lag_dataset, stitch
from tidegrid.plans.registry import HOUR, PANEL_SQL, panel, query, r, table

BY = "event_type"


def by_type():
    return ft.by_time(BY)


@query(PANEL_SQL + """select event_type, bin, demand, lag(demand, 1) over w as lag_1, lag(demand, 24) over w as lag_24,
  round(avg(demand) over (w rows between 18 preceding and 1 preceding), 6) as roll_mean_18, round(stddev_pop(demand) over (w rows between 18 preceding and 1 preceding), 6) as roll_std_18,
  round(list_sum(list_transform(range(1, 61), lambda i: coalesce(past[i], 0.0) * 0.3 * power(0.7, i - 1))), 6) as ewma_60
from (select *, list_reverse(coalesce(list(demand) over (partition by event_type order by bin rows between 60 preceding and 1 preceding), [])) as past from d) window w as (partition by event_type order by bin)""")
def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f18 = ft.trailing(by_type(), 18)
    return panel(spark, sf_dir).select(
        BY, "bin", "demand", *[c.alias(n) for n, c in ft.lags("demand", [1, 24], by_type()).items()], r(F.avg("demand").over(f18)).alias("roll_mean_18"), r(F.stddev_pop("demand").over(f18)).alias("roll_std_18"), r(ft.ewma("demand", by_type())).alias("ewma_60"),
    )


@query("select event_type, time_bucket(interval '1 hour', ts) as bin, count(*) as demand from events group by all")
def bin_counts(spark, sf_dir):
    return pn.bin_counts(table(spark, sf_dir, "events"), BY, "ts", HOUR)


@query(PANEL_SQL + "select event_type, bin, demand from d")
def dense_panel(spark, sf_dir):
    return panel(spark, sf_dir)


@query("select user_id, time_bucket(interval '30 minutes', ts) as bin, (hour(ts) * 2 + minute(ts) // 30)::int as slot, count(*) as demand, round(sum(value), 4) as total from events group by all")
def half_hour_slots(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", time_bin("ts", 1800).alias("bin"), half_hour_slot("ts").alias("slot")).agg(F.count(F.lit(1)).alias("demand"), r(F.sum("value"), 4).alias("total"))


@query("""select event_id, hour(ts)::int as hour, minute(ts)::int as minute, (dayofweek(ts) + 1)::int as dow_sunday1, (isodow(ts) - 1)::int as dow_monday0, month(ts)::int as month, year(ts)::int as year, day(ts)::int as day,
  weekofyear(ts)::int as iso_week, (hour(ts) * 2 + minute(ts) // 30)::int as slot_30m, (isodow(ts) < 6)::int as is_weekday, (isodow(ts) > 5)::int as is_weekend, dayname(ts) as day_name, ts::date as date from events""")
def calendar_parts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in calendar("ts").items()])


@query(PANEL_SQL + """, m as (select event_type, bin, demand, count(demand) over w as roll_count, max(demand) over w as roll_max, min(demand) over w as roll_min, avg(demand) over w as mean, stddev_samp(demand) over w as std,
  sum(demand) over w as s1, sum(demand * demand) over w as s2, sum(demand * demand * demand) over w as s3 from d window w as (partition by event_type order by bin rows between 48 preceding and 1 preceding))
select event_type, bin, roll_count, roll_max, roll_min, round(mean, 6) as roll_mean, round(std, 6) as roll_std,
  case when roll_count > 1 and s2 / roll_count - (s1 / roll_count) ** 2 > 1e-12 then round((s3 / roll_count - 3 * (s1 / roll_count) * s2 / roll_count + 2 * (s1 / roll_count) ** 3) / (s2 / roll_count - (s1 / roll_count) ** 2) ** 1.5, 5) + 0.0 end as roll_skew from m""")
def rolling_moments(spark, sf_dir):
    cols = ft.rolling("demand", 48, by_type())
    digits = {"roll_mean": 6, "roll_std": 6, "roll_skew": 5}
    return panel(spark, sf_dir).select(BY, "bin", *[(r(c, digits[n]) + F.lit(0.0) if n in digits else c).alias(n) for n, c in cols.items()])


@query(PANEL_SQL + """, p as (select event_type, demand as y, lag(demand, 168) over (partition by event_type order by bin) as p from d)
select event_type, count(*) as n, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(case when y > 0 then abs((y - p) / y) end) * 100, 6) as mape from p where p is not null group by 1""")
def weekly_lag_baseline(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("p", ft.weekly_average("demand", by_type(), 168)).where("p is not null")
    y, p = F.col("demand"), F.col("p")
    return rows.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), r(mae(y, p)).alias("mae"), r(rmse(y, p)).alias("rmse"), r(mape(y, p)).alias("mape"))


@query(PANEL_SQL + """, l as (select *, lag(demand, 168) over w as a, lag(demand, 336) over w as b, lag(demand, 504) over w as c3 from d window w as (partition by event_type order by bin))
select event_type, bin, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c3, 0)) / ((a is not null)::int + (b is not null)::int + (c3 is not null)::int), 6) as hist_avg from l where a is not null""")
def historical_average(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("hist_avg", r(ft.weekly_average("demand", by_type(), 168, weeks=3))).where("hist_avg is not null").select(BY, "bin", "hist_avg")


@query(PANEL_SQL + """, s as (select *, row_number() over (partition by event_type order by bin) as rn, count(*) over (partition by event_type) as n from d)
select event_type, bin, rn::int as rn, n as n_key, floor(n * 0.7::double)::bigint as train_cut, case when rn <= floor(n * 0.7::double) then 'train' else 'test' end as split from s""")
def rank_split(spark, sf_dir):
    return sp.rank_split(panel(spark, sf_dir), BY).select(BY, "bin", "rn", "n_key", "train_cut", "split")


@query("""select case when ts < timestamp '2024-01-22 00:00:00' then 'train' when ts < timestamp '2024-01-28 00:00:00' then 'validation' else 'test' end as split, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from events group by 1""")
def time_split(spark, sf_dir):
    rows = sp.time_split(table(spark, sf_dir, "events"), "ts", datetime(2024, 1, 1), datetime(2024, 1, 31))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""select (case when lower(trim(o_orderpriority)) in ('train', 'training') then 'train' when o_orderstatus = 'F' then 'train' when o_orderstatus = 'O' then 'validation' else 'test' end) as split, count(*) as n from orders group by 1""")
def split_aliases(spark, sf_dir):
    spelled = F.when(F.col("o_orderstatus") == "F", F.lit(" Training ")).when(F.col("o_orderstatus") == "O", F.lit("VAL")).otherwise(F.lit("test"))
    return table(spark, sf_dir, "orders").groupBy(sp.canonical_split(spelled).alias("split")).agg(F.count(F.lit(1)).alias("n"))


LAGS_SQL = PANEL_SQL + ", l as (select event_type, bin, demand, " + ", ".join(f"lag(demand, {k}) over w as l{k}" for k in range(1, 13)) + ", row_number() over w as idx from d window w as (partition by event_type order by bin))\n"


@query(LAGS_SQL + "select event_type, bin, idx::int as idx, demand, " + ", ".join(f"l{k}" for k in range(1, 13)) + " from l where idx > 12")
def lag_matrix(spark, sf_dir):
    return lag_dataset(panel(spark, sf_dir), BY, "demand", 12).select(BY, "bin", "idx", "demand", *[f"l{k}" for k in range(1, 13)])


@query(LAGS_SQL + ", k as (select *, row_number() over (partition by event_type order by bin) as rn, count(*) over (partition by event_type) as n from l where idx > 12) select event_type, case when rn <= floor(n * 0.8::double) then 'train' else 'test' end as split, count(*) as n, min(bin) as first_bin, round(avg(l1), 6) as mean_l1 from k group by all")
def lag_split(spark, sf_dir):
    from tidegrid.operators.forecast import chronological

    rows = chronological(lag_dataset(panel(spark, sf_dir), BY, "demand", 12), BY)
    return rows.groupBy(BY, "split").agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("first_bin"), r(F.avg("l1")).alias("mean_l1"))


@query("with c as (select user_id, time_bucket(interval '1 hour', ts) as bin, sum(value) as demand from events group by all), q as (select quantile_cont(demand, 0.75) + 3.0 * (quantile_cont(demand, 0.75) - quantile_cont(demand, 0.25)) as hi from c) select user_id, bin, round(demand, 6) as demand from c, q where demand <= hi")
def demand_fence(spark, sf_dir):
    counts = pn.bin_counts(table(spark, sf_dir, "events"), "user_id", "ts", HOUR, value="value")
    return fence(counts, "demand", k=3.0, upper_only=True).select("user_id", "bin", r("demand").alias("demand"))


@query("with c as (select distinct user_id, time_bucket(interval '1 hour', ts) as bin from events), s as (select date_diff('hour', min(bin), max(bin)) + 1 as span from c) select user_id, count(*) as n_bins, round(count(*) / any_value(span), 6) as active_ratio from c, s group by 1 having count(*) / any_value(span) >= 0.05")
def active_ratio(spark, sf_dir):
    counts = pn.bin_counts(table(spark, sf_dir, "events"), "user_id", "ts", HOUR)
    return pn.active_by_span(counts, "user_id", HOUR).select("user_id", "n_bins", r("active_ratio").alias("active_ratio"))


@query(PANEL_SQL + "select event_type, round(avg((demand > 0)::int), 6) as active_ratio from d where bin < timestamp '2024-01-22' group by 1 having avg((demand > 0)::int) >= 0.05")
def active_train_ratio(spark, sf_dir):
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    return pn.active_in_train(panel(spark, sf_dir), BY, cut).select(BY, r("active_ratio").alias("active_ratio"))


@query("with c as (select user_id, time_bucket(interval '1 hour', ts) as bin, count(*) as demand from events group by all) select user_id, round(sum(demand) / (select count(distinct bin) from c)::double, 6) as mean_demand from c group by 1 having sum(demand) / (select count(distinct bin) from c) >= 0.09")
def active_mean(spark, sf_dir):
    counts = pn.bin_counts(table(spark, sf_dir, "events"), "user_id", "ts", HOUR)
    return pn.active_by_mean(counts, "user_id", 0.09).select("user_id", r("mean_demand").alias("mean_demand"))


@query(PANEL_SQL + ", i as (select event_type, bin, date_diff('hour', min(bin) over (), bin) as time_idx from d) select event_type, bin, time_idx, (time_idx >= 5)::int as has_lag5, (time_idx >= 24)::int as has_day, (time_idx >= 60)::int as has_ewma, (time_idx >= 168)::int as has_week, (time_idx < 24)::int as cold_start, (time_idx >= 168)::int as ready from i")
def readiness_flags(spark, sf_dir):
    rows = panel(spark, sf_dir)
    rows = rows.select(BY, "bin", time_index("bin", rows.agg(F.min("bin")).scalar(), HOUR).alias("time_idx"))
    return rows.withColumns(ft.readiness(F.col("time_idx"), day=24, week=168))


NATIONS_SQL = """with o as (select c_nationkey as zone, c_nationkey % 3 as cluster_id, date_trunc('month', o_orderdate) as bin, o_totalprice from orders join customer on o_custkey = c_custkey),
s as (select zone, any_value(cluster_id) as cluster_id, bin, count(*)::double as demand from o group by zone, bin)
"""


def nation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders of each nation, and a fixed grouping of nations."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    counts = orders.groupBy(F.col("c_nationkey").alias("zone"), month.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("demand"))
    return counts.withColumn("cluster_id", F.col("zone") % 3)


CLUSTER_SQL = NATIONS_SQL + """, k as (select cluster_id, bin, avg(demand) as cluster_avg from s group by 1, 2),
f as (select cluster_id, bin, round(cluster_avg, 6) as cluster_avg, round(coalesce(lag(cluster_avg, 1) over w, 0), 6) as cluster_lag_1, round(coalesce(lag(cluster_avg, 5) over w, 0), 6) as cluster_lag_5,
  round(avg(cluster_avg) over (w rows between 48 preceding and 1 preceding), 6) as cluster_mean, round(stddev_samp(cluster_avg) over (w rows between 48 preceding and 1 preceding), 6) as cluster_std from k window w as (partition by cluster_id order by bin))
"""


def cluster_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ft.by_time("cluster_id")
    f48 = ft.trailing(w, 48)
    means = nation_series(spark, sf_dir).groupBy("cluster_id", "bin").agg(F.avg("demand").alias("v"))
    return means.select("cluster_id", "bin", r("v").alias("cluster_avg"), *[r(c).alias(n) for n, c in ft.lags("v", [1, 5], w, fill=0.0, prefix="cluster_lag_").items()], r(F.avg("v").over(f48)).alias("cluster_mean"), r(F.stddev_samp("v").over(f48)).alias("cluster_std"))


@query(CLUSTER_SQL + "select * from f")
def cluster_series(spark, sf_dir):
    return cluster_panel(spark, sf_dir)


@query(CLUSTER_SQL + "select s.zone, s.bin, s.cluster_id, round(s.demand - coalesce(f.cluster_lag_1, 0), 6) as diff_lag_1, round(s.demand - coalesce(f.cluster_mean, 0), 6) as diff_mean from s left join f on s.cluster_id = f.cluster_id and s.bin = f.bin")
def cluster_diff(spark, sf_dir):
    rows = nation_series(spark, sf_dir).join(cluster_panel(spark, sf_dir), ["cluster_id", "bin"], "left")
    rows = difference_features(rows, {"diff_lag_1": ("demand", "cluster_lag_1"), "diff_mean": ("demand", "cluster_mean")})
    return rows.select("zone", "bin", "cluster_id", r("diff_lag_1").alias("diff_lag_1"), r("diff_mean").alias("diff_mean"))


@query(NATIONS_SQL + """, k as (select cluster_id as rc, bin, avg(demand) as rep from s group by 1, 2),
z as (select zone, cluster_id, bin, (demand - avg(demand) over (partition by zone)) / stddev_samp(demand) over (partition by zone) as z from s),
y as (select rc, bin, (rep - avg(rep) over (partition by rc)) / stddev_samp(rep) over (partition by rc) as zr from k),
p as (select zone, cluster_id, rc, avg(z * zr) as sim from z join y using (bin) group by 1, 2, 3)
select zone, cluster_id, round(max(case when cluster_id = rc then sim end), 6) as intra_sim, round(max(case when cluster_id <> rc then sim end), 6) as inter_sim from p group by 1, 2""")
def similarity(spark, sf_dir):
    out = ft.similarity(nation_series(spark, sf_dir), "zone", "cluster_id", "demand")
    return out.select("zone", "cluster_id", r("intra_sim").alias("intra_sim"), r("inter_sim").alias("inter_sim"))


@query(NATIONS_SQL + "select cluster_id, bin, sum(demand) as demand from s group by 1, 2")
def cluster_sum(spark, sf_dir):
    return nation_series(spark, sf_dir).groupBy("cluster_id", "bin").agg(F.sum("demand").alias("demand"))


@query(PANEL_SQL + """, q as (select event_type, bin, list(demand) over w as s, count(*) over w as n from d window w as (partition by event_type order by bin rows between 48 preceding and 1 preceding))
select event_type, bin, n::int as steps, s[1]::double as first_step, s[48]::double as last_step, round(list_sum(s)::double, 4) as total from q where n = 48""")
def sequence_window(spark, sf_dir):
    rows = ft.sequence_windows(panel(spark, sf_dir), ["demand"], 48, by_type())
    step = lambda i: F.col("sequence")[i][0].cast("double")
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(BY, "bin", F.size("sequence").alias("steps"), step(0).alias("first_step"), step(47).alias("last_step"), r(total, 4).alias("total"))


@query(PANEL_SQL + """, q as (select list(demand) over w as s, count(*) over w as n from d window w as (partition by event_type order by bin rows between 48 preceding and 1 preceding)), e as (select unnest(s) as x from q where n = 48)
select round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, min(x)::double as lo, max(x)::double as hi from e""")
def sequence_scalers(spark, sf_dir):
    steps = ft.sequence_windows(panel(spark, sf_dir), ["demand"], 48, by_type()).select(F.explode("sequence").alias("step")).select(F.col("step")[0].cast("double").alias("x"))
    return steps.agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query(PANEL_SQL + "select event_type, count(*)::int as n, array_to_string(list(demand::bigint order by bin), ',') as series from d group by 1")
def ordered_series(spark, sf_dir):
    s = panel(spark, sf_dir).groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("demand").cast("long").alias("v")))).alias("s"))
    return s.select(BY, F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").alias("series"))


@query("with b as (select distinct time_bucket(interval '30 minutes', ts) as t from events) select min(g)::bigint as min_gap_seconds from (select epoch(t) - lag(epoch(t)) over (order by t) as g from b)")
def min_bin_gap(spark, sf_dir):
    return ft.min_gap_seconds(table(spark, sf_dir, "events").select(time_bin("ts", 1800).alias("bin")))


@query(PANEL_SQL + "select event_type, time_bucket(interval '8 hours', bin, timestamp '1970-01-01') as bin, sum(demand) as demand from d group by 1, 2")
def resample(spark, sf_dir):
    seconds = pn.resample_seconds(5, 30 * 86_400, HOUR, max_bins=100)
    return pn.resample(panel(spark, sf_dir), BY, seconds)


@query("select event_type, year(ts)::int as year, month(ts)::int as month, (dayofweek(ts) + 1)::int as dow, hour(ts)::int as hour, count(*) as busy_score from events group by all")
def busy_score(spark, sf_dir):
    c = calendar("ts")
    rows = table(spark, sf_dir, "events").select(BY, c["year"].alias("year"), c["month"].alias("month"), c["dow_sunday1"].alias("dow"), c["hour"].alias("hour"))
    return busy(rows, [BY, "year", "month", "dow", "hour"])


PRED_SQL = PANEL_SQL + ", p as (select event_type, bin, demand as y, lag(demand, 24) over (partition by event_type order by bin) as p from d)\n"
METRICS_SQL = "round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(case when y > 0 then abs((y - p) / y) end) * 100, 6) as mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-6)) * 100, 6) as smape, round(sum(abs(y - p)) / sum(abs(y)) * 100, 6) as wmape, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 6) as r2"


def daily_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumn("p", F.lag("demand", 24).over(by_type())).where("p is not null").withColumnRenamed("demand", "y")


@query(PRED_SQL + f"select event_type, {METRICS_SQL} from p where p is not null group by 1")
def forecast_metrics(spark, sf_dir):
    out = daily_naive(spark, sf_dir).groupBy(BY).agg(*all_metrics(F.col("y"), F.col("p")))
    return out.select(BY, *[r(c).alias(c) for c in out.columns if c != BY])


@query(PRED_SQL + f"select {METRICS_SQL} from p where p is not null")
def pooled_metrics(spark, sf_dir):
    out = daily_naive(spark, sf_dir).agg(*all_metrics(F.col("y"), F.col("p")))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(PRED_SQL + ", m as (select event_type, sum(y) as w, avg(abs(y - p)) as mae, avg(case when y > 0 then abs((y - p) / y) end) * 100 as mape from p where p is not null group by 1) select round(sum(w * mae) / sum(w), 6) as weighted_mae, round(sum(w * mape) / sum(w), 6) as weighted_mape, round(avg(mae), 6) as mean_mae from m")
def weighted_metrics(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    m = daily_naive(spark, sf_dir).groupBy(BY).agg(F.sum("y").alias("w"), mae(y, p).alias("mae"), mape(y, p).alias("mape"))
    return m.agg(r(weighted_mean(F.col("mae"), F.col("w"))).alias("weighted_mae"), r(weighted_mean(F.col("mape"), F.col("w"))).alias("weighted_mape"), r(nan_mean(F.col("mae"))).alias("mean_mae"))


@query(PANEL_SQL + ", p as (select event_type, bin, lag(demand, 24) over (partition by event_type order by bin) as p from d), x as (select d.event_type, d.bin, case when d.bin >= timestamp '2024-01-25' then p.p else d.demand end as demand from d join p using (event_type, bin)) select event_type, bin, demand, lag(demand, 1) over (partition by event_type order by bin) as newest, lag(demand, 12) over (partition by event_type order by bin) as oldest from x")
def stitch_history(spark, sf_dir):
    rows = panel(spark, sf_dir)
    predicted = daily_naive(spark, sf_dir).where("bin >= timestamp_ntz'2024-01-25'").select(BY, "bin", F.col("p").alias("prediction"))
    out = stitch(rows, predicted, BY, "demand").withColumn("history", ft.lag_array("demand", 12, by_type()))
    return out.select(BY, "bin", "demand", F.col("history")[0].alias("newest"), F.col("history")[11].alias("oldest"))


@query(PANEL_SQL + "select event_type, bin, round((demand - min(demand) over (partition by event_type)) / nullif(max(demand) over (partition by event_type) - min(demand) over (partition by event_type), 0), 6) as scaled, round((demand - avg(demand) over (partition by event_type)) / stddev_samp(demand) over (partition by event_type), 6) as z from d")
def scaled_panel(spark, sf_dir):
    k = Window.partitionBy(BY)
    lo, hi = F.min("demand").over(k), F.max("demand").over(k)
    return panel(spark, sf_dir).select(BY, "bin", r((F.col("demand") - lo) / F.nullif(hi - lo, F.lit(0.0))).alias("scaled"), r(ft.zscore("demand", BY)).alias("z"))


@query(PANEL_SQL + """, q as (select event_type, bin, list(demand::float) over w as s, count(*) over w as n from d window w as (partition by event_type order by bin rows between 23 preceding and current row)),
e as (select event_type, bin, unnest(s)::double as x, generate_subscripts(s, 1) as i from q where n = 24), f as (select avg(x) as m, stddev_pop(x) as sd from e where bin < timestamp '2024-01-20')
select event_type, bin, 24::int as steps, round(max(case when i = 1 then (x - m) / sd end), 5) as first_step, round(max(case when i = 24 then (x - m) / sd end), 5) as last_step, round(sum((x - m) / sd), 4) as total from e, f group by 1, 2""")
def scaled_sequences(spark, sf_dir):
    """Sequences up to the current bin, scaled by moments of the train bins, written by a Parquet sink and read back."""
    from tidegrid.sources import io

    rows = ft.sequence_windows(panel(spark, sf_dir), ["demand"], 24, by_type(), include_current=True)
    fitted = ft.sequence_moments(rows.where("bin < timestamp_ntz'2024-01-20'"), 1)
    path = io.scratch(spark, "sequences")
    io.write_partitioned(ft.scale_sequences(rows, fitted).select(BY, "bin", "scaled"), path)
    back = spark.read.parquet(path)
    step = lambda i: F.col("scaled")[i][0]
    total = F.aggregate(F.flatten("scaled"), F.lit(0.0), lambda a, x: a + x)
    return back.select(BY, "bin", F.size("scaled").alias("steps"), r(step(0), 5).alias("first_step"), r(step(23), 5).alias("last_step"), r(total, 4).alias("total"))


@query(PANEL_SQL + """, q as (select event_type, bin, demand, list(demand) over w as s, count(*) over w as n from d window w as (partition by event_type order by bin rows between 23 preceding and current row))
select case when bin < timestamp '2024-01-20' then 'train' else 'test' end as split, event_type, epoch(bin)::bigint as bin_s, demand::double as demand, 24::int as steps, s[1]::double as first_step, list_sum(s)::double as total from q where n = 24""")
def tfrecord_sequences(spark, sf_dir):
    """Sequences written as TFRecord, a folder for each split, and read back."""
    from tidegrid.functions.timebins import epoch
    from tidegrid.sources import io, tfrecord

    tfrecord.register(spark)
    split = F.when(F.col("bin") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").otherwise("test")
    rows = ft.sequence_windows(panel(spark, sf_dir), ["demand"], 24, by_type(), include_current=True)
    rows = rows.select(split.alias("split"), BY, epoch("bin").cast("long").alias("bin_s"), F.col("demand").cast("double").alias("demand"), F.flatten("sequence").alias("sequence"))
    out, root = None, io.scratch(spark, "tfrecords")
    for name in ("train", "test"):
        rows.where(F.col("split") == name).drop("split").write.format("tfrecord").option("maxRecordsPerFile", 1000).mode("append").save(f"{root}/{name}")
        back = spark.read.format("tfrecord").schema(f"{BY} string, bin_s long, demand double, sequence array<double>").load(f"{root}/{name}")
        part = back.select(F.lit(name).alias("split"), BY, "bin_s", "demand", F.size("sequence").alias("steps"), F.col("sequence")[0].alias("first_step"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query(NATIONS_SQL + """, a as (select n_nationkey as zone, n_regionkey as grp from nation), t as (select zone, avg(demand) as zone_mean, stddev_samp(demand) as zone_std from s group by 1),
g as (select grp, bin, avg(demand) as group_mean from s join a using (zone) group by 1, 2)
select s.zone, a.grp, s.bin, round(t.zone_mean, 6) as zone_mean, round(t.zone_std, 6) as zone_std, round(g.group_mean, 6) as group_mean from s join a using (zone) join t using (zone) join g on g.grp = a.grp and g.bin = s.bin""")
def panel_with_stats(spark, sf_dir):
    """Statistics of each zone, and of the group that a table of assignments puts it in, joined back to the panel."""
    series = nation_series(spark, sf_dir).select("zone", "bin", "demand")
    assigned = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("grp"))
    stats = series.groupBy("zone").agg(r(F.avg("demand")).alias("zone_mean"), r(F.stddev_samp("demand")).alias("zone_std"))
    rows = series.join(assigned, "zone")
    means = rows.groupBy("grp", "bin").agg(r(F.avg("demand")).alias("group_mean"))
    return rows.join(stats, "zone").join(means, ["grp", "bin"]).select("zone", "grp", "bin", "zone_mean", "zone_std", "group_mean")


@query("""with c as (select event_type, time_bucket(interval '1 hour', ts) as bin, count(*)::double as demand from events group by all), e as (select event_type, min(bin) as lo from c group by 1),
g as (select event_type, unnest(generate_series(lo, (select max(ts) from events), interval '1 hour')) as bin from e), d as (select g.event_type, g.bin, coalesce(demand, 0) as demand from g left join c using (event_type, bin))
select event_type, bin, demand, lag(demand, 1) over w as lag_1, lag(demand, 24) over w as lag_24 from d where bin + interval '1 hour' <= (select max(ts) from events) - interval '1 hour' window w as (partition by event_type order by bin)""")
def stream_features(spark, sf_dir):
    """The dense panel with lags from a stream of all events: every bin that the watermark, an hour behind, has passed."""
    from tidegrid.sources import io
    from tidegrid.streaming.panel import stream_panel

    path = io.scratch(spark, "stream")
    table(spark, sf_dir, "events").select(BY, "ts").write.parquet(f"{path}/in")
    events = spark.readStream.schema(f"{BY} string, ts timestamp_ntz").parquet(f"{path}/in")
    out = stream_panel(events, BY, "ts", late="1 hour", lags=(1, 24))
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
