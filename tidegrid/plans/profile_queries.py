"""Queries over trips and orders: data quality, distributions, shares, seasonality and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.expressions import adjusted_kurtosis, adjusted_skewness, buckets, clip, first_match, label, ratio
from tidegrid.functions.timebins import epoch
from tidegrid.operators import clean as cl
from tidegrid.operators import profile as pr
from tidegrid.operators.splits import stratified_sample as strata
from tidegrid.operators.panel import pivot_sum
from tidegrid.plans.registry import TRIPS_SQL, query, r, table, trips
from tidegrid.sources import io


@query("with b as (select quantile_cont(epoch(ts)::double, 0.25) as q1, quantile_cont(epoch(ts)::double, 0.75) as q3 from events) select event_id, ts from events, b where epoch(ts) between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)")
def iqr_fence(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s", epoch("ts").cast("double"))
    lo, hi = cl.tukey_bounds(events, "s", least_iqr=1.0)
    return events.where(F.col("s").between(lo, hi)).select("event_id", "ts")


@query(TRIPS_SQL + """select unnest(['input', 'bad_time', 'bad_distance', 'bad_fare', 'kept']) as metric, unnest([count(*), count_if(not minutes > 0), count_if(minutes > 0 and not distance between 2 and 45), count_if(minutes > 0 and distance between 2 and 45 and not fare > 1000),
  count_if(minutes > 0 and distance between 2 and 45 and fare > 1000)]) as n from t""")
def cleaning_report(spark, sf_dir):
    return cl.cleaning_report(trips(spark, sf_dir), {"bad_time": F.col("minutes") > 0, "bad_distance": cl.in_range(F.col("distance"), 2, 45), "bad_fare": F.col("fare") > 1000})


def anomaly_rules():
    c = F.col
    return {
        "time_reversed": c("minutes") <= 0, "over_a_year": c("minutes") > 525_600, "distance_over_45": c("distance") > 45, "distance_one": c("distance") == 1, "fare_under_1000": c("fare") < 1000, "fare_over_90000": c("fare") > 90_000,
        "no_tip": c("tip") == 0, "tip_over_5000": c("tip") > 5000, "no_tolls": c("tolls") == 0, "tolls_over_4000": c("tolls") > 4000, "one_passenger": c("passengers") == 1, "over_six_passengers": c("passengers") > 6,
        "returned": c("payment") == "R", "slow": ratio(c("distance"), c("minutes")) < 0.0001,
    }


ANOMALIES = ["minutes <= 0", "minutes > 525600", "distance > 45", "distance = 1", "fare < 1000", "fare > 90000", "tip = 0", "tip > 5000", "tolls = 0", "tolls > 4000", "passengers = 1", "passengers > 6", "payment = 'R'", "minutes > 0 and distance / minutes < 0.0001"]
ANOMALY_NAMES = ["time_reversed", "over_a_year", "distance_over_45", "distance_one", "fare_under_1000", "fare_over_90000", "no_tip", "tip_over_5000", "no_tolls", "tolls_over_4000", "one_passenger", "over_six_passengers", "returned", "slow"]


@query(TRIPS_SQL + f"select unnest({ANOMALY_NAMES}) as rule, unnest([{', '.join(f'count_if({a})' for a in ANOMALIES)}]) as n, round(unnest([{', '.join(f'count_if({a})' for a in ANOMALIES)}]) * 100.0 / count(*), 6) as pct from t".replace("* 100.0 / count(*)", "* 100.0::double / (select count(*) from t)"))
def anomaly_counts(spark, sf_dir):
    return cl.rule_counts(trips(spark, sf_dir), anomaly_rules()).select("rule", "n", r("pct").alias("pct"))


@query(TRIPS_SQL + """select payment, count(*) as n, count_if(minutes > 0 and distance between 1 and 45 and fare > 0 and tip >= 0 and tolls >= 0 and passengers between 1 and 6 and distance / nullif(minutes, 0) <= 80) as n_valid,
  round(avg(case when minutes > 0 then distance / (minutes / 60) end), 8) as mean_speed from t group by 1""")
def validity_mask(spark, sf_dir):
    c = F.col
    rules = {"time": c("minutes") > 0, "distance": cl.in_range(c("distance"), 1, 45), "fare": c("fare") > 0, "tip": c("tip") >= 0, "tolls": c("tolls") >= 0, "passengers": cl.in_range(c("passengers"), 1, 6), "speed": ratio(c("distance"), c("minutes")) <= 80}
    speed = ratio(c("distance"), c("minutes") / 60)
    return trips(spark, sf_dir).groupBy("payment").agg(F.count(F.lit(1)).alias("n"), F.count_if(cl.all_of(rules)).alias("n_valid"), r(F.avg(speed), 8).alias("mean_speed"))


def gappy(events):
    """Events with nulls where a driver table has none."""
    return events.select("event_type", F.when(F.col("value") > 5, F.col("value")).alias("value"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.hour("ts") > 2, F.col("ts")).alias("ts"))


@query("select event_type, unnest(['value', 'user_id', 'ts']) as column_name, round(unnest([avg((not value > 5)::int) * 100, avg((user_id % 7 = 0)::int) * 100, avg((hour(ts) <= 2)::int) * 100]), 6) as null_pct from events group by 1")
def null_profile(spark, sf_dir):
    return cl.null_profile(gappy(table(spark, sf_dir, "events")), ["value", "user_id", "ts"], [F.col("event_type")]).select("event_type", "column_name", r("null_pct").alias("null_pct"))


@query("select event_type, count(*) as n from events where (not value > 5 or value between 10 and 60) and user_id % 7 <> 0 group by 1")
def null_tolerant_range(spark, sf_dir):
    rows = gappy(table(spark, sf_dir, "events"))
    return rows.where(cl.in_range(F.col("value"), 10, 60, null_ok=True) & cl.in_range(F.col("user_id"), 0, 10**9)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, round(sum(case when value > 5 then value else 0 end), 4) as filled_sum, count_if(value > 5 and hour(ts) > 2) as complete, round(avg(greatest(10, least(value, 50))), 6) as clipped_mean from events group by 1")
def fill_drop_clip(spark, sf_dir):
    rows = gappy(table(spark, sf_dir, "events"))
    filled = rows.fillna({"value": 0.0}).groupBy("event_type").agg(r(F.sum("value"), 4).alias("filled_sum"))
    complete = rows.dropna(subset=["value", "ts"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("complete"))
    clipped = table(spark, sf_dir, "events").groupBy("event_type").agg(r(F.avg(clip(F.col("value"), 10, 50))).alias("clipped_mean"))
    return filled.join(complete, "event_type").join(clipped, "event_type")


@query("select count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) as {n}" for p, n in ((0.01, "p1"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.999, "p99_9"))) + ", max(o_totalprice) as max from orders")
def describe_percentiles(spark, sf_dir):
    d = pr.describe(table(spark, sf_dir, "orders"), "o_totalprice", (0.01, 0.25, 0.5, 0.75, 0.999))
    return d.select(*[c if c in ("n", "min", "max") else r(c, 4).alias(c) for c in d.columns])


@query("select o_orderpriority, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(median(o_totalprice), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, max(o_totalprice) as max from orders group by 1")
def grouped_box_stats(spark, sf_dir):
    d = pr.describe(table(spark, sf_dir, "orders"), "o_totalprice", by=["o_orderpriority"])
    return d.select(*[c if c in ("o_orderpriority", "n", "min", "max") else r(c, 4).alias(c) for c in d.columns])


@query("select round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(quantile_cont(o_totalprice, 0.5), 6) as q2, round(quantile_cont(o_totalprice, 0.999), 6) as q999 from orders")
def scalable_quantiles(spark, sf_dir):
    q = cl.exact_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.25, 0.5, 0.999])
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(n) for n, v in zip(("q1", "q2", "q999"), q, strict=True)])


@query("select event_type, round(skewness(value), 6) as skew, round(kurtosis(value), 5) as kurt, round(skewness(ln(1 + value)), 6) as log_skew from events group by 1")
def moments_adjusted(spark, sf_dir):
    v, lv = F.col("value"), F.log1p("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(adjusted_skewness(v)).alias("skew"), r(adjusted_kurtosis(v), 5).alias("kurt"), r(adjusted_skewness(lv)).alias("log_skew"))


NUMBERS = ["fare", "distance", "tip", "tolls", "minutes"]
PAIRS = [(x, y) for i, x in enumerate(NUMBERS) for y in NUMBERS[i:]]


@query(TRIPS_SQL + f"select unnest({[x for x, _ in PAIRS]}) as x, unnest({[y for _, y in PAIRS]}) as y, round(unnest([{', '.join('1.0::double' if x == y else f'corr({x}, {y})' for x, y in PAIRS)}]), 6) as r from t")
def corr_matrix(spark, sf_dir):
    return pr.correlations(trips(spark, sf_dir), NUMBERS).select("x", "y", r("r").alias("r"))


@query(TRIPS_SQL + f", m as (select unnest({[x for x, _ in PAIRS]}) as x, unnest({[y for _, y in PAIRS]}) as y, unnest([{', '.join('1.0::double' if x == y else f'corr({x}, {y})' for x, y in PAIRS)}]) as r from t) select x, y, round(r, 6) as r from m where x <> y and abs(r) > 0.4")
def strong_pairs(spark, sf_dir):
    return pr.strong_pairs(pr.correlations(trips(spark, sf_dir), NUMBERS), 0.4).select("x", "y", r("r").alias("r"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(corr(l_quantity, l_extendedprice), 6) as r, count(*) as n from lineitem group by 1")
def linregress(spark, sf_dir):
    d = pr.linear_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", r("slope").alias("slope"), r("intercept", 4).alias("intercept"), r("r").alias("r"), "n")


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as pct from orders group by 1, 2")
def value_shares(spark, sf_dir):
    return pr.value_shares(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]).select("o_orderpriority", "o_orderstatus", "n", r("pct").alias("pct"))


@query("select case when l_quantity > 0 and l_quantity <= 5 then '0-5' when l_quantity > 5 and l_quantity <= 20 then '5-20' when l_quantity > 20 and l_quantity <= 45 then '20-45' end as bucket, count(*) as n from lineitem group by 1")
def distance_buckets(spark, sf_dir):
    b = buckets(F.col("l_quantity"), [0, 5, 20, 45], ["0-5", "5-20", "20-45"])
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select greatest(0, least(floor((least(greatest(value, 1.0), 100.0) - 1.0) / 0.99), 99))::int as bucket, count(*) as n from events group by 1")
def histogram(spark, sf_dir):
    return pr.histogram(table(spark, sf_dir, "events"), "value", 1.0, 100.0, 100)


@query("select year(o_orderdate)::int as year, count_if(o_orderstatus = 'F')::double as F, count_if(o_orderstatus = 'O')::double as O, count_if(o_orderstatus = 'P')::double as P from orders group by 1")
def pivot_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", F.lit(1.0).alias("one"))
    return pivot_sum(rows, ["year"], "o_orderstatus", ["F", "O", "P"], "one")


@query("with c as (select year(o_orderdate)::int as year, o_orderpriority, count(*) as n from orders group by 1, 2) select *, round(n * 100.0::double / sum(n) over (partition by year), 6) as row_pct from c")
def crosstab_row_pct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return pr.crosstab_row_pct(rows, "year", "o_orderpriority").select("year", "o_orderpriority", "n", r("row_pct").alias("row_pct"))


OD_SQL = """with t as (select cn.n_name as origin, sn.n_name as destination, r.r_name as borough, l_extendedprice as fare from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
  join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region r on cn.n_regionkey = r.r_regionkey), c as (select origin, destination, any_value(borough) as borough, count(*) as n, sum(fare) as fare from t group by 1, 2)
"""


def od_counts(spark, sf_dir):
    """Lines between customer nation and supplier nation; the dimensions are small and broadcast by size."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_extendedprice")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    # Counted by nation keys first, so that names are joined to a few hundred rows.
    keys = lines.join(customer, "o_custkey").join(supplier, "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("fare"))
    origin = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("origin"), F.col("r_name").alias("borough"))
    destination = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("destination"))
    return keys.join(origin, "c_nationkey").join(destination, "s_nationkey").select("origin", "destination", "borough", "n", "fare")


@query(OD_SQL + "select origin, destination, borough, n, round(n * 100.0::double / sum(n) over (partition by origin), 6) as row_pct, round(n * 100.0::double / sum(n) over (), 6) as total_pct from c")
def od_matrix(spark, sf_dir):
    from pyspark.sql import Window

    counts = pr.with_total_share(od_counts(spark, sf_dir), out="total_pct")
    return counts.select("origin", "destination", "borough", "n", r(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("origin"))).alias("row_pct"), r("total_pct").alias("total_pct"))


@query(OD_SQL + "select origin, destination, n from c order by n desc, origin, destination limit 20")
def od_top20(spark, sf_dir):
    return od_counts(spark, sf_dir).orderBy(F.desc("n"), "origin", "destination").limit(20).select("origin", "destination", "n")


@query("with y as (select year(o_orderdate)::int as year, count(*) as n from orders group by 1) select year, n, round((n - lag(n) over (order by year)) * 100.0::double / lag(n) over (order by year), 6) as yoy_pct from y")
def yoy(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return pr.pct_change(years, "n", ["year"], out="yoy_pct").select("year", "n", r("yoy_pct").alias("yoy_pct"))


@query("with m as (select year(o_orderdate)::int as year, month(o_orderdate)::int as month, count(*) as n from orders group by 1, 2) select year, month, n, round((n - lag(n) over w) * 100.0::double / lag(n) over w, 6) as yoy_pct from m window w as (partition by month order by year)")
def same_month_yoy(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return pr.pct_change(months, "n", ["year"], ["month"], out="yoy_pct").select("year", "month", "n", r("yoy_pct").alias("yoy_pct"))


@query("with c as (select year(o_orderdate)::int as year, c_nationkey as zone, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2) select year, zone, n, rank::int as rank from (select *, row_number() over (partition by year order by n desc, zone) as rank from c) where rank <= 5")
def topk_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return pr.top_k(rows, 5, ["year"], [F.desc("n"), F.asc("zone")]).select("year", "zone", "n", "rank")


@query("select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 6")
def topk_zones(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(6)


@query("with m as (select event_type, date_trunc('day', ts)::date as day, count(*) as n from events group by 1, 2) select event_type, arg_max(day, n * 100000 - date_diff('day', date '2000-01-01', day)) as busiest, arg_min(day, n * 100000 + date_diff('day', date '2000-01-01', day)) as quietest, max(n) as n_max, min(n) as n_min from m group by 1")
def idxmax_by_group(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first = F.struct("n", F.date_diff(F.lit("2000-01-01").cast("date"), F.col("day")))
    last = F.struct("n", F.date_diff(F.col("day"), F.lit("2000-01-01").cast("date")))
    return days.groupBy("event_type").agg(F.max_by("day", first).alias("busiest"), F.min_by("day", last).alias("quietest"), F.max("n").alias("n_max"), F.min("n").alias("n_min"))


@query("select hour(ts)::int as hour, round(count(*)::double / (select count(distinct ts::date) from events), 6) as per_day from events group by 1")
def per_day_hourly_rate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    days = events.agg(F.count_distinct(F.to_date("ts"))).scalar()
    return events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).select("hour", r(F.col("n") / days).alias("per_day"))


@query(TRIPS_SQL + "select round(avg(fare), 4) as fare, round(avg(tip), 4) as tip, round(avg(tolls), 4) as tolls, round(avg(fare + tip + tolls), 4) as total, round(avg(fare) * 100 / avg(fare + tip + tolls), 6) as fare_pct, round(avg(tip) * 100 / avg(fare + tip + tolls), 6) as tip_pct from t")
def revenue_structure(spark, sf_dir):
    total = F.avg(F.col("fare") + F.col("tip") + F.col("tolls"))
    m = trips(spark, sf_dir).agg(F.avg("fare").alias("fare"), F.avg("tip").alias("tip"), F.avg("tolls").alias("tolls"), total.alias("total"))
    return m.select(*[r(c, 4).alias(c) for c in m.columns], r(ratio(F.col("fare") * 100, F.col("total"))).alias("fare_pct"), r(ratio(F.col("tip") * 100, F.col("total"))).alias("tip_pct"))


@query(TRIPS_SQL + "select priority, round(avg((tip > 0)::int), 6) as tip_rate, round(avg(case when fare > 0 then tip * 100 / fare end), 6) as mean_tip_pct, round(avg((passengers = 1)::int), 6) as solo_rate from t group by 1")
def tip_rate(spark, sf_dir):
    rate = lambda c: r(F.avg(c.cast("double")))
    return trips(spark, sf_dir).groupBy("priority").agg(rate(F.col("tip") > 0).alias("tip_rate"), r(F.avg(ratio(F.col("tip") * 100, F.col("fare")))).alias("mean_tip_pct"), rate(F.col("passengers") == 1).alias("solo_rate"))


@query(TRIPS_SQL + "select year(pickup)::int as year, round(median(fare / nullif(distance, 0)), 6) as fare_per_mile, round(median(case when minutes > 0 then fare / minutes end), 6) as fare_per_minute, round(avg(case when minutes > 0 then distance / (minutes / 60) end), 8) as speed from t group by 1")
def unit_prices(spark, sf_dir):
    c = F.col
    measures = {"fare_per_mile": ratio(c("fare"), c("distance")), "fare_per_minute": ratio(c("fare"), c("minutes")), "speed": ratio(c("distance"), c("minutes") / 60)}
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), m.alias("value")) for n, m in measures.items()])).alias("m")
    # The join is made once; medians and means read what it wrote.
    path = io.scratch(spark, "unit-prices")
    trips(spark, sf_dir).select(F.year("pickup").alias("year"), stacked).select("year", "m.*").write.parquet(path)
    rows = spark.read.schema("year int, measure string, value double").parquet(path)
    medians = cl.grouped_quantiles(rows.where("measure <> 'speed'"), c("value"), [0.5], ["year", "measure"])
    out = rows.where("measure = 'speed'").groupBy("year").agg(r(F.avg("value"), 8).alias("speed"))
    of = lambda name: F.max(F.when(c("measure") == name, r(c("q")[0]))).alias(name)
    return out.join(medians.groupBy("year").agg(of("fare_per_mile"), of("fare_per_minute")), "year", "left").select("year", "fare_per_mile", "fare_per_minute", "speed")


@query(TRIPS_SQL + ", c as (select year(pickup)::int as year, case payment when 'A' then 'card' when 'N' then 'cash' else 'other' end as payment_type, count(*) as n from t group by 1, 2) select *, round(n * 100.0::double / sum(n) over (partition by year), 6) as row_pct from c")
def payment_labels(spark, sf_dir):
    rows = trips(spark, sf_dir).select(F.year("pickup").alias("year"), label(F.col("payment"), {"A": "card", "N": "cash"}, "other").alias("payment_type"))
    return pr.crosstab_row_pct(rows, "year", "payment_type").select("year", "payment_type", "n", r("row_pct").alias("row_pct"))


@query("select case when c_nationkey between 0 and 9 then 'first' when c_nationkey between 5 and 14 then 'second' else 'unknown' end as borough, count(*) as n from customer group by 1")
def first_match_labels(spark, sf_dir):
    b = first_match(F.col("c_nationkey"), [("first", range(10)), ("second", range(5, 15))], "unknown")
    return table(spark, sf_dir, "customer").groupBy(b.alias("borough")).agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select l_returnflag, l_linenumber, count(*) as n from lineitem group by 1, 2) select l_returnflag, arg_max(l_linenumber, n * 100 - l_linenumber)::int as mode_line from c group by 1")
def mode_value(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("mode_line"))


@query("select event_type, event_id from (select event_type, event_id, count(*) over (partition by event_type) as size, row_number() over (partition by event_type order by event_id * 7919 % 10007, event_id) as rn from events) where rn <= greatest(1, floor(size * (1000.0::double / (select count(*) from events))))")
def stratified_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return strata(events, "event_type", [F.col("event_id") * 7919 % 10_007, F.col("event_id")], 1000, events.count()).select("event_type", "event_id")


@query("select event_type, count(value) as n, round((sum(value ** 3) / count(*) - 3 * avg(value) * sum(value ** 2) / count(*) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 5) as skew, round(kurtosis_pop(value), 5) as kurt from events group by 1")
def jarque_bera(spark, sf_dir):
    d = pr.jarque_bera(table(spark, sf_dir, "events"), "value", ["event_type"])
    return d.select("event_type", "n", r("skew", 5).alias("skew"), r("kurt", 5).alias("kurt"))


@query("""with v as (select o_totalprice as v from orders where o_totalprice is not null), s as (select count(*) as n, avg(v) as m, stddev_samp(v) as sd from v),
c as (select v, count(*) as k from v group by 1), u as (select v, k, sum(k) over (order by v) as upto from c),
z as (select u.*, n, (v - m) / sd / sqrt(2) as z from u, s), t as (select *, 1 / (1 + 0.3275911 * abs(z)) as t from z),
f as (select *, 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z))) as cdf from t)
select sum(k)::bigint as n, round(max(greatest(abs(upto / n - cdf), abs(cdf - (upto - k) / n))), 8) as ks from f""")
def ks_normal(spark, sf_dir):
    return pr.ks_normal(table(spark, sf_dir, "orders"), "o_totalprice").select("n", r("ks", 8).alias("ks"))


@query("select year(o_orderdate)::int as year, count(*) as n, round(sum(o_totalprice), 2) as total, count_if(year(o_orderdate) >= 1998) as with_fee from orders group by 1")
def union_files(spark, sf_dir):
    """Files whose column name and id width drift, read back as one table."""
    path = io.scratch(spark, "drift")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    old, new = F.year("ts") < 1998, F.year("ts") >= 1998
    orders.where(old).withColumn("o_orderkey", F.col("o_orderkey").cast("int")).write.parquet(f"{path}/a")
    orders.where(new).withColumnsRenamed({"price": "Price"}).withColumn("fee", F.lit(1.0)).write.parquet(f"{path}/b")
    spec = {"id": (["o_orderkey"], "long"), "ts": (["ts", "pickup"], "timestamp_ntz"), "price": (["price"], "double"), "fee": (["fee"], "double")}
    df, _ = io.read_normalized(spark, [f"{path}/a", f"{path}/b", f"{path}/missing"], spec, required=["ts"])
    return df.groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("total"), F.count("fee").alias("with_fee"))


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey < 3")
def csv_scan(spark, sf_dir):
    path = io.scratch(spark, "csv")
    table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") < 3, F.col("n_regionkey"))).write.option("header", True).csv(path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", drop_null=["n_regionkey"])


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus in ('F', 'O') group by 1")
def partitioned_sink(spark, sf_dir):
    path = io.scratch(spark, "by-status")
    io.write_partitioned(table(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("select 'events.parquet' as file_name, count(*) as n_rows from events")
def file_profile(spark, sf_dir):
    return io.file_profile(table(spark, sf_dir, "events")).select("file_name", "n_rows")


@query("select 'events.parquet' as file_name, count(*) as n_rows, 6 as n_columns, true as has_sizes from events union all select 'orders.parquet', count(*), 6, true from orders")
def footer_profile(spark, sf_dir):
    out = io.footer_profile(spark, [f"{sf_dir}/{t}.parquet" for t in ("events", "orders")])
    sizes = (F.col("n_row_groups") > 0) & (F.col("compressed_bytes") > 0) & (F.col("uncompressed_bytes") >= F.col("compressed_bytes") / 2)
    return out.select("file_name", "n_rows", "n_columns", sizes.alias("has_sizes"))


@query("select event_id, event_type from events order by ('0x' || substr(md5('7:' || event_id), 1, 8))::bigint, event_id limit 500")
def fixed_sample(spark, sf_dir):
    """A sampling operator: 500 rows exactly."""
    from tidegrid.operators.splits import fixed_sample as sample

    return sample(table(spark, sf_dir, "events"), "event_id", 500, seed=7).select("event_id", "event_type")


@query("select user_id, arg_min(event_id, ts) as event_id, min(ts) as ts from events group by 1")
def first_in_group(spark, sf_dir):
    return pr.first_in_group(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), ["event_id", "ts"])


@query("select * from (select user_id, count(*) as n from events group by 1 order by n, user_id limit 6)")
def bottomk_zones(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "user_id").limit(6)


@query("select kind, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders, (select unnest(['csv', 'json']) as kind) group by 1, 2")
def delimited_sinks(spark, sf_dir):
    """Orders written as CSV and as JSON lines, and read back."""
    rows, schema, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey long, o_orderpriority string, o_totalprice double", None
    for kind in ("csv", "json"):
        path = io.scratch(spark, kind)
        io.write_delimited(rows, path, kind)
        back = io.read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).json(path)
        part = back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "o_orderpriority", "n", "total")


@query("select event_type, year(ts)::int as year, hour(ts)::int as hour, round(count(*)::double / count(distinct ts::date), 6) as per_day from events group by all")
def hourly_rate_by_year(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.year("ts").alias("year"), F.hour("ts").alias("hour"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("event_type", "year", "hour").agg(r(F.sum("n") / F.count("d")).alias("per_day"))


@query("select c_custkey, o_orderkey from customer semi join (select distinct c_nationkey as k from customer where c_acctbal > 9000) on c_nationkey = k join orders on o_custkey = c_custkey")
def kept_keys(spark, sf_dir):
    """Orders of customers in nations that have a rich one: a semi-join with the list of active keys."""
    from tidegrid.operators.panel import keep_keys

    customers = table(spark, sf_dir, "customer")
    kept = keep_keys(customers, customers.where("c_acctbal > 9000"), "c_nationkey")
    return kept.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("select o_orderstatus, 'web' as channel, count(*) as n from orders group by 1")
def declared_scan(spark, sf_dir):
    """A scan under a declared schema, with a column added only where it lacks."""
    rows = io.read_declared(spark, f"{sf_dir}/orders.parquet", "o_orderkey long, o_orderstatus string")
    return io.add_missing(rows, {"o_orderstatus": F.lit("never"), "channel": F.lit("web")}).groupBy("o_orderstatus", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("select 'orders.parquet' as file_name, count(*) as n, sum(o_orderkey)::bigint as keys from orders")
def provenance(spark, sf_dir):
    df, _ = io.read_normalized(spark, [f"{sf_dir}/orders.parquet"], {"id": (["O_ORDERKEY"], "long")}, required=["id"], provenance="file_name")
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("keys"))


@query("with s as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as sd from orders) select p, round(q, 4) as sample_q, round(m + sd * z, 3) as normal_q from s, (select unnest([0.1, 0.5, 0.9])::double as p, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) as q, unnest([-1.2815515655446004, 0.0, 1.2815515655446004])::double as z from orders)")
def qq_points(spark, sf_dir):
    return pr.qq_points(table(spark, sf_dir, "orders"), "o_totalprice", [0.1, 0.5, 0.9]).select("p", r("sample_q", 4).alias("sample_q"), r("normal_q", 3).alias("normal_q"))


@query("select event_type, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1")
def half_open_range(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(cl.half_open("ts", "2024-01-05", "2024-01-20"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"select o_orderkey, o_totalprice from orders where ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint < {int(0.01 * (1 << 32))}")
def hashed_sample(spark, sf_dir):
    """A sampling operator: one per cent of the rows, the same ones however they are partitioned."""
    from tidegrid.operators.splits import hashed_fraction

    return table(spark, sf_dir, "orders").where(hashed_fraction(F.col("o_orderkey"), 0.01)).select("o_orderkey", "o_totalprice")


@query("select year(l_shipdate)::int as year, month(l_shipdate)::int as month, round(sum(l_extendedprice) / count(distinct l_shipdate::date), 4) as per_day from lineitem group by 1, 2")
def per_day_average(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_extendedprice").alias("v"))
    return rows.groupBy("year", "month").agg(r(F.sum("v") / F.count("d"), 4).alias("per_day"))


@query("select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderdate)::date as first_day, 'bigint,double,timestamp_ntz,string,string' as kinds from orders group by 1")
def csv_inferred(spark, sf_dir):
    """Orders as CSV files that drift (whole prices here, decimals there, other columns in another order), read with one inferred type a column."""
    from tidegrid.sources import delimited

    path = io.scratch(spark, "csv")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("code"))
    whole = F.col("o_totalprice") == F.floor("o_totalprice")
    orders.where(whole).withColumn("o_totalprice", F.col("o_totalprice").cast("long")).write.option("header", True).csv(f"{path}/a")
    orders.where(~whole).select("code", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey").write.option("header", True).csv(f"{path}/b")
    rows = delimited.read_inferred(spark, io.list_files(spark, f"{path}/*/*.csv"))
    kinds = dict(rows.dtypes)
    shown = ",".join(kinds[c] for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "code"))
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").cast("date").alias("first_day")).withColumn("kinds", F.lit(shown))


def _damage(spark, path) -> None:
    """Overwrite a file with the middle half of its pages zeroed behind a sound footer, as a fault to test readers with. Bytes are copied a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}")
    begin, n = io.page_bytes(spark, path)
    copy, zeros = jvm.org.apache.commons.io.IOUtils.copyLarge, jvm.org.apache.commons.io.input.NullInputStream(n // 2)
    stream, out = fs.open(p), fs.create(draft, True)
    try:
        copy(stream, out, 0, begin + n // 4)
        copy(zeros, out)
        stream.seek(begin + n // 4 + n // 2)
        copy(stream, out)
    finally:
        stream.close()
        out.close()
    fs.delete(p, False)
    fs.rename(draft, p)


@query("select l_linenumber::int as line, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem where l_linenumber <> 3 group by 1")
def damaged_files(spark, sf_dir):
    """Lines in files for each number; one number's files have pages damaged behind a sound footer, the others are read whole."""
    path = io.scratch(spark, "damaged")
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", "l_extendedprice")
    lines.where("l_linenumber is not null").withColumn("line", F.col("l_linenumber")).write.partitionBy("line").parquet(path)
    hit = io.list_files(spark, f"{path}/line=3/*.parquet")
    for file in hit:
        _damage(spark, file)
    whole, lost = io.read_whole_files(spark, io.list_files(spark, f"{path}/*/*.parquet"), lines.schema)
    named = lost.where(F.col("n_read") < F.col("n_footer")).select("file").collect()  # one row a file
    if sorted(row["file"] for row in named) != hit:
        raise ValueError("the damaged files aren't those listed")
    return whole.groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("select count(*) as rows_read, 0::bigint as failed_tasks, true as done from lineitem")
def status_probe(spark, sf_dir):
    """What Spark's own tables say of a job over all lines."""
    from uuid import uuid4

    from tidegrid.sources import status

    group = f"probe-{uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "status probe")
    try:
        table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    found = status.stages(spark, group).where(F.col("status") != "SKIPPED")
    return found.agg(F.sum("input_rows").alias("rows_read"), F.sum("failed_tasks").cast("long").alias("failed_tasks"), F.every(F.col("completed_tasks") == F.col("tasks")).alias("done"))
