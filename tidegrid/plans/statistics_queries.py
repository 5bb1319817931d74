"""Tests of normality and mergeable percentiles, beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import normality as no
from tidegrid.operators import sketches as sk
from tidegrid.plans.registry import query, r, table
from tidegrid.sources import io

#: Acklam's approximation of the normal quantile, which shares nothing with the operator's but its target (relative error 1e-9).
_PROBIT = """case when p < 0.02425 then (((((-7.784894002430293e-03*l-3.223964580411365e-01)*l-2.400758277161838e+00)*l-2.549732539343734e+00)*l+4.374664141464968e+00)*l+2.938163982698783e+00) / ((((7.784695709041462e-03*l+3.224671290700398e-01)*l+2.445134137142996e+00)*l+3.754408661907416e+00)*l+1)
  when p > 1 - 0.02425 then -(((((-7.784894002430293e-03*l-3.223964580411365e-01)*l-2.400758277161838e+00)*l-2.549732539343734e+00)*l+4.374664141464968e+00)*l+2.938163982698783e+00) / ((((7.784695709041462e-03*l+3.224671290700398e-01)*l+2.445134137142996e+00)*l+3.754408661907416e+00)*l+1)
  else (((((-3.969683028665376e+01*q2+2.209460984245205e+02)*q2-2.759285104469687e+02)*q2+1.383577518672690e+02)*q2-3.066479806614716e+01)*q2+2.506628277459239e+00)*(p-0.5) / (((((-5.447609879822406e+01*q2+1.615858368580409e+02)*q2-1.556989798598866e+02)*q2+6.680131188771972e+01)*q2-1.328068155288572e+01)*q2+1) end"""


@query(f"""with v as (select o_orderpriority as priority, o_totalprice as v, row_number() over (partition by o_orderpriority order by ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint, o_orderkey) as rn from orders),
o as (select priority, v, count(*) over (partition by priority) as n, row_number() over (partition by priority order by v) as i from v where rn <= 1000),
p as (select *, (i - 0.375) / (n + 0.25) as p, sqrt(-2 * ln(least((i - 0.375) / (n + 0.25), 1 - (i - 0.375) / (n + 0.25)))) as l, ((i - 0.375) / (n + 0.25) - 0.5) ** 2 as q2 from o),
m as (select *, {_PROBIT} as m from p),
s as (select priority, n, sum(m * m) as ss, max(m) as m1, max(m) filter (i = n - 1) as m2, 1 / sqrt(n) as u from m group by 1, 2),
a as (select *, m1 / sqrt(ss) + 0.221157*u - 0.147981*u**2 - 2.07119*u**3 + 4.434685*u**4 - 2.706056*u**5 as a1, m2 / sqrt(ss) + 0.042981*u - 0.293762*u**2 - 1.752461*u**3 + 5.682633*u**4 - 3.582633*u**5 as a2 from s),
w as (select priority, n, sum(v * sign(2 * i - n - 1) * case when i in (1, n) then a1 when i in (2, n - 1) then a2 else abs(m) / sqrt((ss - 2*m1**2 - 2*m2**2) / (1 - 2*a1**2 - 2*a2**2)) end) ** 2 / (var_pop(v) * count(*)) as w from m join a using (priority, n) group by 1, 2),
z as (select *, (ln(1 - w) - (-1.5861 - 0.31082*ln(n) - 0.083751*ln(n)**2 + 0.0038915*ln(n)**3)) / exp(-0.4803 - 0.082676*ln(n) + 0.0030302*ln(n)**2) as z from w)
select priority, n, round(w, 6) as w, round((-z*z/2 - ln(z * sqrt(2 * pi())) + ln(1 - 1/z**2 + 3/z**4 - 15/z**6 + 105/z**8)) / ln(10), 2) as log10_p from z""")
def shapiro_wilk(spark, sf_dir):
    """A sampling operator: the test takes 1,000 values of each priority."""
    out = no.shapiro_wilk(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", ["o_orderpriority"], sample=1000)
    return out.select(F.col("o_orderpriority").alias("priority"), "n", r("w", 6).alias("w"), F.round(F.log10("p_value"), 2).alias("log10_p"))


@query("""with d as (select c_nationkey as k, c_acctbal as v from customer), m as (select k, count(*) as n, avg(v) as m, var_pop(v) as s2 from d group by 1),
c as (select k, n, avg((v - m) ** 3) / any_value(s2) ** 1.5 as skew, avg((v - m) ** 4) / any_value(s2) ** 2 - 3 as kurt from d join m using (k) group by 1, 2)
select k as nation, n, round(n / 6.0 * (skew * skew + kurt * kurt / 4), 5) as jb, round(exp(-n / 12.0 * (skew * skew + kurt * kurt / 4)), 6) as p_value from c""")
def jarque_bera_test(spark, sf_dir):
    out = no.jarque_bera_test(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"])
    return out.select(F.col("c_nationkey").alias("nation"), "n", r("jb", 5).alias("jb"), r("p_value", 6).alias("p_value"))


@query("""with v as (select s_acctbal as v from supplier), s as (select count(*) as n, avg(v) as m, stddev_samp(v) as sd from v),
u as (select v, (v - m) / sd / sqrt(2) as z, n, count(*) over (order by v) as upto, count(*) over (order by v) - count(*) over (partition by v) as below from v, s),
t as (select *, 1 / (1 + 0.3275911 * abs(z)) as t from u),
f as (select *, 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z))) as cdf from t),
d as (select any_value(n) as n, max(greatest(abs(upto / n - cdf), abs(cdf - below / n))) as d from f)
select n, round(d, 8) as ks, round(least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 1 else -1 end * exp(-2.0 * k * k * n * d * d)))), 6) as p_value from d""")
def ks_test(spark, sf_dir):
    return no.ks_test(table(spark, sf_dir, "supplier"), "s_acctbal").select("n", r("ks", 8).alias("ks"), r("p_value", 6).alias("p_value"))


@query("""with d as (select event_type, value as v from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20')
select event_type, count(v) as n, min(v) as lowest, quantile_disc(v, 0.25) as q25, quantile_disc(v, 0.5) as median, quantile_disc(v, 0.95) as q95, max(v) as highest, round(count_if(v <= 50) / count(v), 6) as below_50 from d group by 1""")
def merged_percentiles(spark, sf_dir):
    """Daily sketches of each type, stored, then merged over ten days; exact while a type has fewer values than ``k``."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path = io.scratch(spark, "sketches")
    sk.sketches(events, "value", ["day", "event_type"], k=16384).write.parquet(path)
    stored = spark.read.parquet(path).where("day >= date'2024-01-10' and day < date'2024-01-20'")
    found = sk.percentiles(stored, {"lowest": 0.0, "q25": 0.25, "median": 0.5, "q95": 0.95, "highest": 1.0}, ["event_type"])
    return found.join(sk.share_below(stored, 50.0, ["event_type"]).select("event_type", r("share", 6).alias("below_50")), "event_type")
