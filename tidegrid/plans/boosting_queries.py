"""Queries that fit boosted trees, beside SQL that grows the same trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import boosting as bo
from tidegrid.operators import forecast as fc
from tidegrid.plans.model_queries import INPUTS, feature_rows
from tidegrid.plans.registry import query, r, table

#: Inputs of the trees that SQL grows too; 0 is missing.
LINE_INPUTS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _level(rows: str, name: str) -> str:
    """SQL of the best split of each node of ``rows`` (id, node, g, f, v), as ``name``_s, and of the rows below it, as ``name``."""
    return f"""{name}_h as (select node, f, v, sum(g) as g, count(*)::double as h from {rows} group by node, f, v),
{name}_c as (select node, f, v as cut, unnest([false, true]) as ml, sum(g) over a as lg, sum(h) over a as lh, coalesce(sum(g) filter (v is null) over w, 0) as mg, coalesce(sum(h) filter (v is null) over w, 0) as mh, sum(g) over w as ag, sum(h) over w as ah
  from {name}_h window w as (partition by node, f), a as (partition by node, f order by v nulls first rows between unbounded preceding and 1 preceding)),
{name}_l as (select node, f, cut, ml, ag, ah, case when ml then coalesce(lg, 0) else coalesce(lg, 0) - mg end as lg, case when ml then coalesce(lh, 0) else coalesce(lh, 0) - mh end as lh, mh from {name}_c where cut is not null and coalesce(lh, 0) > mh),
{name}_g as (select *, 0.5 * (lg * lg / (lh + 1) + (ag - lg) * (ag - lg) / (ah - lh + 1) - ag * ag / (ah + 1)) as gain from {name}_l where lh >= 1 and ah - lh >= 1),
{name}_s as (select * from {name}_g qualify row_number() over (partition by node order by gain desc, f, cut, ml) = 1),
{name}_at as (select id, s.node, case when v is null then s.ml else v < s.cut end as goes_left from {rows} r join {name}_s s on s.node = r.node and s.f = r.f),
{name} as (select r.id, case when goes_left then 2 * r.node + 1 else 2 * r.node + 2 end as node, r.g, r.f, r.v from {rows} r join {name}_at using (id))"""


_LINES = f"""p as (select row_number() over () as id, (select avg(l_extendedprice) from lineitem) - l_extendedprice as g, {", ".join(LINE_INPUTS)} from lineitem),
x as (select id, 0 as node, g, unnest(range({len(LINE_INPUTS)})) as f, unnest([{", ".join(f"nullif({c}, 0)::double" for c in LINE_INPUTS)}]) as v from p),
names as (select unnest(range({len(LINE_INPUTS)})) as f, unnest({LINE_INPUTS}) as feature), sq as (select sum(g * g) as sq from p)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_INPUTS, "l_extendedprice")


@query(f"""with {_LINES}, {_level("x", "a")}, {_level("a", "b")},
leaves as (select node, -sum(g) / (count(*) + 1) as value, count(*)::double as n from b where f = 0 group by node),
tops as (select node, -sum(g) / (count(*) + 1) as value, count(*)::double as n from x where f = 0 group by node union all select node, -sum(g) / (count(*) + 1), count(*)::double from a where f = 0 group by node),
splits as (select * from a_s union all select * from b_s)
select t.node::int as node, feature, cut, ml as missing_left, round(gain / sq, 8) as gain, round(value, 3) + 0.0 as value, t.n as rows from tops t join splits using (node) join names using (f), sq
union all select node::int, null, null, false, 0.0, round(value, 3) + 0.0, n from leaves""")
def boosted_tree(spark, sf_dir):
    """The splits, ways for missing rows and leaf values of one tree of two levels."""
    rows = _lines(spark, sf_dir)
    model = bo.fit(rows, LINE_INPUTS, "l_extendedprice", bo.Settings(trees=1, depth=2, rate=1.0, missing=0.0))
    squares = rows.agg((F.var_pop("l_extendedprice") * F.count(F.lit(1))).alias("sq")).scalar()
    return bo.nodes(spark, model).select("node", "feature", "cut", F.coalesce("missing_left", F.lit(False)).alias("missing_left"), F.round(F.col("gain") / squares, 8).alias("gain"), (r("value", 3) + 0.0).alias("value"), "rows")


@query(f"""with {_LINES}, {_level("x", "a")},
v1 as (select node, -sum(g) / (count(*) + 1) as value from a where f = 0 group by node),
y as (select a.id, 0 as node, a.g + 0.3 * value as g, f, v from a join v1 using (node)), {_level("y", "b")},
v2 as (select node, -sum(g) / (count(*) + 1) as value from b where f = 0 group by node)
select 0 as tree, feature, cut, ml as missing_left, round((select value from v1 where node = 1), 3) as left_value, round((select value from v1 where node = 2), 3) as right_value from a_s join names using (f)
union all select 1, feature, cut, ml, round((select value from v2 where node = 1), 3), round((select value from v2 where node = 2), 3) from b_s join names using (f)""")
def boosted_stumps(spark, sf_dir):
    """Two rounds of one split each; the second is fitted to what the first leaves."""
    model = bo.fit(_lines(spark, sf_dir), LINE_INPUTS, "l_extendedprice", bo.Settings(trees=2, depth=1, rate=0.3, missing=0.0))
    n = bo.nodes(spark, model)
    value = lambda i: F.max(F.when(F.col("node") == i, F.round("value", 3)))
    return n.groupBy("tree").agg(F.max("feature").alias("feature"), F.max("cut").alias("cut"), F.bool_or("missing_left").alias("missing_left"), value(1).alias("left_value"), value(2).alias("right_value"))


@query()
def boosted_forecast(spark, sf_dir):
    """Demand of the last rows of each type by sampled boosted trees, at least 0."""
    rows = feature_rows(spark, sf_dir)
    model = bo.fit(rows.where("split = 'train'"), INPUTS, "demand", bo.Settings(trees=6, depth=5, rate=0.2, rows=0.85, columns=0.85, missing=0.0))
    test = bo.predict(rows.where("split = 'test'"), model).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
    return fc.model_metrics({"boosted_hist": test}, "demand")
