from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.functions.timebins import epoch, half_hour_slot, time_bin
from tidegrid.operators import features as ft
from tidegrid.operators import panel as pn
from tidegrid.operators.splits import canonical_split, rank_split

START = datetime(2024, 3, 10, 1, 0)


def panel_of(spark, values, key="a"):
    return spark.createDataFrame([(key, START + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "key string, bin timestamp_ntz, demand double")


def test_bins_keep_the_wall_clock(spark):
    times = [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 59, 59), datetime(1969, 12, 31, 23, 59, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in df.select(time_bin("ts", 1800)).collect()]
        assert got == [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 30)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in df.select(half_hour_slot("ts")).collect()] == [5, 3, 47]


def test_densify_fills_gaps_and_keeps_totals(spark):
    rows = [("a", START), ("a", START + timedelta(hours=5)), ("b", START + timedelta(hours=2)), ("b", START + timedelta(hours=2, minutes=10)), (None, START), ("a", None)]
    counts = pn.bin_counts(spark.createDataFrame(rows, "key string, ts timestamp_ntz"), "key", "ts", 3600)
    dense = pn.densify(counts, "key", 3600).toPandas()
    assert len(dense) == 2 * 6 and dense.demand.sum() == 4


def test_empty_panel(spark):
    counts = pn.bin_counts(spark.createDataFrame([], "key string, ts timestamp_ntz"), "key", "ts", 3600)
    assert pn.densify(counts, "key", 3600).count() == 0 and pn.active_by_span(counts, "key", 3600).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=3, max_size=70))
def test_features_by_hand(spark, values):
    w = ft.by_time("key")
    got = panel_of(spark, values).withColumns(ft.lags("demand", [1], w) | ft.rolling("demand", 5, w) | {"ewma": ft.ewma("demand", w)}).orderBy("bin").toPandas()
    for i in range(len(values)):
        past = values[max(0, i - 5) : i]
        assert got.roll_count[i] == len(past)
        if past:
            assert got.lag_1[i] == values[i - 1] and got.roll_mean[i] == pytest.approx(np.mean(past))
        want = sum(0.3 * 0.7 ** (k - 1) * values[i - k] for k in range(1, min(60, i) + 1))
        assert got.ewma[i] == pytest.approx(want)


def test_sequences_leave_the_current_row_out(spark):
    rows = ft.sequence_windows(panel_of(spark, range(10)), ["demand"], 4, ft.by_time("key")).orderBy("bin").collect()
    assert [x[0] for x in rows[0]["sequence"]] == [0, 1, 2, 3] and rows[0]["demand"] == 4 and len(rows) == 6


def test_zscore_of_a_constant_is_zero(spark):
    assert {r[0] for r in panel_of(spark, [3] * 5).select(ft.zscore("demand", "key")).collect()} == {0.0}


def test_splits(spark):
    rows = rank_split(panel_of(spark, range(10)), "key").orderBy("bin").collect()
    assert [r["split"] for r in rows] == ["train"] * 7 + ["test"] * 3
    df = spark.createDataFrame([(" Training",), ("VAL",), ("test",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(canonical_split(F.col("s"))).collect()] == ["train", "validation", "test", None, None]


def test_resample_size_is_arithmetic():
    assert pn.resample_seconds(5, 99 * 3600, 3600) == 3600
    n = pn.resample_seconds(10_000, 10**6 * 3600, 3600)
    assert (10**6 * 3600) // n + 1 <= 1201


def test_min_gap(spark):
    assert ft.min_gap_seconds(panel_of(spark, range(30))).first()[0] == 3600


def test_epoch_ignores_fraction(spark):
    assert spark.sql("select timestamp_ntz'1970-01-01 00:00:01.9' as t").select(epoch("t")).first()[0] == 1
