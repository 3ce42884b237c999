"""Hand-made inputs with known results."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import aggregates as agg
from tidepanel.functions.scalars import coerce_number, from_log, nan_to_null, to_log
from tidepanel.operators import encode, features, metrics, report, series, split
from tidepanel.spec import PanelSpec, feature_columns

SPEC = PanelSpec(date="date", target="y", group="grp", components=())


def month(i: int) -> dt.date:
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


def monthly(spark, values, group="a"):
    rows = [(group, month(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "grp string, date date, y double")


def column(df, name, order="date"):
    return [row[name] for row in df.orderBy(order).collect()]


def test_rolling_mean_needs_a_full_window(spark):
    values = [float(i) if i != 5 else None for i in range(1, 13)]
    past = features.with_past(monthly(spark, values), SPEC)
    assert column(past, "rolling_mean_3") == [None, None, None, 2, 3, None, None, None, 7, 8, 9, 10]


def test_short_group_keeps_no_rows(spark):
    frame = features.feature_frame(monthly(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), SPEC)
    assert frame.count() == 0


def test_lag_counts_rows_not_months(spark):
    rows = [("a", month(0), 1.0), ("a", month(1), 2.0), ("a", month(3), 3.0)]
    past = features.with_past(spark.createDataFrame(rows, "grp string, date date, y double"), SPEC)
    assert column(past, "lag_1") == [None, 1.0, 2.0]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 4.0)], "c double, x double")
    stats = encode.scaler_stats(df, ["c", "x"])
    by_name = {row.feature: row for row in stats.collect()}
    assert by_name["c"].scale == 1.0
    assert by_name["x"].std == pytest.approx(1.247219128924647, abs=1e-15)
    assert {row.c for row in encode.scale(df, stats, ["c", "x"]).collect()} == {0.0}


def test_text_target(spark):
    texts = ["abc", "1,5", " 1.5 ", "NaN", "1.5d", "1e3", ".5", "-2.", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = column(df.select("i", coerce_number(F.col("t")).alias("y")), "y", "i")
    assert got == [0, 0, 1.5, 0, 0, 1000, 0.5, -2, 0, 0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    row = df.select(nan_to_null(F.col("x")).alias("x")).agg(F.avg("x").alias("m"), F.count("x").alias("n")).first()
    assert (row.m, row.n) == (1.0, 1)


def test_label_order_is_by_code_point(spark):
    df = spark.createDataFrame([(c,) for c in ["b", "B", "a", "10", "9", "é", "z", "a"]], "g string")
    codes = {row.label: row.code for row in encode.label_codes(df, "g").collect()}
    assert codes == {c: i for i, c in enumerate(["10", "9", "B", "a", "b", "z", "é"])}


def test_zero_weight_gives_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "x double, w double")
    assert df.agg(agg.weighted_mean(F.col("x"), F.col("w")).alias("m")).first().m is None


def test_equal_forecasts_do_not_differ(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (4.0, 5.0)], "y double, p double")
    row = metrics.dm_test(df, "y", "p", "p").first()
    assert (row.dm_stat, row.dm_significant) == (0.0, False)


def test_tied_scores_have_area_one_half(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (0, 0.3), (1, 0.3)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().roc_auc == 0.5


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().roc_auc is None


def test_nothing_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    assert row.accuracy == pytest.approx(1 / 3)


def test_constant_actual_scores(spark):
    exact = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    wrong = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert metrics.regression_metrics(exact, "y", "p").first().r2 == 1.0
    assert metrics.regression_metrics(wrong, "y", "p").first().r2 == 0.0


@pytest.mark.parametrize("months, rows", [(23, 0), (24, 24)])
def test_decomposition_needs_two_years(spark, months, rows):
    values = spark.createDataFrame([(month(i), float(i % 12)) for i in range(months)], "date date, value double")
    assert series.seasonal_decompose(values).count() == rows


def test_decomposition_recovers_line_and_season(spark):
    season = [math.sin(math.pi * k / 6) for k in range(12)]
    values = [(month(i), 3.0 + 0.5 * i + season[i % 12]) for i in range(48)]
    rows = series.seasonal_decompose(spark.createDataFrame(values, "date date, value double")).orderBy("date").collect()
    assert [row.trend is None for row in rows] == [i < 6 or i >= 42 for i in range(48)]
    for i, row in enumerate(rows):
        assert row.seasonal == pytest.approx(season[i % 12], abs=1e-12)
        if row.trend is not None:
            assert row.trend == pytest.approx(3.0 + 0.5 * i, abs=1e-12)
            assert row.resid == pytest.approx(0.0, abs=1e-12)


def test_missing_month_takes_the_value_before(spark):
    values = spark.createDataFrame([(month(0), 1.0), (month(3), 4.0)], "date date, value double")
    assert column(series.regular_months(values), "value") == [1.0, 1.0, 1.0, 4.0]


def test_log_target(spark):
    df = spark.createDataFrame([(0, -0.2), (1, math.log(3.0)), (2, float("nan")), (3, None)], "i int, p double")
    got = column(df.select("i", from_log(F.col("p")).alias("y")), "y", "i")
    assert got[0] == 0.0 and got[1] == pytest.approx(2.0) and math.isnan(got[2]) and got[3] is None


def test_log_target_refuses_minus_one(spark):
    df = spark.createDataFrame([(-1.0,)], "y double")
    with pytest.raises(Exception, match="above -1"):
        df.select(to_log(F.col("y"))).collect()


def test_fold_bounds(spark):
    bounds = split.fold_bounds(spark.createDataFrame([(13,)], "n bigint"), 5).orderBy("fold").collect()
    assert [(b.test_from, b.test_to) for b in bounds] == [(3, 5), (5, 7), (7, 9), (9, 11), (11, 13)]


def test_folds_train_on_the_past_only(spark):
    rows = monthly(spark, [float(i) for i in range(13)])
    folds = split.expanding_folds(split.number_dates(rows, "date"), "unit", 5)
    sides = folds.groupBy("fold").pivot("role", ["train", "test"]).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    for row in sides.collect():
        assert row.train_a == month(0) and row.train_b < row.test_a
        assert (row.test_a, row.test_b) == (month(3 + 2 * row.fold), month(4 + 2 * row.fold))


@pytest.mark.parametrize("grain", ["month", "row"])
def test_split_point_is_the_same_at_both_grains(spark, grain):
    df = monthly(spark, [0.0] * 17)
    assert split.split_point(df, "date", grain).first().split_date == month(13)


def test_number_dates_at_row_grain(spark):
    df = monthly(spark, [0.0] * 7).union(monthly(spark, [0.0] * 5, "b"))
    got = split.number_dates(df, "date", "row").select("date", "unit").distinct().orderBy("date").collect()
    assert [row.unit for row in got] == list(range(7))


def test_exposure_falls_back_to_one(spark):
    predictions = spark.createDataFrame([("a", month(0)), ("b", month(0))], "grp string, date date")
    panel = spark.createDataFrame([("a", month(0), 7)], "grp string, date date, headcount bigint")
    joined = report.attach_exposure(predictions, panel, ["grp", "date"], "headcount")
    assert {row.grp: row.headcount for row in joined.collect()} == {"a": 7.0, "b": 1.0}


def test_whisker_stays_outside_the_box(spark):
    rows = spark.createDataFrame([(month(0), v) for v in (0.0, 0.0, 0.0, 100.0)], "date date, y double")
    box = report.month_box(rows, "date", "y").first()
    assert (box.q3, box.whisker_high, box.n_outliers) == (25.0, 25.0, 1)
    assert box.month_name == "Jan"


def test_columns_are_found_by_name():
    spec = PanelSpec(group="area")
    found = spec.resolve(["area", "Reference_Date", "x", "Turnover_total", "turnover_2"])
    assert (found.date, found.target) == ("Reference_Date", "Turnover_total")
    with pytest.raises(ValueError, match="not found"):
        spec.resolve(["area", "x", "y"])


def test_leak_free_features_leave_the_month_out():
    columns = ["grp", "date", "y", "headcount", "vol", "month", "is_december", "lag_1", "vol_lag_1", "grp_encoded"]
    spec = PanelSpec(date="date", target="y", group="grp", components=("vol",))
    numeric, passed = feature_columns(columns, spec)
    assert numeric == ["month", "lag_1", "vol_lag_1"] and passed == ["grp_encoded", "is_december"]
    leaky = PanelSpec(date="date", target="y", group="grp", components=("vol",), leak_free=False)
    assert feature_columns(columns, leaky)[0] == ["headcount", "vol", "month", "lag_1", "vol_lag_1"]


def test_repeated_keys_are_refused(spark):
    df = monthly(spark, [1.0, 2.0]).union(monthly(spark, [3.0]))
    with pytest.raises(ValueError, match="must be unique"):
        features.require_unique(df, ["grp", "date"])
