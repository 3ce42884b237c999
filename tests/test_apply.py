"""A saved preparation applied to months it has not seen."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.encode import UNKNOWN_CODE
from tidepanel.operators.features import feature_frame
from tidepanel.operators.models import ForecastSpec
from tidepanel.plans import forecast, prepare, workflow
from tidepanel.sources.files import save_model
from tidepanel.spec import PanelSpec

SPEC = PanelSpec(date="date", target="y", group="grp", components=("part",), n_lags=3)
MONTHS = [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(24)]
CUT = MONTHS[18]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        (g, m, float((7 * i + len(g) * 3) % 11), 10 + i, i % 4, i / 2)
        for g in ("a", "b", "longer")
        for i, m in enumerate(MONTHS)
    ]
    columns = "grp string, date date, y double, headcount int, admissions int, part double"
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def fitted(spark, panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("preparation"))
    prepare.save_preparation(prepare.fit_preparation(panel.where(F.col("date") < CUT), SPEC), path)
    return prepare.load_preparation(spark, path)


def new(panel):
    return panel.where(F.col("date") >= CUT)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_features_go_on_from_the_history(panel, fitted):
    """The scaled features, turned back, are those of the whole panel's feature frame."""
    applied = prepare.apply_preparation(fitted, new(panel))
    back = {r.feature: (r["mean"], r.scale) for r in fitted.scaler.collect()}
    want = {(r.grp, r.date): r for r in feature_frame(panel, SPEC).where(F.col("date") >= CUT).collect()}
    got = applied.collect()
    assert len(got) == len(want) == 18
    for row in got:
        for name, (mean, scale) in back.items():
            assert row[name] * scale + mean == pytest.approx(want[row.grp, row.date][name])
        assert row.weight == want[row.grp, row.date].headcount and row.naive == want[row.grp, row.date].lag_1
    assert list(fitted.features) == applied.columns[5:]


def test_history_is_the_look_back_only(fitted):
    counts = {r.grp: r["count"] for r in fitted.history.groupBy("grp").count().collect()}
    assert counts == dict.fromkeys(("a", "b", "longer"), SPEC.longest_look_back)


def test_month_by_month_is_the_same_as_at_once(panel, fitted):
    at_once = rows_of(prepare.apply_preparation(fitted, new(panel)))
    one_by_one, state = [], fitted
    for month in MONTHS[18:]:
        rows = panel.where(F.col("date") == month)
        one_by_one += prepare.apply_preparation(state, rows).collect()
        state = prepare.advance(state, rows)
    assert sorted(map(tuple, one_by_one), key=str) == at_once


def test_months_without_a_target(panel, fitted):
    """The next month is forecast before its target, headcount or components are known."""
    month = panel.where(F.col("date") == CUT)
    known = prepare.apply_preparation(fitted, month)
    future = prepare.apply_preparation(fitted, month.select("grp", "date"))
    assert rows_of(future.select(*fitted.features)) == rows_of(known.select(*fitted.features))
    assert {(r.y, r.weight) for r in future.collect()} == {(None, 1.0)}


def test_unknown_and_short_groups(spark, panel, fitted):
    """A new group has no code; its first months have no look-back and are left out."""
    others = new(panel).withColumn("grp", F.lit("new")).dropDuplicates(["date"])
    assert prepare.apply_preparation(fitted, others.where(F.col("date") < MONTHS[20])).count() == 0
    longer = prepare.advance(fitted, panel.where(F.col("date") < CUT).where("grp = 'a'").withColumn("grp", F.lit("new")))
    coded = prepare.apply_preparation(longer, others).select("grp_encoded").distinct().collect()
    assert [r[0] for r in coded] == [UNKNOWN_CODE]


def test_text_targets_and_dates_in_the_month(panel, fitted):
    text = new(panel).select("grp", F.date_add("date", 9).alias("date"), F.col("y").cast("string").alias("y"), "headcount", "admissions", "part")
    assert rows_of(prepare.apply_preparation(fitted, text)) == rows_of(prepare.apply_preparation(fitted, new(panel)))


def test_a_month_that_is_in_the_history_raises(panel, fitted):
    again = panel.where(F.col("date") == MONTHS[17])
    with pytest.raises(Exception, match="must be unique together"):
        prepare.apply_preparation(fitted, again).collect()


def test_empty_tables(panel, fitted):
    none = panel.where("false")
    assert prepare.apply_preparation(fitted, none).count() == 0
    assert rows_of(prepare.advance(fitted, none).history) == rows_of(fitted.history)


def test_forecasts_of_new_months_from_saved_files(spark, panel, tmp_path):
    """The workflow's step: bundle and model from their folders, forecasts and the next history into another."""
    workflow.preparation(panel.where(F.col("date") < CUT), SPEC, f"{tmp_path}/prepared")
    ready = prepare.load_prepared(spark, f"{tmp_path}/prepared")
    spec = ForecastSpec("boosted", {"maxIter": 3, "maxDepth": 2}, label="y", log_target=True)
    save_model(forecast.train(ready, spec).model, f"{tmp_path}/model")
    workflow.application(spark, new(panel), f"{tmp_path}/prepared", f"{tmp_path}/model", f"{tmp_path}/out")
    forecasts = spark.read.parquet(f"{tmp_path}/out/forecasts")
    assert forecasts.count() == 18 and forecasts.where("prediction IS NULL OR prediction < 0").count() == 0
    after = prepare.load_preparation(spark, f"{tmp_path}/out/preparation")
    assert after.history.agg(F.max("date")).first()[0] == MONTHS[-1]
