"""The steps from a CSV file to reports, with the extract's own column names."""

from __future__ import annotations

import math
import random

import pytest

from tidepanel.plans import prepare, workflow
from tidepanel.sources import files
from tidepanel.spec import PanelSpec
from tidepanel.storage import shared_folder

HEADER = [
    "MES_REF",
    "area_anonn",
    "TO_TURNOVER_TO-GERAL",
    "TO_HEADCOUNT_HEADCOUNT-MES-ATUAL",
    "TO_ADMISSOES_ADMISSOES-MES-ATUAL",
    "TO_TURNOVER_TO-VOL",
]


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    """Eight areas over 40 months; the target is text in places."""
    draw = random.Random(5)
    path = tmp_path_factory.mktemp("extract") / "panel.csv"
    lines = [",".join(HEADER)]
    for area in range(8):
        for i in range(40):
            rate = max(0.0, 4 + 3 * math.sin(i / 6 + area) + draw.gauss(0, 0.5))
            text = "n/a" if area == 0 and i == 3 else f"{rate:.3f}"
            cells = [f"{2020 + i // 12}-{i % 12 + 1:02d}-01", f"area {area}", text]
            cells += [str(draw.randint(5, 60)), str(draw.randint(0, 5)), f"{rate / 2:.3f}"]
            lines.append(",".join(cells))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_from_csv_to_reports(spark, extract, tmp_path):
    spec = PanelSpec(n_lags=6)
    panel = workflow.load_panel(spark, extract, spec)
    assert dict(panel.dtypes)["TO_TURNOVER_TO-GERAL"] == "string"

    workflow.exploration(panel, spec, f"{tmp_path}/eda")
    assert spark.read.parquet(f"{tmp_path}/eda/trend").count() == 40
    assert spark.read.parquet(f"{tmp_path}/eda/decomposition").count() == 40

    workflow.preparation(panel, spec, f"{tmp_path}/prepared")
    ready = prepare.load_prepared(spark, f"{tmp_path}/prepared", spec)
    assert ready.rows.count() == 8 * 34
    assert ready.features[-2:] == ("area_anonn_encoded", "is_december")
    assert "TO_TURNOVER_TO-VOL_lag_3" in ready.features and "TO_TURNOVER_TO-VOL" not in ready.features
    assert ready.rows.where("weight < 5").count() == 0

    space = {"n_estimators": ("2", "3"), "max_depth": ("2",), "gamma": ("0", "0.1")}
    workflow.tuning(ready, f"{tmp_path}/tuned", n_splits=2, n_iter=2, space=space)
    best = files.read_params(spark, f"{tmp_path}/tuned/best_params")
    assert set(best) == set(space)

    workflow.training(ready, f"{tmp_path}/final", f"{tmp_path}/tuned/best_params")
    scores = files.read_json(spark, f"{tmp_path}/final/metrics").first()
    workflow.evaluation(ready, f"{tmp_path}/final/model", f"{tmp_path}/evaluated")
    evaluated = files.read_json(spark, f"{tmp_path}/evaluated/metrics").first()
    assert evaluated.mae == pytest.approx(scores.mae) and evaluated.rmse == pytest.approx(scores.rmse)
    assert spark.read.parquet(f"{tmp_path}/evaluated/residual_acf").count() == 21

    workflow.explanation(ready, "boosted", f"{tmp_path}/final/model", f"{tmp_path}/explained")
    assert spark.read.parquet(f"{tmp_path}/explained/first_row").count() == len(ready.features)

    params = {"RandomForest": {"numTrees": 2, "maxDepth": 2}, "GradientBoosting": {"maxIter": 2, "maxDepth": 2}}
    workflow.comparison(ready, f"{tmp_path}/compared", params)
    detail = files.read_csv(spark, f"{tmp_path}/compared/predictions")
    assert detail.count() == ready.test.count()
    assert {"actual", "weight", "RandomForest", "GradientBoosting", "Linear"} <= set(detail.columns)
    for name in ("weighted", "trend", "scatter", "seasonality", "importance"):
        assert spark.read.parquet(f"{tmp_path}/compared/{name}").count() > 0


def test_saved_statistics_come_back(spark, prepared, tmp_path):
    prepare.save_prepared(prepared, str(tmp_path))
    loaded = prepare.load_prepared(spark, str(tmp_path), prepared.spec)
    assert loaded.features == prepared.features
    assert loaded.scaler.exceptAll(prepared.scaler).count() == 0
    assert loaded.codes.count() == 10


def test_scaled_training_features_are_standard(prepared):
    numeric = [f for f in prepared.features if f not in ("grp_encoded", "is_december")]
    row = prepared.train.selectExpr(*[f"avg(`{c}`)" for c in numeric], *[f"stddev_pop(`{c}`)" for c in numeric]).first()
    assert list(row)[: len(numeric)] == pytest.approx([0] * len(numeric), abs=1e-9)
    assert list(row)[len(numeric) :] == pytest.approx([1] * len(numeric))


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
