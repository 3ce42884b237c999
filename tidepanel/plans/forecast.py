"""Train, compare, evaluate and explain models on a prepared panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import attribution, metrics, report
from tidepanel.operators.models import ForecastSpec, boosting_params, fit, predict, predict_class
from tidepanel.operators.series import autocorrelation
from tidepanel.plans.prepare import Prepared, written
from tidepanel.storage import materialise

# The three slots of a comparison; parameters a caller gives override the defaults.
COMPARED = {"RandomForest": "forest", "GradientBoosting": "boosted", "Linear": "linear"}
PRIMARY = "GradientBoosting"


@dataclass(frozen=True)
class Trained:
    model: Model
    scored: DataFrame
    metrics: DataFrame


def scored_test(prepared: Prepared, models: Mapping[str, Model], log_target: bool = False) -> DataFrame:
    """(group, date, actual, weight, naive, one column per model) over the test side."""
    scored = prepared.test
    for name, model in models.items():
        scored = predict(model, scored, prepared.features, name, log_target)
    return scored.select(
        *prepared.keys, F.col(prepared.spec.target).alias("actual"), "weight", "naive", *models
    )


def train_forecast(
    prepared: Prepared, settings: Mapping[str, object] | None = None, rounds: int = 100
) -> Trained:
    """Weighted boosted trees on the log target, with settings as a search finds them."""
    spec = ForecastSpec(
        "boosted",
        boosting_params(settings or {}, rounds),
        label=prepared.spec.target,
        weight="weight",
        log_target=True,
    )
    return train(prepared, spec)


def train(prepared: Prepared, spec: ForecastSpec, name: str = "prediction") -> Trained:
    model = fit(prepared.train, prepared.features, spec, prepared.keys, prepared.laid_out)
    scored = scored_test(prepared, {name: model}, spec.log_target)
    return Trained(model, scored, metrics.regression_metrics(scored, "actual", name))


def train_classifier(
    train_rows: DataFrame,
    test_rows: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    label: str,
    params: Mapping[str, object] | None = None,
) -> Trained:
    """Random-forest classifier of a 0/1 label, scored with and without threshold."""
    model = fit(train_rows, features, ForecastSpec("classifier", params or {}, label=label), keys)
    scored = predict_class(model, test_rows, features).select(*keys, label, "predicted", "probability")
    scored = materialise(scored, "scored")
    table = metrics.classification_metrics(scored, label, "predicted").crossJoin(
        F.broadcast(metrics.roc_auc(scored, label, "probability"))  # one row
    )
    return Trained(model, scored, table)


@dataclass(frozen=True)
class Comparison:
    models: Mapping[str, Model]
    scored: DataFrame
    metrics: DataFrame

    def weighted(self) -> DataFrame:
        """Exposure-weighted actual and primary forecast per date, with the residual."""
        series = report.weighted_series(self.scored, "date", ["actual", PRIMARY], "weight")
        return report.weighted_residuals(series, "actual", PRIMARY)

    def trend(self) -> DataFrame:
        values = ["actual", PRIMARY]
        interval = report.trend_interval(self.scored, "date", "grp", values)
        return report.trend_mean(self.scored, "date", values).join(interval, ["date", "type"])

    def scatter(self) -> DataFrame:
        return report.scatter_bins(self.scored, "actual", PRIMARY)

    def seasonality(self) -> DataFrame:
        return report.month_box(self.scored, "date", "actual")


def compare_models(prepared: Prepared, params: Mapping[str, Mapping[str, object]] | None = None) -> Comparison:
    """Fit the three models on the raw target and score them side by side.

    Training rows are laid out and scored rows written once; every report table
    aggregates the latter.
    """
    prepared = written(prepared)
    models = {}
    for name, kind in COMPARED.items():
        spec = ForecastSpec(kind, (params or {}).get(name, {}), label=prepared.spec.target)
        models[name] = fit(prepared.train, prepared.features, spec, prepared.keys, prepared.laid_out)
    named = scored_test(prepared, models).withColumnsRenamed(
        {prepared.spec.date: "date", prepared.spec.group: "grp"}
    )
    scored = materialise(named, "scored")
    return Comparison(models, scored, metrics.metrics_by_model(scored, "actual", list(models)))


def evaluation_report(scored: DataFrame, predicted: str, order_by: Sequence[str]) -> DataFrame:
    """One row: MAE, RMSE, the accuracy test against the mean forecast, and the lag-1 residual
    autocorrelation with its upper band. Reads ``scored`` several times: pass a written table."""
    with_mean = metrics.mean_baseline(scored, "actual")
    residuals = scored.withColumn("residual", F.col("actual") - F.col(predicted))
    acf = autocorrelation(residuals, "residual", order_by)
    first = acf.agg(
        F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("acf_1"),
        F.max(F.when(F.col("lag") == 1, F.col("upper"))).alias("acf_1_bound"),
    )
    return (
        metrics.regression_metrics(scored, "actual", predicted)
        .crossJoin(F.broadcast(metrics.dm_test(with_mean, "actual", predicted, "mean_forecast")))
        .crossJoin(F.broadcast(first))
    )


def explain(prepared: Prepared, model: Model) -> DataFrame:
    """Attributions of every test row (wide)."""
    return attribution.attributions(prepared.test, model, prepared.features, prepared.keys)


def with_label(prepared: Prepared, name: str, condition) -> Prepared:
    """Add a 0/1 label for classification."""
    return replace(prepared, rows=prepared.rows.withColumn(name, condition.cast("int")))
