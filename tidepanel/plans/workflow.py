"""The whole analysis of one panel file, step by step, from folder to folder.

Each step reads what the steps before it wrote, so any of them can be repeated
alone. Tables are Parquet, metrics and settings JSON, prediction detail CSV.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import attribution
from tidepanel.operators.features import clean_panel, require_unique
from tidepanel.operators.models import ForecastSpec, load_model, predict
from tidepanel.plans import forecast, prepare, search
from tidepanel.plans.explore import explore
from tidepanel.plans.forecast import PRIMARY
from tidepanel.sources import files
from tidepanel.spec import PanelSpec
from tidepanel.storage import materialise, step


def load_panel(
    spark: SparkSession, path: str, spec: PanelSpec, schema=None, multi_line: bool = False, out: str | None = None
) -> DataFrame:
    """A panel from CSV (by file name) or Parquet, checked to have one row per group and date.

    Without a schema a CSV file is read once more to infer it. With a schema, a
    line that does not fit it raises, unless ``out`` is given: then the file is
    read once, its rows go to ``out``/rows, and the lines that do not fit to
    ``out``/rejected, for ``rejected_lines``.
    """
    if not path.endswith(".csv"):
        panel = spark.read.parquet(path)
    elif out is None:
        panel = files.read_csv(spark, path, schema, multi_line)
    elif schema is None:
        raise ValueError("lines can only be rejected against a schema")
    else:
        panel, rejected = files.split_csv(spark, path, schema, f"{out}/rows", multi_line)
        files.write_table(rejected, f"{out}/rejected")
    resolved = spec.resolve(panel.columns)
    require_unique(clean_panel(panel, resolved), [resolved.group, resolved.date])
    return panel


def rejected_lines(spark: SparkSession, out: str) -> DataFrame:
    """The lines that ``load_panel`` rejected, in column ``line``."""
    return spark.read.schema("line string").parquet(f"{out}/rejected")


def exploration(panel: DataFrame, spec: PanelSpec, out: str) -> None:
    found = explore(panel, spec)
    files.write_table(found.trend, f"{out}/trend")
    files.write_table(found.decomposition, f"{out}/decomposition")


def preparation(panel: DataFrame, spec: PanelSpec, out: str) -> None:
    with step(panel.sparkSession):
        prepare.save_prepared(prepare.prepare(panel, spec), out)


def comparison(prepared: prepare.Prepared, out: str, params: Mapping[str, Mapping[str, object]] | None = None) -> None:
    """Three models side by side and the tables behind the six report figures."""
    with step(prepared.rows.sparkSession):
        compared = forecast.compare_models(prepared, params)
        files.write_json(compared.metrics, f"{out}/metrics")
        files.write_csv(compared.scored, f"{out}/predictions")
        files.write_table(compared.weighted(), f"{out}/weighted")
        files.write_table(compared.trend(), f"{out}/trend")
        files.write_table(compared.scatter(), f"{out}/scatter")
        files.write_table(compared.seasonality(), f"{out}/seasonality")
        wide = forecast.explain(prepared, compared.models[PRIMARY])
        files.write_table(attribution.global_importance(wide, prepared.features), f"{out}/importance")


def tuning(
    prepared: prepare.Prepared,
    out: str,
    n_splits: int = 5,
    n_iter: int = 20,
    space: Mapping[str, Sequence[str]] = search.SEARCH_SPACE,
    **scoring,
) -> None:
    """Search the boosting settings; write the scores, the best settings and the refitted model.

    ``scoring`` goes on to the search: scorer, score_name and greater_is_better.
    """
    spark = prepared.rows.sparkSession
    with step(spark):
        base = ForecastSpec("boosted", label=prepared.spec.target, weight="weight", log_target=True)
        drawn = search.random_candidates(search.param_grid(spark, space), n_iter)
        found = search.search(prepared, base, [row.asDict() for row in drawn.collect()], n_splits, **scoring)
        files.write_table(found.scores, f"{out}/scores")
        files.write_params(spark, found.best, f"{out}/best_params")
        files.save_model(search.refit_best(prepared, base, found), f"{out}/model")


def training(prepared: prepare.Prepared, out: str, params_path: str | None = None, rounds: int = 100) -> None:
    """The final weighted log-target model, with settings a search wrote if there are any."""
    spark = prepared.rows.sparkSession
    with step(spark):
        settings = files.read_params(spark, params_path) if params_path else {}
        trained = forecast.train_forecast(prepared, settings, rounds)
        files.save_model(trained.model, f"{out}/model")
        files.write_json(trained.metrics, f"{out}/metrics")


def classification(
    prepared: prepare.Prepared, out: str, high: float, params: Mapping[str, object] | None = None
) -> None:
    """A classifier of months whose target is ``high`` or more: model, metrics and scored test rows."""
    with step(prepared.rows.sparkSession):
        ready = forecast.with_label(prepared, "label", F.col(prepared.spec.target) >= high)
        trained = forecast.train_classifier(ready.train, ready.test, ready.features, ready.keys, "label", params)
        files.save_model(trained.model, f"{out}/model")
        files.write_json(trained.metrics, f"{out}/metrics")
        files.write_table(trained.scored, f"{out}/scored")


def evaluation(prepared: prepare.Prepared, model_path: str, out: str) -> None:
    """Metrics on the rate scale and the residual autocorrelation of a saved final model."""
    with step(prepared.rows.sparkSession):
        model = load_model("boosted", model_path)
        scored = materialise(forecast.scored_test(prepared, {"prediction": model}, log_target=True), "scored")
        files.write_json(forecast.evaluation_report(scored, "prediction", prepared.keys), f"{out}/metrics")
        residuals = scored.withColumn("residual", F.col("actual") - F.col("prediction"))
        files.write_table(forecast.autocorrelation(residuals, "residual", prepared.keys), f"{out}/residual_acf")


def application(
    spark: SparkSession, panel: DataFrame, prepared_path: str, model_path: str, out: str, kind: str = "boosted"
) -> None:
    """Forecasts of new months: a saved preparation and a saved final model, nothing fitted again.

    What the next month will look back on is written beside the forecasts, as a preparation of its own.
    """
    with step(spark):
        fitted = prepare.load_preparation(spark, prepared_path)
        rows = prepare.apply_preparation(fitted, panel)
        scored = predict(load_model(kind, model_path), rows, fitted.features, "prediction", log_target=True)
        keys = [fitted.spec.group, fitted.spec.date]
        files.write_table(scored.select(*keys, "weight", "naive", "prediction"), f"{out}/forecasts")
        prepare.save_preparation(prepare.advance(fitted, panel), f"{out}/preparation")


def explanation(prepared: prepare.Prepared, kind: str, model_path: str, out: str) -> None:
    """How a saved tree model uses its features: summary over the test side, and one row in detail."""
    with step(prepared.rows.sparkSession):
        model = load_model(kind, model_path)
        wide = materialise(forecast.explain(prepared, model), "attributions")
        files.write_table(attribution.attribution_summary(wide, prepared.features), f"{out}/summary")
        files.write_table(
            attribution.explain_row(prepared.test, model, prepared.features, prepared.keys), f"{out}/first_row"
        )
