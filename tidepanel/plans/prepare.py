"""From a raw panel to model-ready rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators.encode import UNKNOWN_CODE, add_label_code, label_codes, scale, scaler_stats
from tidepanel.operators.features import calendar_columns, clean_panel, feature_frame, with_past
from tidepanel.operators.models import training_layout
from tidepanel.operators.split import split_point, time_split
from tidepanel.sources.files import read_bundle, read_params, write_bundle, write_params, write_table
from tidepanel.spec import PanelSpec, feature_columns
from tidepanel.storage import materialise


@dataclass(frozen=True)
class Preparation:
    """What is fitted on the months of a panel, to be applied to months that come later.

    ``history`` holds each group's last cleaned rows, as many as features look back on.
    """

    spec: PanelSpec
    features: tuple[str, ...]
    scaler: DataFrame
    codes: DataFrame
    history: DataFrame


@dataclass(frozen=True)
class Prepared:
    """Rows (key, label, weight, naive forecast, split, features) and what was fitted on them."""

    spec: PanelSpec
    rows: DataFrame
    features: tuple[str, ...]
    scaler: DataFrame
    codes: DataFrame
    laid_out: bool = False  # whether the rows are written in the training layout
    history: DataFrame | None = None  # none for bundles of earlier versions

    @property
    def keys(self) -> list[str]:
        return [self.spec.group, self.spec.date]

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("split = 'test'")


def row_weight(df: DataFrame, weight: str) -> Column:
    """The exposure as weight where it is known, else 1."""
    return F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in df.columns else F.lit(1.0)


def last_rows(clean: DataFrame, spec: PanelSpec) -> DataFrame:
    """The rows of each group that features of its next month look back on.

    They are ranked before the shuffle as well, so a group of any length is a few rows per task.
    """
    measures = [spec.target, spec.weight, spec.admissions, *spec.components]
    kept = clean.select(spec.group, spec.date, *[c for c in measures if c in clean.columns])
    latest = Window.partitionBy(spec.group).orderBy(F.desc(spec.date))
    return (
        kept.withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= spec.longest_look_back)
        .drop("_back")
    )


def fit_preparation(df: DataFrame, spec: PanelSpec) -> Preparation:
    """Label codes, scaling and history of all the months given, without a split."""
    spec = spec.resolve(df.columns)
    frame = materialise(feature_frame(df, spec), "features")
    numeric, passed = feature_columns([*frame.columns, spec.group_code], spec)
    return Preparation(
        spec,
        (*numeric, *passed),
        materialise(scaler_stats(frame, numeric), "scaler"),
        materialise(label_codes(frame, spec.group, spec.group_code), "codes"),
        materialise(last_rows(clean_panel(df, spec), spec), "history"),
    )


def _joined(fitted: Preparation, df: DataFrame) -> DataFrame:
    """New rows, cleaned, behind the history; ``_new`` marks them."""
    spec = fitted.spec
    if spec.target not in df.columns:  # months that are still to come
        df = df.withColumn(spec.target, F.lit(None).cast("double"))
    new = clean_panel(df, spec).withColumn("_new", F.lit(True))
    return new.unionByName(fitted.history.withColumn("_new", F.lit(False)), allowMissingColumns=True)


def apply_preparation(fitted: Preparation, df: DataFrame) -> DataFrame:
    """(key, label, weight, naive forecast, features) of new months, with what was fitted before.

    Look-backs go on from the history, and each new month looks back on the new
    months before it. Scaling and codes are the stored ones; a group without a
    code gets ``UNKNOWN_CODE``. The target may be missing, as it is before a
    month is over: the label is then NULL. Rows without their whole look-back
    (of groups that are too short or unknown) are left out. A month that the
    history holds already raises, since it would be counted twice.
    """
    spec = fitted.spec
    numeric = [f for f in fitted.features if f not in (spec.group_code, "is_december")]
    rows = _joined(fitted, df)
    past = with_past(rows.withColumns(calendar_columns(F.col(spec.date))), spec).where("_new").dropna(subset=[spec.date, *numeric])
    coded = add_label_code(past, spec.group, fitted.codes, spec.group_code).fillna(UNKNOWN_CODE, [spec.group_code])
    ready = coded.select(
        spec.group,
        spec.date,
        spec.target,
        row_weight(past, spec.weight).alias("weight"),
        F.col("lag_1").alias("naive"),
        *fitted.features,
    )
    return scale(ready, fitted.scaler, numeric)


def advance(fitted: Preparation, df: DataFrame) -> Preparation:
    """The same preparation with ``df`` as the latest months of its history; nothing is fitted again."""
    history = last_rows(_joined(fitted, df).drop("_new"), fitted.spec)
    return replace(fitted, history=materialise(history, "history"))


def prepare(df: DataFrame, spec: PanelSpec) -> Prepared:
    """Features, label codes, time split, weights, and scaling fitted on the train side only.

    The feature frame is written once, and so is what is fitted on it: the
    split date, the label codes and the scaler. A later pass over the rows is
    then a scan with a projection, and the windows run a single time. A group
    with two rows on one date (after dates are cut to the month) raises.
    """
    spec = spec.resolve(df.columns)
    frame = materialise(feature_frame(df, spec), "features")
    point = materialise(split_point(frame, spec.date, spec.grain), "split-point")
    sided = time_split(frame, spec.date, point)
    numeric, passed = feature_columns([*frame.columns, spec.group_code], spec)
    stats = materialise(scaler_stats(sided.where("split = 'train'"), numeric), "scaler")
    codes = materialise(label_codes(frame, spec.group, spec.group_code), "codes")
    ready = add_label_code(sided, spec.group, codes, spec.group_code).select(
        spec.group,
        spec.date,
        spec.target,
        row_weight(frame, spec.weight).alias("weight"),
        F.col("lag_1").alias("naive"),
        "split",
        *numeric,
        *passed,
    )
    history = last_rows(clean_panel(df, spec), spec)  # read when it is saved or applied
    return Prepared(spec, scale(ready, stats, numeric), (*numeric, *passed), stats, codes, history=history)


def feature_order(prepared: Prepared | Preparation) -> DataFrame:
    """(position, feature): model inputs in order, the scaled ones first."""
    scaled = prepared.scaler.select("position", "feature")
    passed = [f for f in prepared.features if f in (prepared.spec.group_code, "is_december")]
    entries = ", ".join(f"struct(int(n + {i}) AS position, '{f}' AS feature)" for i, f in enumerate(passed))
    rest = scaled.agg(F.count(F.lit(1)).alias("n")).selectExpr(f"inline(array({entries}))")
    return scaled.unionByName(rest)


def save_preparation(fitted: Prepared | Preparation, path: str) -> None:
    """What new months need; a bundle of prepared rows holds the same beside its rows."""
    write_table(fitted.scaler, f"{path}/scaler")
    write_table(fitted.codes, f"{path}/codes")
    write_table(feature_order(fitted), f"{path}/features")
    if fitted.history is not None:
        write_table(fitted.history, f"{path}/history")
    settings = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(fitted.spec).items() if v != ()}
    write_params(fitted.scaler.sparkSession, settings, f"{path}/spec")


def load_preparation(spark: SparkSession, path: str) -> Preparation:
    """What ``save_preparation`` or ``save_prepared`` wrote, to apply it to new months."""
    return Preparation(
        _saved_spec(spark, path),
        _saved_features(spark, path),
        *[spark.read.parquet(f"{path}/{name}") for name in ("scaler", "codes", "history")],
    )


def _saved_spec(spark: SparkSession, path: str) -> PanelSpec:
    found = read_params(spark, f"{path}/spec")
    return PanelSpec(**(found | {"components": tuple(found.get("components", ()))}))


def _saved_features(spark: SparkSession, path: str) -> tuple[str, ...]:
    order = spark.read.parquet(f"{path}/features").orderBy("position").collect()  # one row per feature
    return tuple(row.feature for row in order)


def save_prepared(prepared: Prepared, path: str) -> None:
    write_bundle(prepared.rows, f"{path}/rows")
    save_preparation(prepared, path)


def load_prepared(spark: SparkSession, path: str, spec: PanelSpec | None = None) -> Prepared:
    """What ``save_prepared`` wrote. The spec it was prepared with, with the columns that were
    found by name, lies beside the rows; a ``spec`` given here is only for bundles without one."""
    try:
        spec = _saved_spec(spark, path)
    except AnalysisException:
        if spec is None:
            raise
    try:
        history = spark.read.parquet(f"{path}/history")
    except AnalysisException:
        history = None
    return Prepared(
        spec,
        read_bundle(spark, f"{path}/rows"),
        _saved_features(spark, path),
        spark.read.parquet(f"{path}/scaler"),
        spark.read.parquet(f"{path}/codes"),
        history=history,
    )


def written(prepared: Prepared) -> Prepared:
    """The same preparation with its rows written in the training layout, for several fits on them."""
    if prepared.laid_out:
        return prepared
    rows = training_layout(prepared.rows, prepared.keys)
    return replace(prepared, rows=materialise(rows, "prepared"), laid_out=True)
