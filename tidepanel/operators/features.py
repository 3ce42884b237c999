"""Past-only features: calendar, lags, rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.scalars import coerce_number, is_december, month_start, nan_to_null, parse_date
from tidepanel.operators.ordered import halo_blocks, ordered_index
from tidepanel.spec import (
    COMPONENT_LAGS,
    EXOGENOUS_LAGS,
    RENAMES,
    ROLLING_MEANS,
    ROLLING_STDS,
    PanelSpec,
)

BLOCK_ROWS = 10_000


def clean_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Give the panel its types and names: dates, numeric target, NULL for NaN."""
    df = df.withColumnsRenamed({old: new for old, new in RENAMES.items() if old in df.columns})
    types = dict(df.dtypes)
    columns = {}
    if types[spec.target] == "string":
        columns[spec.target] = coerce_number(F.col(spec.target))
    for name, kind in types.items():
        if kind in ("double", "float"):
            columns[name] = nan_to_null(F.col(name).cast("double"))
    if spec.grain == "month":
        columns[spec.date] = month_start(F.col(spec.date))
    elif types[spec.date] == "string":
        columns[spec.date] = parse_date(F.col(spec.date))
    return df.withColumns(columns)


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_december": is_december(date),
    }


def lag_columns(column: str, distances, order: WindowSpec, stem: str) -> dict[str, Column]:
    return {f"{stem}_{k}": F.lag(column, k).over(order) for k in distances}


def _mean(values: Sequence[Column]) -> Column:
    return reduce(add, values) / len(values)


def _sample_std(values: Sequence[Column]) -> Column:
    mean = _mean(values)
    return F.sqrt(reduce(add, [(v - mean) * (v - mean) for v in values]) / (len(values) - 1))


def rolling_columns(past: Sequence[Column]) -> dict[str, Column]:
    """Rolling statistics from the values 1, 2, ... rows back.

    A missing value makes the sum NULL, so a window counts only when it is full.
    Plain arithmetic on the lags needs no window frame of its own.
    """
    means = {f"rolling_mean_{k}": _mean(past[:k]) for k in ROLLING_MEANS}
    stds = {f"rolling_std_{k}": _sample_std(past[:k]) for k in ROLLING_STDS}
    return means | stds


def past_columns(df: DataFrame, spec: PanelSpec, order: WindowSpec) -> DataFrame:
    """Add all look-back features the panel's columns allow, on one window specification."""
    target_lags = max(spec.n_lags, *ROLLING_MEANS, *ROLLING_STDS)
    lags = lag_columns(spec.target, range(1, target_lags + 1), order, "lag")
    for measure, name in ((spec.admissions, "admissions"), (spec.weight, "headcount")):
        if measure in df.columns:
            lags |= lag_columns(measure, EXOGENOUS_LAGS, order, f"{name}_lag")
    for component in spec.present_components(df.columns):
        lags |= lag_columns(component, COMPONENT_LAGS, order, f"{component}_lag")
    rolling = rolling_columns([F.col(f"lag_{k}") for k in range(1, target_lags + 1)])
    only_for_rolling = [f"lag_{k}" for k in range(spec.n_lags + 1, target_lags + 1)]
    return df.withColumns(lags).withColumns(rolling).drop(*only_for_rolling)


def _unrepeated(spec: PanelSpec, order: WindowSpec) -> Column:
    """The date, or an error where the row before or after in the group has the same.

    Both rows raise, since a filter may leave one of them out before this is worked out.
    """
    date = F.col(spec.date)
    message = f"{spec.group} and {spec.date} must be unique together"
    repeated = (F.lag(date).over(order) == date) | (F.lead(date).over(order) == date)
    return F.when(repeated, F.raise_error(F.lit(message))).otherwise(date)


def with_past(df: DataFrame, spec: PanelSpec, block_rows: int = BLOCK_ROWS, tie_break=()) -> DataFrame:
    """Add the look-back features of every row.

    Without a ``tie_break`` a key that repeats raises, since look-backs would
    depend on the row order; the check shares the window of the features.

    At month grain one window per group does it. At row grain a group may hold
    any share of the table, so rows are positioned by (group, date), cut into
    blocks that overlap by the longest look-back, and windowed per block.
    """
    order_by = [spec.date, *tie_break]
    if spec.grain == "month":
        order = Window.partitionBy(spec.group).orderBy(*order_by)
        past = past_columns(df.withColumn("_checked", _unrepeated(spec, order)), spec, order)
        return _checked(past, spec, tie_break)
    placed = ordered_index(df, [spec.group, *order_by], "_position")
    blocks = halo_blocks(placed, "_position", block_rows, spec.longest_look_back)
    order = Window.partitionBy("_block", spec.group).orderBy(*order_by)
    past = past_columns(blocks.withColumn("_checked", _unrepeated(spec, order)), spec, order)
    return _checked(past.where("_own"), spec, tie_break).drop("_position", "_block", "_own")


def _checked(past: DataFrame, spec: PanelSpec, tie_break) -> DataFrame:
    return (past if tie_break else past.withColumn(spec.date, F.col("_checked"))).drop("_checked")


def feature_frame(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Features of every row that has its whole look-back and no missing input."""
    clean = clean_panel(df, spec)
    with_calendar = clean.withColumns(calendar_columns(F.col(spec.date)))
    return with_past(with_calendar, spec).dropna("any")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once; a panel must have none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys) -> None:
    """Raise when a key occurs twice: look-backs would then depend on the row order."""
    found = duplicate_keys(df, keys).take(3)
    if found:
        raise ValueError(f"{list(keys)} must be unique; repeated: {[tuple(row) for row in found]}")
