"""Exploration of the whole panel's mean series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidepanel.operators.features import clean_panel
from tidepanel.operators.series import mean_series, regular_months, seasonal_decompose
from tidepanel.spec import PanelSpec


@dataclass(frozen=True)
class Exploration:
    trend: DataFrame
    regular: DataFrame
    decomposition: DataFrame


def explore(df: DataFrame, spec: PanelSpec) -> Exploration:
    """Mean target per month, the gap-free series, and its seasonal decomposition.

    Needs a date and a target column only. The decomposition is empty when
    there are fewer than two years of months.
    """
    spec = spec.resolve(df.columns, grouped=False)
    trend = mean_series(clean_panel(df, spec), spec.date, spec.target)
    regular = regular_months(trend)
    return Exploration(trend.orderBy("date"), regular, seasonal_decompose(regular))
