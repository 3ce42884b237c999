"""Label codes and standard scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ordered import ordered_index

UNKNOWN_CODE = -1  # of a label that was not there when the codes were fitted


def label_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """(label, code): 0-based place of each distinct label in code point order."""
    labels = df.select(F.col(column).cast("string").alias("label")).distinct()
    return ordered_index(labels, ["label"], "_place").select(
        "label", F.col("_place").cast("int").alias(code)
    )


def add_label_code(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Look the labels up. The map grows with the data, so its size decides the join."""
    lookup = codes.select(F.col("label").alias("_label"), code)
    return df.join(lookup, F.col(column).cast("string") == F.col("_label"), "left").drop("_label")


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: position, mean, population deviation, scale (1 for a constant)."""
    moments = train.selectExpr(*[f"struct(avg(`{c}`) AS mean, stddev_pop(`{c}`) AS std) AS `{c}`" for c in columns])
    entries = [f"struct({i} AS position, '{c}' AS feature, `{c}` AS fitted)" for i, c in enumerate(columns)]
    return moments.selectExpr(f"inline(array({', '.join(entries)}))").selectExpr(
        "position", "feature", "fitted.mean", "fitted.std", "if(fitted.std = 0, 1D, fitted.std) AS scale"
    )


def scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise ``columns`` with fitted statistics; one row of them reaches every task.

    The row holds reciprocals, so that the wide projection stays a short method.
    """
    fitted = stats.agg(
        F.map_from_entries(F.collect_list(F.expr("struct(feature, struct(mean, 1 / scale AS factor))"))).alias("_fit")
    ).selectExpr(*[f"_fit['{c}'].{part} AS `_{part}_{c}`" for c in columns for part in ("mean", "factor")])
    scaled = {c: f"(`{c}` - `_mean_{c}`) * `_factor_{c}` AS `{c}`" for c in columns}
    return df.crossJoin(F.broadcast(fitted)).selectExpr(*[scaled.get(c, f"`{c}`") for c in df.columns])
