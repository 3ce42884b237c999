"""Splits by time: train/test and expanding folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ordered import ordered_index

TRAIN_FRACTION = 0.8


def split_point(df: DataFrame, date: str, grain: str = "month", fraction: float = TRAIN_FRACTION) -> DataFrame:
    """One row with the first test date: the date at place floor(n * fraction) of n."""
    if grain == "month":
        # A set of month starts is bounded by the calendar, twelve a year.
        months = df.agg(F.sort_array(F.collect_set(date)).alias("months"))
        place = F.floor(F.size("months") * F.lit(fraction)).cast("int")
        return months.select(F.get("months", place).alias("split_date"))
    dates = ordered_index(df.select(date).distinct(), [date], "_place")
    place = dates.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("_first_test"))
    return (
        dates.crossJoin(F.broadcast(place))
        .where("_place = _first_test")
        .select(F.col(date).alias("split_date"))
    )


def time_split(df: DataFrame, date: str, point: DataFrame) -> DataFrame:
    """Mark each row 'train' (before the split date) or 'test'."""
    side = F.when(F.col(date) < F.col("split_date"), "train").otherwise("test")
    return df.crossJoin(F.broadcast(point)).withColumn("split", side).drop("split_date")


def split_summary(df: DataFrame, date: str, target: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(date).alias("n_dates"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.avg(target).alias("mean_target"),
    )


def fold_bounds(units: DataFrame, n_splits: int) -> DataFrame:
    """Expanding folds over n ordered units, from a one-row table with column ``n``.

    With size = n / (n_splits + 1) rounded down, the last ``n_splits * size``
    units are cut into test blocks and each fold trains on all units before its
    own block.
    """
    size = F.floor(F.col("n") / (n_splits + 1))
    return (
        units.select("n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
        .where("size > 0")
        .select(
            "fold",
            (F.col("n") - (n_splits - F.col("fold")) * F.col("size")).alias("test_from"),
            (F.col("n") - (n_splits - F.col("fold") - 1) * F.col("size")).alias("test_to"),
        )
    )


def number_dates(df: DataFrame, date: str, grain: str = "month", name: str = "unit") -> DataFrame:
    """Add the 0-based place of the row's date among the distinct dates."""
    if grain == "month":
        months = df.agg(F.sort_array(F.collect_set(date)).alias("_months"))  # calendar-bounded
        place = (F.array_position("_months", F.col(date)) - 1).alias(name)
        return df.crossJoin(F.broadcast(months)).select(*df.columns, place)
    return df.join(ordered_index(df.select(date).distinct(), [date], name), date)


def expanding_folds(df: DataFrame, unit: str, n_splits: int = 5) -> DataFrame:
    """(row, fold, role) for every fold a row takes part in, from a numbered table.

    The ``n_splits`` bounds are settings: they are read first and become part of the plan.
    """
    bounds = fold_bounds(df.agg((F.max(unit) + 1).alias("n")), n_splits).collect()
    folds = F.array(
        *[
            F.struct(
                F.lit(b.fold).cast("int").alias("fold"),
                F.lit(b.test_from).alias("test_from"),
                F.lit(b.test_to).alias("test_to"),
            )
            for b in bounds
        ]
    )
    if not bounds:
        return df.where("false").withColumns({"fold": F.lit(0), "role": F.lit("train")})
    taken = df.withColumn("_fold", F.explode(F.filter(folds, lambda f: F.col(unit) < f["test_to"])))
    role = F.when(F.col(unit) < F.col("_fold.test_from"), "train").otherwise("test")
    return taken.select(*df.columns, F.col("_fold.fold").alias("fold"), role.alias("role"))
