"""Score tables: one pass of mergeable aggregates each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import aggregates as agg
from tidepanel.operators.ordered import prefix_sums

DM_SIGNIFICANT = 1.96  # 95 % point the test statistic is compared with


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, MAE, RMSE and R2 over the rows that have both values."""
    a, p = F.col(actual), F.col(predicted)
    scored = df.where(a.isNotNull() & p.isNotNull())
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        agg.mean_absolute_error(a, p).alias("mae"),
        agg.root_mean_squared_error(a, p).alias("rmse"),
        agg.r_squared(a, p).alias("r2"),
    )


def metrics_by_model(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """The same per model column, over the rows that every model forecasts."""
    long = df.dropna(subset=[actual, *models]).unpivot([actual], list(models), "model", "predicted")
    return regression_metrics(long, actual, "predicted", ["model"])


def mean_baseline(df: DataFrame, actual: str, name: str = "mean_forecast") -> DataFrame:
    """Add the mean of the actual values as a constant forecast."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(actual).alias(name))))


def dm_tests(df: DataFrame, actual: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, dm_stat, dm_significant): whether the two forecasts of each pair differ in accuracy.

    Negative means the first is better. A pair counts the rows that have both
    forecasts; all pairs are one aggregate.
    """
    tests = [
        F.struct(
            F.lit(f"{first} vs {second}").alias("pair"),
            agg.diebold_mariano(F.col(actual), F.col(first), F.col(second)).alias("dm_stat"),
        )
        for first, second in pairs
    ]
    rows = df.agg(F.array(*tests).alias("_tests")).select(F.inline("_tests"))
    return rows.withColumn("dm_significant", F.abs("dm_stat") > DM_SIGNIFICANT)


def dm_test(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    """The same for one pair: (dm_stat, dm_significant)."""
    return dm_tests(df, actual, [(first, second)]).drop("pair")


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        agg.accuracy(y, p).alias("accuracy"),
        agg.precision(y, p).alias("precision"),
        agg.recall(y, p).alias("recall"),
        agg.f1(y, p).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, tied scores counting half; NULL with one class only.

    Rows are counted per distinct score before any ordering, so a score shared
    by much of the table is one row. Each positive beats the negatives below
    its score and half of those at its score.
    """
    positive = F.col(label) == 1
    counted = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    )
    placed = prefix_sums(counted, ["score"], {"below": F.col("negatives")})
    beaten = F.sum(F.col("positives") * (F.col("below") + F.col("negatives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return placed.agg(F.try_divide(beaten, pairs).alias("roc_auc"))
