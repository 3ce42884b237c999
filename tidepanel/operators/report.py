"""The tables behind the report's figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.aggregates import weighted_mean
from tidepanel.functions.scalars import month_name, residual_sign
from tidepanel.operators.bootstrap import replicate_sums
from tidepanel.operators.ordered import prefix_sums
from tidepanel.operators.sketches import QUARTILES, quantiles, value_sketches
from tidepanel.storage import materialise

WHISKER_REACH = 1.5  # in interquartile ranges
AXIS_HEADROOM = 1.05
BOOT_REPLICATES = 1000
BOOT_LEVELS = (0.025, 0.975)


def attach_exposure(predictions: DataFrame, panel: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Look up each prediction's weight by key; 1 where the panel has none."""
    weights = panel.select(*keys, F.col(weight).cast("double").alias("_weight"))
    return (
        predictions.join(weights, list(keys), "left")
        .withColumn(weight, F.coalesce("_weight", F.lit(1.0)))
        .drop("_weight")
    )


def weighted_series(df: DataFrame, date: str, values: Sequence[str], weight: str) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(date).agg(*[weighted_mean(F.col(v), w).alias(v) for v in values])


def weighted_residuals(series: DataFrame, actual: str, predicted: str) -> DataFrame:
    residual = F.col(actual) - F.col(predicted)
    return series.withColumn("residual", residual).withColumn("sign", residual_sign(F.col("residual")))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], kind: str = "type", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), kind, value)


def trend_mean(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    return melt(df, [date], values).groupBy(date, "type").agg(F.avg("value").alias("mean"))


def trend_interval(
    df: DataFrame,
    date: str,
    row_key: str,
    values: Sequence[str],
    replicates: int = BOOT_REPLICATES,
) -> DataFrame:
    """95 % bootstrap interval of the mean per date and value column.

    Each row gets an independent Poisson(1) weight per replicate, drawn from a
    hash of its key, so the resample needs no shared random state and adds up
    map-side: a row takes part in all replicates as one vector of weights.
    ``(date, row_key)`` must identify a row.
    """
    key = F.concat_ws("|", F.col(row_key).cast("string"), F.col(date).cast("string"))
    sums = replicate_sums(df.withColumn("_key", key), date, "_key", values, replicates)
    means = [
        F.struct(F.lit(v).alias("type"), F.try_divide(f"_sum{i}", f"_weight{i}").alias("_mean"))
        for i, v in enumerate(values)
    ]
    # `replicates` values per (date, type): a bounded exact percentile.
    return (
        sums.select(date, F.inline(F.array(*means)))
        .groupBy(date, "type")
        .agg(F.percentile("_mean", list(BOOT_LEVELS)).alias("_ends"))
        .select(date, "type", F.col("_ends")[0].alias("lower"), F.col("_ends")[1].alias("upper"))
    )


def _month_values(df: DataFrame, date: str, value: str) -> DataFrame:
    """(month, value, count, rank, n): each distinct value of a calendar month
    with the first rank it holds there.

    Equal values are counted first and the counts accumulated in global
    (month, value) order by value ranges, so no task holds a whole month.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.month(date).alias("month"), F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    placed = prefix_sums(counted, ["month", "value"], {"_before": F.col("count")})
    sizes = placed.groupBy("month").agg(F.min("_before").alias("_start"), F.sum("count").alias("n"))
    return placed.join(F.broadcast(sizes), "month").select(  # twelve rows
        "month", "value", "count", (F.col("_before") - F.col("_start")).alias("rank"), "n"
    )


def _month_quantiles(values: DataFrame, levels: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per month, exact for months of any size."""
    picks = []
    for name, level in levels.items():
        place = (F.col("n") - 1) * F.lit(level)
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            covers = (F.col("rank") <= rank) & (rank < F.col("rank") + F.col("count"))
            picks.append(F.max(F.when(covers, F.col("value"))).alias(f"_{name}_{end}"))
    quantiles = []
    for name, level in levels.items():
        place = (F.col("n") - 1) * F.lit(level)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        quantiles.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return values.groupBy("month").agg(F.max("n").alias("n"), *picks).select("month", "n", *quantiles)


def _with_reach(box: DataFrame) -> DataFrame:
    spread = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    return box.withColumns({"_low": F.col("q1") - spread, "_high": F.col("q3") + spread})


def month_box(df: DataFrame, date: str, value: str, sketch_size: int | None = None) -> DataFrame:
    """Box statistics per calendar month, January first: quartiles, whiskers, outlier count.

    Quartiles are exact and interpolated. With ``sketch_size`` they are values out of
    a sketch of that size, within its ``rank_error``: the rows are read twice and
    never ordered or written. Whiskers and outliers are exact for the quartiles.
    """
    if sketch_size is None:
        values = materialise(_month_values(df, date, value), "month-values")
        quartiles = _month_quantiles(values, QUARTILES)
    else:
        values = df.where(F.col(value).isNotNull()).select(
            F.month(date).alias("month"), F.col(value).alias("value"), F.lit(1).alias("count")
        )
        sketched = value_sketches(values, ["month"], ["value"], sketch_size)
        # Written, since a sketch samples anew each time it is made: a box and its whiskers need the same one.
        quartiles = materialise(quantiles(sketched, ["month"], ["value"], QUARTILES).drop("measure"), "quartiles")
    box = _with_reach(quartiles)
    inside = (F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))
    ends = (
        values.join(F.broadcast(box.select("month", "_low", "_high")), "month")  # twelve rows
        .groupBy("month")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("_first"),
            F.max(F.when(inside, F.col("value"))).alias("_last"),
            F.sum(F.when(inside, 0).otherwise(F.col("count"))).alias("n_outliers"),
        )
    )
    return (
        box.join(F.broadcast(ends), "month")  # twelve rows
        .select(
            "month",
            month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1))).alias("month_name"),
            "n",
            "q1",
            "median",
            "q3",
            # A whisker never ends inside the box.
            F.least("_first", "q1").alias("whisker_low"),
            F.greatest("_last", "q3").alias("whisker_high"),
            "n_outliers",
        )
        .orderBy("month")
    )


def month_outliers(df: DataFrame, date: str, value: str) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges from their calendar month's box."""
    box = _month_quantiles(_month_values(df, date, value), {"q1": 0.25, "q3": 0.75})
    reach = _with_reach(box).select("month", "_low", "_high")
    outside = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    rows = df.withColumn("month", F.month(date))
    return rows.join(F.broadcast(reach), "month").where(outside).drop("_low", "_high")  # twelve rows


def axis_bound(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: the end of the identity line, a little above the largest value."""
    return df.agg((F.greatest(F.max(actual), F.max(predicted)) * AXIS_HEADROOM).alias("bound"))


def scatter_bins(df: DataFrame, actual: str, predicted: str, bins: int = 20) -> DataFrame:
    """Actual against predicted as counts on a bins x bins grid from 0 to the axis bound.

    Values below 0 lie outside the axes, in bin -1; without a value above 0
    there is one bin from 0 on. A row without either value counts in no cell.
    """
    width = F.when(F.col("bound") > 0, F.col("bound") / bins)

    def cell(value: str) -> Column:
        place = F.coalesce(F.floor(F.col(value) / width).cast("int"), F.lit(0))
        return F.when(F.col(value) < 0, F.lit(-1)).otherwise(place)

    return (
        df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .crossJoin(F.broadcast(axis_bound(df, actual, predicted)))  # one row
        .withColumns({"actual_bin": cell(actual), "predicted_bin": cell(predicted)})
        .groupBy("actual_bin", "predicted_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("bound").alias("bound"))
    )
