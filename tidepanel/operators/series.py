"""Operators on one series per key: regular months, decomposition, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.operators.ordered import halo_blocks, ordered_index

PERIOD = 12
SHORTEST_SERIES = 2 * PERIOD
MAX_ACF_LAG = 20
NORMAL_95 = 1.959964  # two-sided 95 % point of the normal distribution
ACF_BLOCK_ROWS = 10_000


def mean_series(df: DataFrame, date: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per date (and key), the input of the other operators here."""
    return df.groupBy(*keys, date).agg(F.avg(value).alias("value")).withColumnRenamed(date, "date")


def _by_month(keys: Sequence[str]) -> WindowSpec:
    """Months in order within each key. A series has at most twelve rows a year,
    so even the single series without keys is a small window."""
    return Window.partitionBy(*keys).orderBy("date")


def regular_months(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every month between a series' first and last, a missing one with the last value before it."""
    spine = (
        series.groupBy(*keys)
        .agg(F.min("date").alias("first"), F.max("date").alias("last"))
        .where("first IS NOT NULL")
        .select(*keys, F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("date"))
    )
    filled = F.last("value", ignorenulls=True).over(_by_month(keys))
    return spine.join(series, [*keys, "date"], "left").select(*keys, "date", filled.alias("value"))


def seasonal_decompose(series: DataFrame, keys: Sequence[str] = (), period: int = PERIOD) -> DataFrame:
    """Additive decomposition of a regular series into trend, seasonal and residual.

    The trend is the centred moving average over one period (the two outermost
    months of an even period count half); the seasonal part is the mean of the
    detrended values per phase, centred to add up to 0. A series shorter than
    two periods gives no rows.
    """
    order = _by_month(keys)
    half = period // 2
    whole = order.rowsBetween(-half, half)
    numbered = series.withColumns(
        {
            "_phase": (F.row_number().over(order) - 1) % period,
            "_length": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    ).where(F.col("_length") >= 2 * period)
    if period % 2 == 0:
        inner = order.rowsBetween(1 - half, half - 1)
        average = (F.sum("value").over(whole) + F.sum("value").over(inner)) / (2 * period)
    else:
        average = F.avg("value").over(whole)
    complete = F.count("value").over(whole) == 2 * half + 1
    trended = numbered.withColumn("trend", F.when(complete, average))
    detrended = trended.withColumn("_detrended", F.col("value") - F.col("trend"))
    phase_mean = F.avg("_detrended").over(Window.partitionBy(*keys, "_phase"))
    first_of_phase = F.row_number().over(Window.partitionBy(*keys, "_phase").orderBy("date")) == 1
    phased = detrended.withColumns({"_mean": phase_mean, "_first": first_of_phase})
    level = F.avg(F.when(F.col("_first"), F.col("_mean"))).over(Window.partitionBy(*keys))
    return (
        phased.withColumn("seasonal", F.col("_mean") - level)
        .withColumn("resid", F.col("value") - F.col("trend") - F.col("seasonal"))
        .select(*keys, "date", F.col("value").alias("observed"), "trend", "seasonal", "resid")
    )


def autocorrelation(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    max_lag: int = MAX_ACF_LAG,
    block_rows: int = ACF_BLOCK_ROWS,
) -> DataFrame:
    """(keys, lag, acf, lower, upper) for lags 0 to max_lag (at most n - 1).

    Without keys the rows form one long series. Rows are positioned in order
    and cut into blocks overlapping by ``max_lag`` rows, so neither the whole
    table nor one long key is ever a single window. The band is Bartlett's for
    a series that is correlated up to the lag before.
    """
    kept = df.where(F.col(value).isNotNull()).select(*keys, *order_by, F.col(value).cast("double").alias("_e"))
    placed = ordered_index(kept, [*keys, *order_by], "_position")
    # Taking the overall mean off first keeps the sums below well conditioned.
    centre = placed.agg(F.avg("_e")).first()[0] or 0.0
    blocks = halo_blocks(placed.withColumn("_e", F.col("_e") - centre), "_position", block_rows, max_lag)
    before = Window.partitionBy("_block", *keys).orderBy(*order_by)
    past = {0: F.col("_e")} | {k: F.col(f"_past_{k}") for k in range(1, max_lag + 1)}
    rows = blocks.withColumns({f"_past_{k}": F.lag("_e", k).over(before) for k in past if k}).where("_own")
    # One row per key with the sums of every lag side by side, then a row per lag.
    sums = rows.groupBy(*keys).agg(
        *[F.count(p).alias(f"_pairs_{k}") for k, p in past.items()],
        *[F.sum(F.col("_e") * p).alias(f"_products_{k}") for k, p in past.items()],
        *[F.sum(F.col("_e") + p).alias(f"_both_{k}") for k, p in past.items()],
    )
    per_lag = [
        F.struct(
            F.lit(k).alias("lag"), *[F.col(f"{n}_{k}").alias(n) for n in ("_pairs", "_products", "_both")]
        )
        for k in past
    ]
    totals = sums.select(*keys, F.inline(F.array(*per_lag))).where("_pairs > 0")
    # max_lag + 1 rows per key from here on.
    series = Window.partitionBy(*keys)
    at_zero = [F.max(F.when(F.col("lag") == 0, F.col(c))).over(series) for c in ("_pairs", "_products", "_both")]
    mean = F.col("_sum") / F.col("_n")
    covariance = F.col("_products") - mean * F.col("_both") + F.col("_pairs") * mean * mean
    spread = F.col("_squares") - F.col("_sum") * mean
    correlated = totals.select(
        "*", at_zero[0].alias("_n"), at_zero[1].alias("_squares"), (at_zero[2] / 2).alias("_sum")
    ).withColumn("acf", F.try_divide(covariance, F.when(spread > 0, spread)))
    shorter = series.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(shorter)
    variance = F.when(F.col("lag") == 0, 0.0).otherwise((1 + 2 * F.coalesce(earlier, F.lit(0.0))) / F.col("_n"))
    banded = correlated.withColumn("_margin", NORMAL_95 * F.sqrt(variance))
    return banded.select(*keys, "lag", "acf", (-F.col("_margin")).alias("lower"), F.col("_margin").alias("upper"))
