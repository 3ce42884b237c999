"""Quantiles from sketches against sorted values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import report, sketches

LEVELS = {"least": 0.0, "low": 0.05, "median": 0.5, "high": 0.99, "most": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    """Four months with very different spreads; the first holds two thirds of the rows."""
    month = F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 4 + 1)
    rows = spark.range(60_000, numPartitions=7).select(
        F.make_date(F.lit(2020) + F.col("id") % 5, month, F.lit(1)).alias("date"),
        F.exp(F.randn(5) * month).alias("y"),
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, float("nan")).otherwise(F.col("id")).alias("z"),
    )
    return rows.cache()


def by_month(values, column):
    rows = values.select(F.month("date").alias("month"), column).where(f"{column} IS NOT NULL AND NOT isnan({column})")
    return {k: np.sort(part.to_numpy()) for k, part in rows.toPandas().groupby("month")[column]}


def off_by(ordered, value, level):
    """How far the level is from the ranks that the value holds, as a share."""
    first, last = (np.searchsorted(ordered, value, side) / len(ordered) for side in ("left", "right"))
    return max(0.0, first - level, level - last)


@pytest.mark.parametrize("size", [64, 1024])
@pytest.mark.parametrize("stored", [False, True])
def test_ranks_are_within_the_stated_error(values, size, stored):
    if stored:
        parts = sketches.value_sketches(values, ["date"], ["y", "z"], size)
        held = sketches.merged(parts.withColumn("month", F.month("date")), ["month"], ["y", "z"], size)
    else:
        held = sketches.value_sketches(values.withColumn("month", F.month("date")), ["month"], ["y", "z"], size)
    got = sketches.quantiles(held, ["month"], ["y", "z"], LEVELS).collect()
    assert len(got) == 8
    for column in ("y", "z"):
        truth = by_month(values, column)
        for r in (r for r in got if r.measure == column):
            ordered = truth[r.month]
            assert r.n == len(ordered) and (r.least, r.most) == (ordered[0], ordered[-1])
            assert max(off_by(ordered, r[n], q) for n, q in LEVELS.items()) <= sketches.rank_error(size)


def test_few_values_are_exact(values):
    few = values.where("y > 30").withColumn("month", F.month("date"))
    got = sketches.quantiles(sketches.value_sketches(few, ["month"], ["y"]), ["month"], ["y"], LEVELS).collect()
    truth = by_month(few, "y")
    assert {r.month for r in got} == set(truth) and all(r.n <= sketches.SIZE for r in got)
    for r in got:
        assert [r[n] for n in LEVELS] == [np.quantile(truth[r.month], q, method="inverted_cdf") for q in LEVELS.values()]


def test_groups_without_values(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf"))], "g int, v double")
    got = {r.g: (r.n, r.q1) for r in sketches.quantiles(sketches.value_sketches(rows, ["g"], ["v"]), ["g"], ["v"]).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (1, float("inf"))}
    whole = sketches.quantiles(sketches.value_sketches(rows.where("g > 3"), [], ["v"]), [], ["v"]).collect()
    assert [(r.n, r.median) for r in whole] == [(0, None)]
    assert sketches.value_sketches(rows.where("g > 3"), ["g"], ["v"]).count() == 0


def test_boxes_from_sketches(values):
    exact = report.month_box(values, "date", "y").collect()
    got = report.month_box(values, "date", "y", sketch_size=1024)
    truth = by_month(values, "y")
    for r, e in zip(got.collect(), exact, strict=True):
        ordered = truth[r.month]
        assert (r.month, r.month_name, r.n) == (e.month, e.month_name, e.n)
        for name, level in sketches.QUARTILES.items():
            assert off_by(ordered, r[name], level) <= sketches.rank_error(1024)
        reach = report.WHISKER_REACH * (r.q3 - r.q1)
        inside = ordered[(ordered >= r.q1 - reach) & (ordered <= r.q3 + reach)]
        assert (r.whisker_low, r.whisker_high, r.n_outliers) == (inside[0], inside[-1], len(ordered) - len(inside))


def test_sketches_are_merged_map_side(values):
    plan = sketches.value_sketches(values, ["date"], ["y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_kll_sketch_agg_double") == 1 and "Sort [" not in plan
