"""Operators that cut the data into ranges and blocks agree with their plain definitions,
also when one key holds much of the table, and plans stay what they should be."""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidepanel import catalog
from tidepanel.operators import bootstrap, features, metrics, ordered, report, series
from tidepanel.operators.ordered import halo_blocks, ordered_index, prefix_sums
from tidepanel.plans.prepare import prepare
from tidepanel.spec import PanelSpec


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; one holds two thirds of the rows. Some values are missing."""
    draw = random.Random(7)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else f"g{i % 2}"
        rows.append((group, i, None if draw.random() < 0.05 else round(draw.gauss(10, 3), 1)))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "grp string, i bigint, y double")


def test_ordered_index_numbers_every_row(skewed):
    got = ordered_index(skewed, ["grp", "i"], "p").orderBy("p").collect()
    assert [row.p for row in got] == list(range(900))
    assert [(row.grp, row.i) for row in got] == sorted((row.grp, row.i) for row in got)


def test_ordered_index_of_an_empty_table(skewed):
    assert ordered_index(skewed.where("i < 0"), ["grp", "i"], "p").count() == 0


def test_prefix_sums_add_what_comes_before(skewed):
    rows = prefix_sums(skewed.where("y IS NOT NULL"), ["y", "grp", "i"], {"before": F.col("i")})
    total = 0
    for row in rows.orderBy("y", "grp", "i").collect():
        assert row.before == total
        total += row.i


@pytest.mark.parametrize("block_rows, halo", [(10, 3), (4, 9), (1, 2)])
def test_blocks_hold_their_look_back(spark, block_rows, halo):
    blocks = halo_blocks(spark.range(57).withColumnRenamed("id", "p"), "p", block_rows, halo)
    assert blocks.where("_own").count() == 57
    members = {}
    for row in blocks.collect():
        members.setdefault(row._block, set()).add(row.p)
    for row in blocks.where("_own").collect():
        assert set(range(max(0, row.p - halo), row.p + 1)) <= members[row._block]


@pytest.mark.parametrize("block_rows", [7, 50, 10_000])
def test_blocked_features_equal_whole_group_windows(skewed, block_rows):
    spec = PanelSpec(date="i", target="y", group="grp", components=(), n_lags=9)
    plain = features.with_past(skewed, spec)
    long_groups = PanelSpec(date="i", target="y", group="grp", components=(), n_lags=9, grain="row")
    blocked = features.with_past(skewed, long_groups, block_rows=block_rows)
    rounded = [[F.round(c, 9).alias(c) if c.startswith("rolling") else c for c in df.columns] for df in (plain, blocked)]
    plain, blocked = plain.select(rounded[0]), blocked.select(rounded[1])
    assert plain.exceptAll(blocked).count() == 0 and blocked.count() == 900


def test_a_later_value_never_changes_an_earlier_feature(skewed):
    spec = PanelSpec(date="i", target="y", group="grp", components=(), n_lags=3)
    changed = skewed.withColumn("y", F.when(F.col("i") >= 600, -1000.0).otherwise(F.col("y")))
    before, after = (features.with_past(df, spec).where("i <= 600").drop("y") for df in (skewed, changed))
    assert before.exceptAll(after).count() == 0


def test_preparation_is_the_same_at_both_grains(spark, sf_dir, prepared):
    panel = catalog.suppliers(spark, sf_dir)
    long_groups = prepare(panel, replace(catalog.SUPPLIER, grain="row")).rows
    sides = [
        df.select(*[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in sorted(prepared.rows.dtypes)])
        for df in (prepared.rows, long_groups)
    ]
    assert sides[0].exceptAll(sides[1]).count() == 0 and sides[1].count() == 706


def direct_acf(values, lags):
    e = np.array(values) - np.mean(values)
    return [float((e[k:] * e[: len(e) - k]).sum() / (e * e).sum()) for k in range(lags + 1)]


@pytest.mark.parametrize("block_rows", [11, 10_000])
def test_autocorrelation_over_blocks(skewed, block_rows):
    rows = series.autocorrelation(skewed, "y", ["grp", "i"], block_rows=block_rows).orderBy("lag").collect()
    kept = sorted((r.grp, r.i, r.y) for r in skewed.collect() if r.y is not None)
    assert [r.acf for r in rows] == pytest.approx(direct_acf([y for _, _, y in kept], 20), abs=1e-12)
    assert rows[1].upper == pytest.approx(1.959964 / len(kept) ** 0.5)
    assert rows[2].upper == pytest.approx(1.959964 * ((1 + 2 * rows[1].acf ** 2) / len(kept)) ** 0.5)


def test_autocorrelation_per_group_over_blocks(skewed):
    rows = series.autocorrelation(skewed, "y", ["i"], ["grp"], max_lag=5, block_rows=13).collect()
    for group in ("hot", "g0", "g1"):
        kept = [y for _, y in sorted((r.i, r.y) for r in skewed.collect() if r.y is not None and r.grp == group)]
        got = [r.acf for r in sorted((r for r in rows if r.grp == group), key=lambda r: r.lag)]
        assert got == pytest.approx(direct_acf(kept, 5), abs=1e-12)


def test_autocorrelation_of_a_short_series(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "i int, e double")
    assert [r.lag for r in series.autocorrelation(df, "e", ["i"]).orderBy("lag").collect()] == [0, 1, 2]


def test_area_under_roc_counts_pairs(skewed):
    df = skewed.where("y IS NOT NULL").withColumn("label", (F.col("i") % 4 == 0).cast("int"))
    rows = df.collect()
    positives, negatives = ([r.y for r in rows if r.label == c] for c in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    assert metrics.roc_auc(df, "label", "y").first().roc_auc == pytest.approx(wins / len(positives) / len(negatives))


def test_month_quantiles_are_exact(skewed):
    dated = skewed.withColumn("date", F.make_date(F.lit(2020), F.when(F.col("grp") == "hot", 1).otherwise(6), F.lit(1)))
    for row in report.month_box(dated, "date", "y").collect():
        values = [r.y for r in dated.where(F.month("date") == row.month).collect() if r.y is not None]
        assert [row.q1, row.median, row.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_bootstrap_interval_is_where_theory_puts_it(spark):
    draw = np.random.default_rng(3)
    values = draw.normal(50, 10, 400)
    df = spark.createDataFrame([(str(i), "2020-01-01", float(v)) for i, v in enumerate(values)], "k string, d string, y double")
    df = df.withColumn("d", F.to_date("d"))
    row = report.trend_interval(df, "d", "k", ["y"]).first()
    half = 1.96 * values.std() / 20
    assert row.lower == pytest.approx(values.mean() - half, abs=0.2)
    assert row.upper == pytest.approx(values.mean() + half, abs=0.2)


def test_bootstrap_replicates_are_weighted_means(spark, monkeypatch):
    """Every replicate of every date against plain sums, also with nulls, a null date and sums handed on early."""
    monkeypatch.setattr(bootstrap, "ROWS_PER_STEP", 7)
    monkeypatch.setattr(bootstrap, "DATES_HELD", 2)
    rows = [(f"k{i}", None if i % 11 == 0 else i % 5, None if i % 4 == 0 else i / 3, float(-i)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, d int, a double, b double").repartition(3)
    got = {(r.d, r._replicate): r for r in bootstrap.replicate_sums(df, "d", "k", ["a", "b"], 10).collect()}
    assert len(got) == 6 * 10
    steps = [int(s, 16) for s in bootstrap.poisson_steps()]
    for (date, replicate), row in got.items():
        sums = [0.0] * 4
        for key, d, a, b in rows:
            if d == date:
                digest = hashlib.md5(f"{key}|{replicate // 4}".encode()).hexdigest()
                u = int(digest[8 * (replicate % 4) : 8 * (replicate % 4) + 8], 16)
                w = sum(u >= s for s in steps)
                for i, v in enumerate((a, b)):
                    if v is not None:
                        sums[2 * i] += w * v
                        sums[2 * i + 1] += w
        assert [row._sum0, row._weight0, row._sum1, row._weight1] == pytest.approx(sums)


def test_bootstrap_repeats_no_row(spark):
    df = spark.range(1000).selectExpr("string(id) AS k", "date'2020-01-01' AS d", "double(id) AS y")
    plan = executed_plan(report.trend_interval(df, "d", "k", ["y"]))
    # The only rows that are multiplied are one per date and replicate.
    assert plan.index("Generate") < plan.index("MapInArrow") and plan.count("Generate") == plan.count("inline(")
    assert report.trend_interval(df.where("false"), "d", "k", ["y"]).count() == 0


def test_poisson_steps_are_a_distribution_function():
    steps = [int(s, 16) / 2**32 for s in bootstrap.poisson_steps()]
    assert steps == sorted(steps) and steps[0] == pytest.approx(0.36787944)
    mean = sum(1 - s for s in steps)  # sum of the tail probabilities
    assert mean == pytest.approx(1.0, abs=1e-8)


# --- plans ------------------------------------------------------------------


def executed_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_split_scans_the_facts_once(spark, sf_dir):
    plan = executed_plan(entry.queries()["time_split"](spark, sf_dir))
    assert len(re.findall("FileScan", plan)) == 1 and "ReusedExchange" in plan


def test_scan_reads_only_the_panel_columns(spark, sf_dir):
    plan = executed_plan(entry.queries()["global_mean_series"](spark, sf_dir))
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_returnflag", "l_shipdate"}
    # No distinct count is left, so the panel costs one shuffle.
    assert "l_orderkey" not in plan


def test_features_share_one_window_and_stay_in_the_jvm(spark, sf_dir):
    plan = executed_plan(entry.queries()["feature_frame"](spark, sf_dir))
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_group_filter_reaches_the_scan(spark, sf_dir):
    plan = executed_plan(catalog.lagged(spark, sf_dir).where("grp = 3"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_suppkey,3\)", plan)


def test_bundle_reader_skips_the_other_side(spark, prepared, tmp_path):
    from tidepanel.sources import files

    files.write_bundle(prepared.rows, str(tmp_path / "rows"))
    plan = executed_plan(files.read_bundle(spark, str(tmp_path / "rows"), "test"))
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan)


RANGED = ("long_group_features", "label_codes", "roc_auc", "residual_acf", "residual_acf_by_group", "month_box", "month_outliers", "cv_folds_row")


@pytest.mark.parametrize("name", RANGED)
def test_ordered_queries_compare_no_row_with_ranges(spark, sf_dir, name):
    plan = executed_plan(entry.queries()[name](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "TakeOrdered" not in plan


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 10)
    assert ordered.range_count(spark.range(1_000)) == 100
    assert ordered.range_count(spark.range(10_000)) == 1_000


def test_pairs_of_forecasts_are_one_aggregate(spark, sf_dir):
    plan = executed_plan(entry.queries()["dm_test"](spark, sf_dir))
    assert "Window" not in plan


def test_scatter_bins_count_every_row(spark):
    rows = [(1.0, -0.5), (2.0, 1.0), (-1.0, 3.0), (0.0, 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    got = {(r.actual_bin, r.predicted_bin): r.n for r in report.scatter_bins(df, "y", "p", bins=3).collect()}
    assert sum(got.values()) == 4 and got[(0, -1)] == 1 or got[(1, -1)] == 1
    below = spark.createDataFrame([(-1.0, -2.0), (0.0, -1.0)], "y double, p double")
    assert report.scatter_bins(below, "y", "p").agg(F.sum("n")).first()[0] == 2


def test_models_are_compared_on_common_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, 2.0)], "y double, a double, b double")
    assert {r.n for r in metrics.metrics_by_model(df, "y", ["a", "b"]).collect()} == {1}
