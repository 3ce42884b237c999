"""Files: standard CSV quoting, bundles that know their columns, folders that go when a step ends."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from tidepanel import storage
from tidepanel.plans import prepare, workflow
from tidepanel.plans.explore import explore
from tidepanel.sources import files
from tidepanel.spec import PanelSpec

HARD = ['a "b", c', 'x,"', '""', " padded ", "tab\there", "é漢", "'"]
SCHEMA = "i int, t string, y double"


def test_quotes_and_commas_round_trip(spark, tmp_path):
    rows = [(i, t, i / 2) for i, t in enumerate(HARD)] + [(99, None, None)]
    df = spark.createDataFrame(rows[:-1] + [(99, "", None)], SCHEMA)
    files.write_csv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/t", SCHEMA).collect())) == rows


def test_a_file_of_another_writer_is_read(spark, tmp_path):
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as out:
        csv.writer(out).writerows([["i", "t", "y"], [1, 'a "b", c', 1.5], [2, "plain", ""]])
    rows = [tuple(r) for r in files.read_csv(spark, str(path), SCHEMA).collect()]
    assert rows == [(1, 'a "b", c', 1.5), (2, "plain", None)]


def test_line_breaks_need_multi_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "l\nm\r\nn", 1.0)], SCHEMA)
    with pytest.raises(Exception, match="line break"):
        files.write_csv(df, f"{tmp_path}/a")
    files.write_csv(df, f"{tmp_path}/b", multi_line=True)
    assert files.read_csv(spark, f"{tmp_path}/b", SCHEMA, multi_line=True).first().t.replace("\r\n", "\n") == "l\nm\nn"


def test_a_line_that_does_not_fit_raises(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,t,y\n1,a,not a number\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "t.csv"), SCHEMA).collect()


def test_lines_that_do_not_fit_go_aside(spark, tmp_path):
    lines = ["1,a,1.5", "2,b,not a number", "3,c", "4,d,1,5", "x,e,1", '5,"f, ""g""",', "6,,2"]
    (tmp_path / "t.csv").write_text("\n".join(["i,t,y", *lines]) + "\n")
    rows, rejected = files.split_csv(spark, f"{tmp_path}/t.csv", SCHEMA, f"{tmp_path}/out")
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 1.5), (5, 'f, "g"', None), (6, None, 2.0)]
    assert sorted(r.line for r in rejected.collect()) == sorted(lines[1:5])
    clash = "i int, line string, fits double"
    rows, rejected = files.split_csv(spark, f"{tmp_path}/t.csv", clash, f"{tmp_path}/clash")
    assert rows.columns == ["i", "line", "fits"] and (rows.count(), rejected.columns, rejected.count()) == (3, ["line"], 4)
    (tmp_path / "none.csv").write_text("i,t,y\n")
    rows, rejected = files.split_csv(spark, f"{tmp_path}/none.csv", SCHEMA, f"{tmp_path}/none")
    assert rows.count() == rejected.count() == 0


def test_a_panel_with_broken_lines_is_loaded_in_one_read(spark, tmp_path):
    lines = [f"2020-{m:02d}-01,a{g},{m}.5,{g}" for g in range(3) for m in range(1, 13)]
    broken = ["2021-01-01,a0,much,1", "2021-02-01,a0"]
    (tmp_path / "p.csv").write_text("\n".join(["date,area,turnover,headcount", *lines, *broken]) + "\n")
    spec = PanelSpec(date="date", target="turnover", group="area")
    schema = "date date, area string, turnover double, headcount int"
    panel = workflow.load_panel(spark, f"{tmp_path}/p.csv", spec, schema, out=f"{tmp_path}/loaded")
    assert panel.count() == len(lines) and str(tmp_path / "loaded" / "rows") in panel.inputFiles()[0]
    assert sorted(r.line for r in workflow.rejected_lines(spark, f"{tmp_path}/loaded").collect()) == broken
    with pytest.raises(ValueError, match="schema"):
        workflow.load_panel(spark, f"{tmp_path}/p.csv", spec, out=f"{tmp_path}/loaded")


@pytest.fixture(scope="module")
def discovered(spark):
    """A panel whose date and target columns must be found by their names."""
    draw = random.Random(4)
    rows = [
        (f"g{g}", f"{2019 + i // 12}-{i % 12 + 1:02d}-01", float(draw.randint(0, 9)), draw.randint(1, 9))
        for g in range(4)
        for i in range(30)
    ]
    return spark.createDataFrame(rows, "area string, ref_date string, turnover_rate double, headcount int")


def test_a_discovered_panel_comes_back(spark, discovered, tmp_path):
    spec = PanelSpec(group="area", n_lags=6)
    workflow.preparation(discovered, spec, str(tmp_path))
    ready = prepare.load_prepared(spark, str(tmp_path))
    assert ready.keys == ["area", "ref_date"] and ready.spec.target == "turnover_rate" and ready.spec.n_lags == 6
    assert ready.rows.count() == 4 * 24
    again = prepare.load_prepared(spark, str(tmp_path), spec)
    assert again.keys == ready.keys


def test_exploration_needs_no_group(spark, discovered, tmp_path):
    panel = discovered.drop("area")
    assert explore(panel, PanelSpec()).trend.count() == 30
    workflow.exploration(panel, PanelSpec(), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/decomposition").count() == 30


@pytest.mark.parametrize("grain", ["month", "row"])
def test_preparation_refuses_repeated_keys(discovered, grain):
    doubled = discovered.unionAll(discovered.where("area = 'g1'"))
    with pytest.raises(Exception, match="must be unique"):
        prepare.prepare(doubled, PanelSpec(group="area", n_lags=6, grain=grain))


def test_days_of_one_month_are_repeated_keys(discovered):
    daily = discovered.unionAll(discovered.withColumn("ref_date", F.regexp_replace("ref_date", "-01$", "-15")))
    with pytest.raises(Exception, match="must be unique"):
        prepare.prepare(daily, PanelSpec(group="area", n_lags=6))


def test_a_step_leaves_no_intermediate_tables(spark):
    with storage.step(spark):
        kept = storage.materialise(spark.range(5), "five")
        (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
        assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_classification_from_folder_to_folder(spark, prepared, tmp_path):
    workflow.classification(prepared, f"{tmp_path}/c", high=33.0, params={"numTrees": 3, "maxDepth": 3})
    scores = files.read_json(spark, f"{tmp_path}/c/metrics").first()
    assert scores.n == prepared.test.count() and 0 <= scores.f1 <= 1
    assert spark.read.parquet(f"{tmp_path}/c/scored").count() == scores.n
    workflow.explanation(prepared, "classifier", f"{tmp_path}/c/model", f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e/first_row").count() == len(prepared.features)
