"""Models, search and attributions on the smallest supplier panel."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import catalog
from tidepanel.functions.aggregates import r_squared, weighted_mean
from tidepanel.operators import attribution, forest, metrics, models
from tidepanel.operators.models import ForecastSpec
from tidepanel.plans import forecast, search
from tidepanel.plans.prepare import written

FEATURES = ["lag_1", "lag_2", "rolling_mean_3", "month"]


@pytest.fixture(scope="module")
def boosted(prepared):
    return forecast.train(prepared, ForecastSpec("boosted", {"maxIter": 3, "maxDepth": 3}))


@pytest.fixture(scope="module")
def few(prepared):
    """The prepared panel with four features, so every coalition can be tried."""
    return forecast.replace(prepared, features=tuple(FEATURES))


def test_sides_do_not_share_a_month(prepared):
    train = prepared.train.agg(F.max("date")).first()[0]
    test = prepared.test.agg(F.min("date")).first()[0]
    assert train < test
    assert prepared.train.count() + prepared.test.count() == prepared.rows.count() == 706


def test_same_seed_gives_the_same_forest(prepared):
    spec = ForecastSpec("forest", {"numTrees": 3, "maxDepth": 3})
    first, second = (forecast.train(prepared, spec).scored for _ in range(2))
    assert first.exceptAll(second).count() == 0


def test_log_target_predictions_are_rates(prepared):
    trained = forecast.train_forecast(prepared, {"max_depth": "2", "gamma": "0.1"}, rounds=3)
    assert trained.scored.where("prediction < 0 OR prediction IS NULL").count() == 0
    row = trained.metrics.first()
    assert row.n == prepared.test.count() and row.rmse >= row.mae > 0


def test_settings_map_to_parameters():
    settings = {"n_estimators": "100", "learning_rate": "0.05", "colsample_bytree": "1.0", "subsample": "0.7"}
    assert models.boosting_params(settings) == {
        "maxIter": 100,
        "stepSize": 0.05,
        "featureSubsetStrategy": "all",
        "subsamplingRate": 0.7,
    }
    assert models.boosting_params({}, 50) == {"maxIter": 50}
    with pytest.raises(ValueError, match="unknown setting"):
        models.boosting_params({"depth": "3"})


def test_model_round_trip(prepared, boosted, tmp_path):
    from tidepanel.sources import files

    files.save_model(boosted.model, str(tmp_path / "m"))
    loaded = models.load_model("boosted", str(tmp_path / "m"))
    again = forecast.scored_test(prepared, {"prediction": loaded})
    assert again.exceptAll(boosted.scored).count() == 0


def test_comparison_tables(prepared):
    params = {"RandomForest": {"numTrees": 2, "maxDepth": 2}, "GradientBoosting": {"maxIter": 2, "maxDepth": 2}}
    compared = forecast.compare_models(prepared, params)
    scores = {row.model: row for row in compared.metrics.collect()}
    assert set(scores) == {"RandomForest", "GradientBoosting", "Linear"}
    assert all(row.n == 147 for row in scores.values())
    dates = compared.scored.select("date").distinct().count()
    assert compared.weighted().count() == dates
    trend = compared.trend().collect()
    assert len(trend) == 2 * dates and all(row.lower <= row.mean <= row.upper for row in trend)
    assert compared.scatter().agg(F.sum("n")).first()[0] == 147
    assert compared.seasonality().agg(F.sum("n")).first()[0] == 147


def test_evaluation_report(boosted):
    row = forecast.evaluation_report(boosted.scored, "prediction", ["grp", "date"]).first()
    assert row.n == 147 and abs(row.acf_1) < 1 and row.acf_1_bound == pytest.approx(1.959964 / math.sqrt(147))
    assert row.dm_significant == (abs(row.dm_stat) > 1.96)


def test_classifier_scores(prepared):
    ready = forecast.with_label(prepared, "high", F.col("y") >= catalog.HIGH_RATE)
    trained = forecast.train_classifier(
        ready.train, ready.test, ready.features, ready.keys, "high", {"numTrees": 3, "maxDepth": 3}
    )
    row = trained.metrics.first()
    assert row.n == 147 and all(0 <= row[c] <= 1 for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))
    assert trained.scored.where("predicted <> (probability > 0.5)::int AND probability <> 0.5").count() == 0


# --- search -----------------------------------------------------------------


def test_grid_and_candidates(spark):
    grid = search.param_grid(spark)
    assert grid.count() == 11520
    first, second = (search.random_candidates(search.param_grid(spark), 20).collect() for _ in range(2))
    assert first == second and len(set(first)) == 20
    assert search.random_candidates(grid, 20, seed=1).collect() != first


@pytest.mark.parametrize("unit", ["date", "row"])
def test_search_takes_the_lowest_mean_error(prepared, unit):
    candidates = [{"n_estimators": "2", "max_depth": "1"}, {"n_estimators": "3", "max_depth": "3"}]
    found = search.search(prepared, ForecastSpec(label="y"), candidates, n_splits=2, unit=unit)
    scores = found.scores.collect()
    assert len(scores) == 4
    means = {c: sum(r.mae for r in scores if r.candidate == c) / 2 for c in (0, 1)}
    assert found.best == candidates[min(means, key=means.get)]
    assert [r.candidate for r in found.ranking.collect()] == sorted(means, key=means.get)


@pytest.mark.parametrize("params", [{"subsamplingRate": 0.7}, {"featureSubsetStrategy": "0.5"}])
def test_first_rounds_are_a_shorter_fit(prepared, params):
    def fitted(rounds):
        spec = ForecastSpec("boosted", {"maxDepth": 3, "maxIter": rounds, **params}, label="y")
        return models.fit(prepared.train, prepared.features, spec, prepared.keys)

    def predicted(model):
        rows = models.predict(model, prepared.test, prepared.features, "p")
        return {(r.grp, r.date): r.p for r in rows.select("grp", "date", "p").collect()}

    cut = models.first_rounds(fitted(6), 4)
    assert cut.getNumTrees == 4 and predicted(cut) == predicted(fitted(4))


def test_search_fits_candidates_of_different_rounds_once(prepared, monkeypatch):
    candidates = [{"n_estimators": n, "max_depth": d} for d in ("2", "3") for n in ("4", "1", "2")]
    alone = [search.search(prepared, ForecastSpec(label="y"), [c], n_splits=2) for c in candidates[:2]]
    fits = []
    monkeypatch.setattr(search, "fit", lambda *a, **k: fits.append(a[2].params["maxIter"]) or models.fit(*a, **k))
    found = search.search(prepared, ForecastSpec(label="y"), candidates, n_splits=2)
    assert fits == [4] * 4  # two depths on two folds
    scores = {(r.candidate, r.fold): r.mae for r in found.scores.collect()}
    assert len(scores) == 12 and len(set(scores.values())) == 12
    for candidate, one in enumerate(alone):
        assert {r.fold: r.mae for r in one.scores.collect()} == {f: m for (c, f), m in scores.items() if c == candidate}


# --- attributions -----------------------------------------------------------


def coalition_value(node, row, names, known):
    """Prediction of one tree with the features outside ``known`` averaged by training weight."""
    kind, *rest = node
    if kind == "leaf":
        return rest[0]
    feature, cut, (left, left_weight), (right, right_weight) = rest
    if feature in known:
        return coalition_value(left if row[names[feature]] <= cut else right, row, names, known)
    total = left_weight + right_weight
    return (
        coalition_value(left, row, names, known) * left_weight
        + coalition_value(right, row, names, known) * right_weight
    ) / total


def read_trees(spark, model, path, classes):
    from tidepanel.sources import files

    files.save_model(model, path)
    nodes = {}
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(row.treeID, {})[row.id] = row

    def build(by_id, i):
        node = by_id[i]
        cover = sum(node.impurityStats) if classes else node.impurityStats[0]
        if node.leftChild < 0:
            value = node.impurityStats[1] / cover if classes else node.prediction
            return ("leaf", value), cover
        cut = node.split.leftCategoriesOrThreshold[0]
        return ("split", node.split.featureIndex, cut, build(by_id, node.leftChild), build(by_id, node.rightChild)), cover

    return {tree: build(by_id, 0)[0] for tree, by_id in nodes.items()}


def brute_force(trees, weights, row, names):
    n = len(names)
    phi = [0.0] * n
    for j in range(n):
        others = [k for k in range(n) if k != j]
        for size in range(n):
            share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in itertools.combinations(others, size):
                for tree, node in trees.items():
                    gain = coalition_value(node, row, names, {*known, j}) - coalition_value(node, row, names, set(known))
                    phi[j] += share * weights[tree] * gain
    return phi


@pytest.mark.parametrize("kind", ["boosted", "forest", "classifier"])
def test_attributions_equal_the_definition(spark, few, kind, tmp_path):
    params = {"maxIter": 3, "maxDepth": 4} if kind == "boosted" else {"numTrees": 3, "maxDepth": 4}
    ready = forecast.with_label(few, "high", F.col("y") >= catalog.HIGH_RATE)
    label = "high" if kind == "classifier" else "y"
    # Weights make the row counts of nodes differ from their training weight.
    spec = ForecastSpec(kind, params, label=label, weight="weight")
    model = models.fit(ready.train, ready.features, spec, ready.keys)
    wide = attribution.attributions(ready.test, model, ready.features, ready.keys)
    trees = read_trees(spark, model, str(tmp_path / "model"), kind == "classifier")
    weights = {t: 1 / len(trees) for t in trees} if kind != "boosted" else dict(enumerate(model.treeWeights))
    for row in wide.orderBy("grp", "date").limit(5).collect():
        expected = brute_force(trees, weights, row, FEATURES)
        assert [row[f"phi_{f}"] for f in FEATURES] == pytest.approx(expected, abs=1e-9)


def test_attributions_add_up_to_the_prediction(prepared, boosted, monkeypatch):
    predicted = boosted.scored.select("grp", "date", "prediction")
    for leaves in (attribution.LEAVES_PER_PIECE, 5):
        monkeypatch.setattr(attribution, "LEAVES_PER_PIECE", leaves)
        monkeypatch.setattr(attribution, "ROWS_PER_BLOCK", 8 * leaves)
        long = attribution.melt_attributions(forecast.explain(prepared, boosted.model), prepared.features, prepared.keys)
        total = long.groupBy("grp", "date").agg((F.first("base") + F.sum("phi")).alias("total"))
        assert total.count() == 147
        worst = total.join(predicted, ["grp", "date"]).agg(F.max(F.abs(F.col("total") - F.col("prediction")))).first()[0]
        assert worst < 1e-9


def coalition_sums(met, shares):
    """Shares by the definition: the coefficients of prod(shares + met * t) are sums over coalitions by size."""
    size = len(shares)
    out = []
    for j in range(size):
        sums = [1.0]
        for k in range(size):
            if k != j:
                grown = [c * shares[k] for c in sums] + [0.0]
                for i, c in enumerate(sums):
                    grown[i + 1] += c * met[k]
                sums = grown
        weights = [1 / (size * math.comb(size - 1, s)) for s in range(size)]
        out.append((met[j] - shares[j]) * sum(c * w for c, w in zip(sums, weights)))
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 20, 27])
def test_leaf_shares_equal_sums_over_coalitions(size):
    draw = np.random.default_rng(size)
    met = (draw.random((40, size)) < 0.6).astype(float)
    shares = draw.random(size) ** 3 + 1e-5
    got = attribution.leaf_shares(met, shares)
    for row, want in zip(got, (coalition_sums(m, shares) for m in met)):
        assert list(row) == pytest.approx(want, abs=1e-12)


def test_deep_trees_are_explained(prepared):
    """Depth 30 on the smallest panel: trees with hundreds of leaves, paths with many features."""
    trained = forecast.train(prepared, ForecastSpec("forest", {"numTrees": 3, "featureSubsetStrategy": "onethird"}))
    assert max(tree.depth for tree in trained.model.trees) > 10
    wide = forecast.explain(prepared, trained.model)
    total = wide.selectExpr("grp", "date", " + ".join(["base", *[f"`phi_{f}`" for f in prepared.features]]) + " AS total")
    worst = total.join(trained.scored, ["grp", "date"]).agg(F.max(F.abs(F.col("total") - F.col("prediction")))).first()[0]
    assert worst < 1e-9


def test_trees_without_a_split_and_empty_tables_have_no_attributions(prepared):
    flat = models.fit(prepared.train, prepared.features, ForecastSpec("forest", {"numTrees": 2, "maxDepth": 0}), prepared.keys)
    wide = forecast.explain(prepared, flat)
    assert wide.count() == 147 and wide.where(" OR ".join(f"`phi_{f}` <> 0" for f in prepared.features)).count() == 0
    none = attribution.attributions(prepared.test.where("false"), flat, prepared.features, prepared.keys)
    assert none.columns == wide.columns and none.count() == 0


def test_no_node_reaches_the_driver(prepared, boosted, monkeypatch):
    """All that is collected while a model is explained: the base value, counts and the model's class."""
    sizes = []
    collect = type(prepared.rows).collect
    monkeypatch.setattr(type(prepared.rows), "collect", lambda self: sizes.append(r := collect(self)) or r)
    monkeypatch.setattr(type(prepared.rows), "toLocalIterator", lambda self, *a: pytest.fail("iterated on the driver"))
    monkeypatch.setattr(type(prepared.rows), "toPandas", lambda self: pytest.fail("collected on the driver"))
    forecast.explain(prepared, boosted.model)
    assert all(len(rows) <= 1 and all(len(r) == 1 for r in rows) for rows in sizes)


def test_importance_summary_and_row(prepared, boosted):
    wide = forecast.explain(prepared, boosted.model)
    top = attribution.global_importance(wide, prepared.features, top=3).collect()
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True) and len(top) == 3
    summary = attribution.attribution_summary(wide, prepared.features, top=3)
    assert {r.feature for r in summary.select("feature").distinct().collect()} == {r.feature for r in top}
    assert {r["sum(n)"] for r in summary.groupBy("feature").sum("n").collect()} == {147}
    one = attribution.explain_row(prepared.test, boosted.model, prepared.features, prepared.keys).collect()
    assert len(one) == len(prepared.features)
    assert len({(r.grp, r.date) for r in one}) == 1
    assert [abs(r.phi) for r in one] == sorted((abs(r.phi) for r in one), reverse=True)


def test_attribution_quantiles(prepared, boosted):
    wide = forecast.explain(prepared, boosted.model).cache()
    levels = {"low": 0.05, "high": 0.95}
    got = attribution.attribution_quantiles(wide, prepared.features, levels).collect()
    assert len(got) == 2 * len(prepared.features)
    rows = wide.toPandas()
    for r in got:
        values = rows[r.feature if r.measure == "value" else f"phi_{r.feature}"]
        assert r.n == 147
        assert [r.low, r.high] == [np.quantile(values, q, method="inverted_cdf") for q in levels.values()]


def test_linear_models_are_not_explained(prepared):
    model = models.fit(prepared.train, prepared.features, ForecastSpec("linear"), prepared.keys)
    with pytest.raises(ValueError, match="no attributions"):
        forecast.explain(prepared, model)


# --- training layout, scorers, depth ------------------------------------------


def test_a_fit_on_laid_out_rows_shuffles_nothing(prepared):
    ready = written(prepared)
    assert ready.laid_out and written(ready) is ready
    rows = models.assemble(ready.train, ready.features)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_same_seed_gives_the_same_model_on_laid_out_rows(prepared):
    ready = written(prepared)
    spec = ForecastSpec("boosted", {"maxIter": 3, "maxDepth": 3, "subsamplingRate": 0.7})
    first, second = (forecast.train(ready, spec).scored for _ in range(2))
    assert first.exceptAll(second).count() == 0


def test_search_takes_a_scorer(prepared):
    candidates = [{"n_estimators": "1", "max_depth": "1"}, {"n_estimators": "4", "max_depth": "3"}]
    found = search.search(
        prepared, ForecastSpec(label="y"), candidates, 2, scorer=r_squared, score_name="r2", greater_is_better=True
    )
    ranking = [r.r2 for r in found.ranking.collect()]
    assert ranking == sorted(ranking, reverse=True)
    assert found.best == candidates[found.ranking.first().candidate]


def test_search_takes_a_table_scorer(prepared):
    """A tie-aware area under the curve, and an error weighted by a column of its own, rank the candidates."""
    candidates = [{"n_estimators": "1", "max_depth": "1"}, {"n_estimators": "4", "max_depth": "3"}]
    ready = forecast.with_label(prepared, "high", F.col("y") >= catalog.HIGH_RATE)
    found = search.search(
        ready, ForecastSpec(label="high"), candidates, 2, score_name="auc", greater_is_better=True, table_scorer=metrics.roc_auc
    )
    ranking = [r.auc for r in found.ranking.collect()]
    assert ranking == sorted(ranking, reverse=True) and all(0 <= a <= 1 for a in ranking)

    def weighted(df, actual, predicted):
        return df.agg(weighted_mean(F.abs(F.col(actual) - F.col(predicted)), F.col("weight")))

    by_weight = search.search(prepared, ForecastSpec(label="y"), candidates, 2, table_scorer=weighted)
    plain = search.search(prepared, ForecastSpec(label="y"), candidates, 2)
    scores = {(r.candidate, r.fold): r.mae for r in by_weight.scores.collect()}
    assert len(scores) == 4
    assert any(abs(scores[r.candidate, r.fold] - r.mae) > 1e-9 for r in plain.scores.collect())
    assert [r.mae for r in by_weight.ranking.collect()] == sorted(r.mae for r in by_weight.ranking.collect())


def test_only_deep_forests_remember_their_rows_nodes():
    assert models._estimator(ForecastSpec("forest")).getCacheNodeIds()
    assert not models._estimator(ForecastSpec("forest", {"maxDepth": 10})).getCacheNodeIds()
    assert models._estimator(ForecastSpec("classifier", {"maxMemoryInMB": 64})).getMaxMemoryInMB() == 64


@pytest.mark.parametrize("kind", ["forest", "classifier"])
def test_forests_grow_as_deep_as_they_can(kind):
    assert models._estimator(ForecastSpec(kind)).getMaxDepth() == 30
    assert models._estimator(ForecastSpec(kind, {"maxDepth": 4})).getMaxDepth() == 4


WHOLE = {
    "rf_forecast": {"actual", "weight", "naive", "prediction"},
    "gbt_forecast": {"actual", "weight", "naive", "prediction"},
    "gbt_log_weighted": {"mae", "rmse", "r2"},
    "rf_classifier": {"accuracy", "precision", "recall", "f1", "roc_auc"},
    "benchmark_models": {"model", "mae", "rmse", "r2"},
    "benchmark_weighted_residuals": {"actual", forecast.PRIMARY, "residual", "sign"},
    "evaluation_report": {"mae", "rmse", "r2", "dm_stat", "acf_1"},
    "tuned_candidates": {"candidate", "mae"},
    "tuned_best_refit": {"mae", "rmse", "r2"},
    "tree_attribution": {"feature", "value", "phi"},
    "attribution_classifier": {"feature", "value", "phi"},
    "feature_importance_top20": {"feature", "importance"},
    "attribution_summary": {"feature", "bin", "n"},
    "attribution_quantiles": {"feature", "measure", "n", "q1", "median", "q3"},
    "single_row_explanation": {"feature", "phi"},
}


@pytest.mark.parametrize("name", WHOLE)
def test_model_queries_give_whole_results(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert WHOLE[name] <= set(rows.columns)
    assert f"{name}_check" in catalog.ORACLES and name not in catalog.ORACLES
    for column in {"prediction", "phi", "importance"} & set(rows.columns):
        assert rows[column].notna().all() and rows[column].nunique() > 1


# --- forests on many rows, attributions of many rows ----------------------------


def node_table(spark, model, path):
    model.write().save(str(path))
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()


@pytest.fixture()
def wide_panel(spark):
    """3,000 rows whose label follows two of six measures; keys repeat, weights differ."""
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(3000, 6)), 3)
    y = np.where(x[:, 0] > 0.3, 4.0, 1.0) + np.where(x[:, 1] > -0.5, 2.5, 0.0) + draw.normal(size=3000)
    rows = [(i // 2, *map(float, r), float(t), int(t > 3), 1.0 + i % 3) for i, (r, t) in enumerate(zip(x, y))]
    columns = "k int, a double, b double, c double, d double, e double, f double, y double, high int, weight double"
    return spark.createDataFrame(rows, columns).repartition(4, "k").cache()


SIX = list("abcdef")


@pytest.mark.parametrize("kind", ["forest", "classifier"])
@pytest.mark.parametrize("weight", [None, "weight"])
def test_a_tree_from_histograms_is_mllibs(spark, wide_panel, monkeypatch, tmp_path, kind, weight):
    """One tree on all rows leaves nothing to draw: cuts, splits, pruning and statistics are the same."""
    params = {"numTrees": 1, "maxDepth": 4, "bootstrap": False, "featureSubsetStrategy": "all", "minInstancesPerNode": 20}
    spec = ForecastSpec(kind, params, label="high" if kind == "classifier" else "y", weight=weight)
    monkeypatch.setattr(models, "MANY_ROWS", 10**9)
    expected = node_table(spark, models.fit(wide_panel, SIX, spec, ["k"]), tmp_path / "a")
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 64)
    got = node_table(spark, models.fit(wide_panel, SIX, spec, ["k"]), tmp_path / "b")
    assert len(got) == len(expected) > 4
    for a, b in zip(expected, got):
        assert a[:2] == b[:2] and a.split == b.split and a.rawCount == b.rawCount
        assert (a.leftChild, a.rightChild) == (b.leftChild, b.rightChild)
        assert [b.prediction, b.impurity, b.gain, *b.impurityStats] == pytest.approx([a.prediction, a.impurity, a.gain, *a.impurityStats], abs=1e-9)


@pytest.mark.parametrize("kind", ["forest", "classifier"])
def test_a_forest_on_many_rows_grows_without_mllibs_passes(spark, wide_panel, monkeypatch, tmp_path, kind):
    """It is as good as MLlib's, the same each time and however the rows lie, and can be saved and loaded."""
    label = "high" if kind == "classifier" else "y"
    spec = ForecastSpec(kind, {"numTrees": 12, "maxDepth": 5}, label=label)

    def scored(model):
        if kind == "classifier":
            rows = models.predict_class(model, wide_panel, SIX)
            return metrics.roc_auc(rows, "high", "probability").first()[0]
        return metrics.regression_metrics(models.predict(model, wide_panel, SIX, "p"), "y", "p").first().r2

    monkeypatch.setattr(models, "MANY_ROWS", 10**9)
    whole = scored(models.fit(wide_panel, SIX, spec, ["k"]))
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    fits = []
    monkeypatch.setattr(models, "fit_forest", lambda *a: fits.append(a) or forest.fit_forest(*a))
    first = models.fit(wide_panel, SIX, spec, ["k"])
    again = models.fit(wide_panel.repartition(7), SIX, spec, ["k"])
    assert len(fits) == 2 and first.getNumTrees == 12 and first.numFeatures == 6 and first.getMaxDepth() == 5
    assert abs(scored(first) - whole) < 0.03
    tables = [node_table(spark, m, tmp_path / str(i)) for i, m in enumerate((first, again))]
    assert tables[0] == tables[1] and len({r.rawCount for r in tables[0] if r.id == 0}) > 1
    assert scored(models.load_model(kind, str(tmp_path / "0"))) == scored(first)


def test_other_settings_and_labels_are_left_to_mllib(wide_panel, monkeypatch):
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    monkeypatch.setattr(models, "fit_forest", lambda *a: pytest.fail("settings it does not follow"))
    models.fit(wide_panel, SIX, ForecastSpec("classifier", {"numTrees": 2, "maxDepth": 2, "impurity": "entropy"}, label="high"), ["k"])
    three = wide_panel.withColumn("three", F.col("k") % 3)
    assert models.fit(three, SIX, ForecastSpec("classifier", {"numTrees": 2, "maxDepth": 2}, label="three"), ["k"]).numClasses == 3


def test_rows_are_drawn_as_often_as_poisson_numbers():
    settings = forest.Settings(2, 5, 42, True, 1.0, 32, 0.0, 1, False, 6, 6, False)
    counts = forest.drawn(np.arange(200_000, dtype=np.uint64) * np.uint64(11400714819323198485), 1, settings)
    shares = np.bincount(counts, minlength=4)[:4] / len(counts)
    assert list(shares) == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.005)


def test_missing_features_raise(wide_panel, monkeypatch):
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    gaps = wide_panel.withColumn("a", F.when(F.col("k") > 10, F.col("a")))
    with pytest.raises(Exception, match="missing values"):
        models.fit(gaps, SIX, ForecastSpec("forest", {"numTrees": 2, "maxDepth": 2}), ["k"])


def test_the_rows_of_a_block_share_the_tables_of_a_branch(prepared, boosted, monkeypatch):
    """What is worked out per branch does not grow with the rows, and leaves are not looked at one by one."""
    nodes = attribution.tree_nodes(boosted.model).where("tree = 0").toArrow()
    branches = attribution._branches(attribution.tree_branches(nodes))
    leaves = sum(left < 0 for left in nodes.column("left").to_pylist())
    assert leaves > 4 and len(branches) == 1  # a tree of depth 3 is one table
    x = np.random.default_rng(0).normal(size=(4096, len(prepared.features)))
    sizes = []
    shares = attribution.branch_shares
    monkeypatch.setattr(attribution, "branch_shares", lambda bits, branch: sizes.append(len(bits)) or shares(bits, branch))
    whole = attribution.attribute(x, branches)
    assert sizes == [2 ** (leaves - 1)]
    monkeypatch.setattr(attribution, "CONDITIONS", 2)
    parts = attribution._branches(attribution.tree_branches(nodes))
    assert len(parts) > 1 and np.abs(attribution.attribute(x, parts) - whole).max() < 1e-12
    assert np.abs(attribution.attribute(x[:3], branches) - whole[:, :3]).max() < 1e-12
