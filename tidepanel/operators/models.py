"""Distributed MLlib models on prepared panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import class_label, from_log, to_log
from tidepanel.operators.forest import fit_forest, supported
from tidepanel.storage import shared_folder

SEED = 42
TREES = 100
DEEPEST = 30  # the deepest trees MLlib grows
DEEP = 12  # trees beyond this depth are grown with their rows' places kept
ROWS_PER_PARTITION = 10_000
MANY_ROWS = 100_000  # forests up to the depth above are grown from histograms beyond

# Search setting -> MLlib parameter.
BOOSTING_PARAMS = {
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "max_depth": "maxDepth",
    "min_child_weight": "minInstancesPerNode",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "gamma": "minInfoGain",
}

LOADERS = {
    "forest": RandomForestRegressionModel,
    "boosted": GBTRegressionModel,
    "linear": LinearRegressionModel,
    "classifier": RandomForestClassificationModel,
}


@dataclass(frozen=True)
class ForecastSpec:
    """One model definition that search, final fit and evaluation share.

    ``params`` are MLlib parameter names. With ``log_target`` the model learns
    log(1 + y) and its predictions are turned back into rates of at least 0.
    """

    kind: str = "boosted"
    params: Mapping[str, object] = field(default_factory=dict)
    label: str = "y"
    weight: str | None = None
    log_target: bool = False
    seed: int = SEED


def boosting_params(settings: Mapping[str, object], rounds: int = TREES) -> dict[str, object]:
    """Search settings as MLlib parameters; ``rounds`` where the settings name none."""
    params: dict[str, object] = {"maxIter": rounds}
    for name, value in settings.items():
        if name not in BOOSTING_PARAMS:
            raise ValueError(f"unknown setting {name!r}; known: {sorted(BOOSTING_PARAMS)}")
        target = BOOSTING_PARAMS[name]
        if target == "featureSubsetStrategy":
            params[target] = "all" if float(value) >= 1 else str(float(value))
        elif target in ("stepSize", "subsamplingRate", "minInfoGain"):
            params[target] = float(value)
        else:
            params[target] = int(value)
    return params


def _estimator(spec: ForecastSpec):
    params = dict(spec.params)
    if spec.kind in ("forest", "classifier") and params.get("maxDepth", DEEPEST) > DEEP:
        # Deep trees have many nodes and few rows in each: rows remember their node, and a pass takes more nodes.
        params = {"cacheNodeIds": True, "maxMemoryInMB": 1024} | params
    if spec.kind == "forest":
        defaults = {"numTrees": TREES, "maxDepth": DEEPEST, "featureSubsetStrategy": "all", "seed": spec.seed}
        return RandomForestRegressor(**(defaults | params))
    if spec.kind == "boosted":
        defaults = {"maxIter": TREES, "stepSize": 0.3, "maxDepth": 6, "lossType": "squared", "seed": spec.seed}
        return GBTRegressor(**(defaults | params))
    if spec.kind == "linear":
        return LinearRegression(**params)
    if spec.kind == "classifier":
        return RandomForestClassifier(**({"numTrees": TREES, "maxDepth": DEEPEST, "seed": spec.seed} | params))
    raise ValueError(f"unknown model kind {spec.kind!r}")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def training_layout(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread rows by the hash of their key and order them inside each partition.

    The number of partitions follows from the number of rows, so the same rows
    sit in the same places on any cluster and a seed gives the same bootstrap
    samples; a key with many rows is spread like any other.
    """
    partitions = -(-df.count() // ROWS_PER_PARTITION)
    return df.repartition(max(1, partitions), *keys).sortWithinPartitions(*keys)


def fit(
    train: DataFrame, features: Sequence[str], spec: ForecastSpec, keys: Sequence[str], laid_out: bool = False
) -> Model:
    """Fit on the rows of ``train``; ``keys`` identify a row.

    ``laid_out`` rows come from a table written in the training layout and are
    used where they lie, so that fits on one table (or its folds) shuffle nothing.
    """
    shared_folder(train.sparkSession)  # lets boosting cut its lineage
    label = F.col(spec.label).cast("double")
    if spec.log_target:
        label = to_log(label)
    elif spec.kind == "classifier":
        label = class_label(F.col(spec.label)).cast("double")
    weight = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    rows = train.select(*keys, *features, label.alias("_label"), weight.alias("_weight"))
    estimator = _estimator(spec).setLabelCol("_label").setFeaturesCol("features")
    if spec.weight:
        estimator = estimator.setWeightCol("_weight")
    if spec.kind in ("forest", "classifier") and estimator.getMaxDepth() <= DEEP and supported(estimator):
        # ``train`` is counted, not ``rows``, whose expressions a count has no use for.
        n = train.count()
        if n > MANY_ROWS and (spec.kind == "forest" or _two_classes(rows)):
            return fit_forest(rows, features, keys, estimator, n, spec.kind == "classifier")
    return estimator.fit(assemble(rows if laid_out else training_layout(rows, keys), features))


def _two_classes(rows: DataFrame) -> bool:
    """Whether the labels are 0 and 1, both of them; MLlib takes any others, or says what is wrong with them."""
    known = F.col("_label").isin(0.0, 1.0)
    low, high, other = rows.agg(F.min("_label"), F.max("_label"), F.count_if(~F.coalesce(known, F.lit(False)))).first()
    return (low, high, other) == (0.0, 1.0, 0)


def predict(model: Model, df: DataFrame, features: Sequence[str], name: str, log_target: bool = False) -> DataFrame:
    """Add the model's prediction of every row as column ``name``."""
    scored = model.transform(assemble(df, features))
    prediction = from_log(F.col("prediction")) if log_target else F.col("prediction")
    return scored.select(*df.columns, prediction.alias(name))


def predict_class(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the predicted class and the probability of class 1."""
    scored = model.transform(assemble(df, features))
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("predicted"),
        vector_to_array("probability")[1].alias("probability"),
    )


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model as a fit of only ``rounds`` rounds gives it: a round never depends on later ones."""
    gateway = SparkContext._gateway
    package = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(package.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    fitted = model._java_obj.trees()
    for i, weight in enumerate(model.treeWeights[:rounds]):
        trees[i], weights[i] = fitted[i], weight  # the trees stay in the JVM
    cut = package.GBTRegressionModel(f"{model.uid}_{rounds}", trees, weights)
    return model._copyValues(GBTRegressionModel(cut))


def load_model(kind: str, path: str) -> Model:
    return LOADERS[kind].load(path)
