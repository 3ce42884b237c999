"""Additive attributions of tree-ensemble predictions (Shapley values).

The value of a feature set is the prediction with the other features averaged
out along the tree by training weight, so per row the base value plus the
attributions is the prediction. Trees are taken apart on executors, one tree per
group of the saved node table, into a written table of branches: subtrees with
few enough conditions, those on the way to them included, that the attributions
of every pattern of met and unmet conditions fit in a small table. A row only looks
its pattern up. Blocks of rows meet pieces of that table, both of bounded size, and
what the pieces give a row is added up: no node or leaf passes through the driver.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.operators.sketches import QUARTILES, SIZE, quantiles, value_sketches
from tidepanel.sources.files import save_model
from tidepanel.storage import materialise, new_path

NEGLIGIBLE = 1e-6  # importances up to this count as no influence
TOP_FEATURES = 20
# Rows and leaves of a cell, and the rows for which a cell of their own is worth while.
ROWS_PER_BLOCK = 131_072
LEAST_ROWS = 256
LEAVES_PER_PIECE = 131_072
# Conditions of a branch: a table has 2 ** CONDITIONS patterns at most, unless a single leaf has more of them.
CONDITIONS = 11
SUMMARY_BINS = 20


# Executors need only this module's array functions; sending them along spares
# the cluster an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRANCHES = (
    "features array<int>, lower array<double>, upper array<double>, shares array<double>, "
    "splits array<int>, cuts array<double>, parts array<double>, values array<double>, leaves int"
)


def tree_nodes(model: Model) -> DataFrame:
    """(tree, id, left, right, feature, cut, value, cover) of every node of a tree model.

    MLlib saves the table as Parquet. ``value`` is scaled by the tree's weight in
    the ensemble, ``cover`` is the training weight that reached the node.
    """
    spark = SparkSession.active()
    path = new_path(spark, "model")
    save_model(model, path)
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    forest = "RandomForest" in meta["class"]
    classes = "Classification" in meta["class"]
    if "RandomForest" not in meta["class"] and "GBTRegression" not in meta["class"]:
        raise ValueError(f"no attributions for {meta['class']}")
    # Its columns have no names: tree, settings, weight.
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_settings", "_weight").drop("_settings")
    if forest:
        trees = trees.withColumn("_weight", F.lit(1.0) / model.getNumTrees)
    stats = F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    # impurityStats hold the training weight; rawCount ignores it.
    value, cover = (stats[1] / total, total) if classes else (F.col("nodeData.prediction"), stats[0])
    return (
        spark.read.parquet(f"{path}/data")
        .join(F.broadcast(trees), "treeID")  # one row per tree
        .select(
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("id"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut"),
            (F.col("_weight") * value).alias("value"),
            cover.cast("double").alias("cover"),
        )
    )


def tree_branches(nodes: pa.Table) -> pa.Table:
    """The branches of one tree: the way to a subtree, and its nodes.

    A row meets feature features[i] of the way when lower[i] < x <= upper[i]; shares[i] is
    the share of the training weight that follows the way at that feature's splits. The
    nodes lie in depth-first order, the left child first: the split feature (-1 for a
    leaf), its cut, the node's part of its parent's training weight, and a leaf's value.
    """
    column = {c: nodes.column(c).to_pylist() for c in ("id", "left", "right", "feature", "cut", "value", "cover")}
    place = {node: i for i, node in enumerate(column["id"])}
    left, right = ([place.get(node, -1) for node in column[c]] for c in ("left", "right"))
    feature, cut, value, cover = (column[c] for c in ("feature", "cut", "value", "cover"))

    def below(top: int) -> list[tuple[int, float]]:
        """The nodes from ``top`` on in depth-first order, each with its part of its parent's weight."""
        found, pending = [], [(top, 1.0)]
        while pending:
            i, part = pending.pop()
            found.append((i, part))
            if left[i] >= 0:
                pending += [(child, cover[child] / cover[i]) for child in (right[i], left[i])]
        return found

    splits = [0] * len(left)
    for i, _ in reversed(below(place[0])):
        if left[i] >= 0:
            splits[i] = 1 + splits[left[i]] + splits[right[i]]
    branches, pending = [], [(place[0], {})]
    while pending:
        i, path = pending.pop()
        if splits[i] and len(path) + splits[i] > CONDITIONS:
            low, high, share = path.get(feature[i], (-np.inf, np.inf, 1.0))
            for child, interval in ((left[i], (low, min(high, cut[i]))), (right[i], (max(low, cut[i]), high))):
                pending.append((child, path | {feature[i]: (*interval, share * cover[child] / cover[i])}))
            continue
        inside = below(i)
        values = [value[j] if left[j] < 0 else 0.0 for j, _ in inside]
        if any(values) and (path or splits[i]):
            ways = map(list, zip(*path.values())) if path else ([], [], [])
            named = [(feature[j], cut[j]) if left[j] >= 0 else (-1, 0.0) for j, _ in inside]
            branches.append((list(path), *ways, *map(list, zip(*named)), [part for _, part in inside], values, splits[i] + 1))
    names = ("features", "lower", "upper", "shares", "splits", "cuts", "parts", "values", "leaves")
    whole, real = pa.list_(pa.int32()), pa.list_(pa.float64())
    kinds = (whole, real, real, real, whole, real, real, real, pa.int32())
    columns = list(zip(*branches)) if branches else [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def branch_table(model: Model) -> tuple[DataFrame, float]:
    """The written table of branches of all trees, and the base value, the only number that is collected."""
    nodes = materialise(tree_nodes(model), "nodes")
    base = nodes.where("id = 0").agg(F.sum("value")).first()[0]
    branches = nodes.groupBy("tree").applyInArrow(tree_branches, BRANCHES)
    return materialise(branches, "branches"), float(base)


_KNOWN: dict[tuple, object] = {}  # a cache that travels with the functions, unlike functools' own


def _points(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points and weights from 0 to 1 that integrate products of ``size`` - 1 linear factors exactly."""
    if ("points", size) not in _KNOWN:
        t, weight = np.polynomial.legendre.leggauss((size + 1) // 2)
        _KNOWN["points", size] = (t + 1) / 2, weight / 2
    return _KNOWN["points", size]


def _all_patterns(size: int) -> np.ndarray:
    """Every pattern of ``size`` conditions in order, the first condition as the lowest bit."""
    if ("patterns", size) not in _KNOWN:
        _KNOWN["patterns", size] = ((np.arange(2**size)[:, None] >> np.arange(size)) & 1).astype(bool)
    return _KNOWN["patterns", size]


def _own_shares(met: np.ndarray, shares: np.ndarray, whole: np.ndarray, factors: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Each feature's integral from the weighted product of all factors, its own divided out."""
    missed = np.broadcast_to(-1 / (1 - t), factors[1].shape)  # (0 - share) / (share * (1 - t))
    followed = (1 - shares)[:, None] / factors[1]
    return np.where(met, whole @ followed.T, whole @ missed.T)


def leaf_shares(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley share of each feature for each row pattern of a unit leaf.

    ``met`` is patterns x features of 0/1. A leaf contributes the product of
    ``met`` over the coalition and of ``shares`` outside it. A feature's share is
    the integral over t from 0 to 1 of its own difference times the other
    features' (1 - t) * shares + t * met: a polynomial in t, which so many Gauss
    points integrate exactly.
    """
    met = met.astype(bool)
    t, weight = _points(met.shape[1])
    factors = np.stack([shares[:, None] * (1 - t), shares[:, None] * (1 - t) + t])  # met or not x features x points
    whole = np.tile(weight, (len(met), 1))
    for i, column in enumerate(met.T):
        whole *= factors[column.astype(int), i]
    return _own_shares(met, shares, whole, factors, t)


def every_share(shares: np.ndarray) -> np.ndarray:
    """``leaf_shares`` of all patterns in order, whose products double with each feature."""
    t, weight = _points(len(shares))
    factors = np.stack([shares[:, None] * (1 - t), shares[:, None] * (1 - t) + t])
    whole = weight[None, :]
    for missed, followed in zip(*factors):
        whole = np.concatenate([whole * missed, whole * followed])
    return _own_shares(_all_patterns(len(shares)), shares, whole, factors, t)


def branch_shares(bits: np.ndarray, branch: tuple) -> dict[int, np.ndarray]:
    """Per feature, what the leaves of a branch give each pattern (a row of ``bits``) of its conditions.

    The conditions are the features of the way, then the splits in depth-first order.
    """
    features, _, _, shares, splits, _, parts, values = branch
    found = defaultdict(lambda: np.zeros(len(bits)))
    ways = {int(f): (bits[:, i], s) for i, (f, s) in enumerate(zip(features, shares))}
    condition = len(features)
    pending = [(ways, None)]
    for feature, part, value in zip(splits.tolist(), parts.tolist(), values.tolist()):
        way, turn = pending.pop()
        if turn is not None:
            turned, side = turn
            met, share = way.get(turned, (True, 1.0))
            way = way | {turned: (met & side, share * part)}
        if feature >= 0:
            side = bits[:, condition]
            condition += 1
            pending += [(way, (feature, ~side)), (way, (feature, side))]
        elif value:
            met, weights = [m for m, _ in way.values()], np.array([s for _, s in way.values()])
            if 2 ** len(way) <= len(bits):
                code = sum(m.astype(np.intp) << i for i, m in enumerate(met))
                gains = every_share(weights).T
                for f, gain in zip(way, gains):
                    found[f] += value * gain[code]
            else:
                for f, gain in zip(way, leaf_shares(np.column_stack(met), weights).T):
                    found[f] += value * gain
    return found


def attribute(x: np.ndarray, branches: list[tuple]) -> np.ndarray:
    """Attributions (features x rows) of the rows of ``x`` (rows x features) by all branches.

    Values are compared by their places among the cuts of their feature, which are small integers.
    """
    cuts = defaultdict(list)
    for features, lower, upper, _, splits, split_cuts, *_ in branches:
        for of, values in ((features, lower), (features, upper), (splits, split_cuts)):
            for f, value in zip(of.tolist(), values.tolist()):
                if f >= 0 and abs(value) != np.inf:
                    cuts[f].append(value)
    cuts = {f: np.unique(values) for f, values in cuts.items()}
    places = {f: np.searchsorted(c, x[:, f]).astype(np.min_scalar_type(len(c))) for f, c in cuts.items()}
    order = {f: {value: i for i, value in enumerate(c.tolist())} | {-np.inf: -1, np.inf: len(c)} for f, c in cuts.items()}
    phi, gains = np.zeros(x.shape[::-1]), np.empty(len(x))
    for branch in branches:
        features, lower, upper, _, splits, split_cuts, *_ = branch
        conditions = [(f, order[f][low], order[f][high]) for f, low, high in zip(features.tolist(), lower.tolist(), upper.tolist())]
        conditions += [(f, -1, order[f][cut]) for f, cut in zip(splits.tolist(), split_cuts.tolist()) if f >= 0]
        size = len(conditions)
        codes = np.zeros(len(x), dtype=np.uint16 if size <= 16 else np.int64)
        for i, (f, low, high) in enumerate(conditions):
            place = places[f]
            met = place <= high
            if low >= 0:
                met &= place > low
            codes |= met.astype(codes.dtype) << codes.dtype.type(i)
        if 2**size <= len(x):
            bits, codes = _all_patterns(size), codes.astype(np.intp)
        else:
            patterns, codes = np.unique(codes, return_inverse=True)
            bits = ((patterns[:, None].astype(np.int64) >> np.arange(size)) & 1).astype(bool)
        tables = branch_shares(bits, branch)
        for f, table in tables.items():
            phi[f] += np.take(table, codes, out=gains, mode="clip")  # no new array, no copy in between
    return phi


def _branches(table: pa.Table) -> list[tuple]:
    """The branches of a piece, as views of its flat columns."""
    lists = [table.column(c).combine_chunks() for c in table.column_names if pa.types.is_list(table.column(c).type)]
    flat = [a.flatten().to_numpy() for a in lists]
    ends = [np.cumsum(a.value_lengths().to_numpy()) for a in lists]
    return [
        tuple(column[end[i - 1] if i else 0 : end[i]] for column, end in zip(flat, ends)) for i in range(table.num_rows)
    ]


def attributions(df: DataFrame, model: Model, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, features, base, phi_<feature>...): attributions of every row, wide.

    Attributions add up over branches, so any piece of their table can be held
    against any block of rows. Rows are copied once per piece (one piece for a
    hundred trees of depth 10) and pieces once per block.
    """
    branches, base = branch_table(model)
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    names, phi_names = list(features), [f"phi_{f}" for f in features]
    placed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "explained")
    n_rows, n_leaves = placed.count(), branches.agg(F.sum("leaves")).first()[0]
    if not n_rows or not n_leaves:
        return placed.select(*rows.columns, F.lit(base).alias("base"), *[F.lit(0.0).alias(n) for n in phi_names])
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n_rows // ROWS_PER_BLOCK), min(cores, -(-n_rows // LEAST_ROWS)))
    pieces = -(-n_leaves // LEAVES_PER_PIECE)
    copies = {
        "rows": placed.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
        ),
        "branches": branches.withColumn("_piece", F.pmod(F.xxhash64("upper", "cuts", "values"), F.lit(pieces)).cast("int")).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        ),
    }
    tasks = min(20 * blocks * pieces, 20 * cores)  # a cell takes long, so few of them should meet in a task
    cells = {n: t.repartition(tasks, "_block", "_piece").groupBy("_block", "_piece") for n, t in copies.items()}

    def explain(block: pa.Table, piece: pa.Table) -> pa.Table:
        x = np.column_stack([block.column(f).to_numpy() for f in names])
        phi = attribute(x, _branches(piece)) if piece.num_rows else np.zeros_like(x.T)
        kept = block.select(kept_names)
        for name, column in zip(phi_names, phi):
            kept = kept.append_column(name, pa.array(column))
        return kept

    kept_names = placed.columns
    schema = StructType([*placed.schema, *[StructField(n, DoubleType()) for n in phi_names]])
    wide = cells["rows"].cogroup(cells["branches"]).applyInArrow(explain, schema)
    if pieces > 1:
        wide = wide.groupBy("_row").agg(
            *[F.first(c).alias(c) for c in rows.columns], *[F.sum(n).alias(n) for n in phi_names]
        )
    return wide.select(*rows.columns, F.lit(base).alias("base"), *phi_names)


def _pairs(features: Sequence[str]) -> str:
    """One row per feature of a wide row: (feature, value, phi)."""
    entries = [f"struct('{f}' AS feature, `{f}` AS value, `phi_{f}` AS phi)" for f in features]
    return f"inline(array({', '.join(entries)}))"


def melt_attributions(wide: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return wide.selectExpr(*[f"`{k}`" for k in keys], "base", _pairs(features))


def global_importance(wide: DataFrame, features: Sequence[str], top: int = TOP_FEATURES) -> DataFrame:
    """Mean absolute attribution per feature, the largest first; averaged before melting."""
    means = wide.selectExpr(*[f"avg(abs(`phi_{f}`)) AS `{f}`" for f in features])
    return (
        means.unpivot([], list(features), "feature", "importance")
        .where(F.col("importance") > NEGLIGIBLE)
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def attribution_summary(
    wide: DataFrame, features: Sequence[str], top: int = TOP_FEATURES, bins: int = SUMMARY_BINS
) -> DataFrame:
    """Per top feature, how its attributions are spread and which feature values they go with.

    Each feature's range of attributions is cut into equal bins; a bin has its
    number of rows, its mean attribution and the mean feature value in it.
    """
    long = wide.selectExpr(_pairs(features))
    ranges = long.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("importance"), F.min("phi").alias("_low"), F.max("phi").alias("_high")
    )
    top_ranges = ranges.orderBy(F.desc("importance"), "feature").limit(top)
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("phi") - F.col("_low")) / width), F.lit(bins - 1)))
    return (
        long.join(F.broadcast(top_ranges), "feature")  # at most `top` rows
        .withColumn("bin", F.coalesce(place, F.lit(0)).cast("int"))
        .groupBy("feature", "importance", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("phi").alias("mean_phi"),
            F.avg("value").alias("mean_value"),
        )
    )


def attribution_quantiles(
    wide: DataFrame, features: Sequence[str], levels: Mapping[str, float] = QUARTILES, size: int = SIZE
) -> DataFrame:
    """(feature, measure, n, a column per level): how each feature's values and attributions are spread.

    ``measure`` is ``value`` or ``phi``. One pass over the rows: a sketch per column,
    nothing is melted or ordered (``sketches.rank_error``).
    """
    columns = [*features, *[f"phi_{f}" for f in features]]
    spread = quantiles(value_sketches(wide, [], columns, size), [], columns, levels)
    names = F.create_map(*[F.lit(n) for f in features for n in (f"phi_{f}", f)])
    feature = names[F.col("measure")]
    return spread.select(
        F.coalesce(feature, "measure").alias("feature"),
        F.when(feature.isNotNull(), "phi").otherwise("value").alias("measure"),
        "n",
        *levels,
    )


def explain_row(df: DataFrame, model: Model, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Attributions of the first row in key order, the strongest first; only that row is scored."""
    first = df.orderBy(*keys).limit(1)
    long = melt_attributions(attributions(first, model, features, keys), features, keys)
    return long.orderBy(F.desc(F.abs("phi")), "feature")
