"""Forests of limited depth on many rows, as MLlib's models.

MLlib walks every tree again for every row and level and adds to statistics that lie
all over the memory, so its time per row and tree is microseconds. Here rows are binned once
and kept in parts of about half a million rows, one byte per feature. A pass over the
parts takes each tree in turn and counts the histograms of its deepest nodes by feature;
the histograms of a few nodes are added up in one place, which gives their splits. What
reaches the driver is a row per node, as with MLlib.

Candidate cuts, scores, limits and pruning are MLlib's. The rows a tree draws follow from the
hash of their keys, so they are the same on any cluster.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.ml import Model
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.storage import new_path

LEAST_PARTS = 8
ROWS_PER_PART = 524_288
CUT_ROWS = 100_000  # about as many rows choose the candidate cuts (MLlib: 10,000)
ROWS_AT_ONCE = 65_536  # of a part, so that what is held of them stays near the core
NODES_PER_CHUNK = 64  # whose histograms are added up in one place
PURE = 1e-14  # variance of a pure node, as a part of its mean square

# Executors need only this module's array functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = "bins binary, target binary, weight binary, draw binary"
STATS = "tree int, chunk int, part int, stats binary"
SPLITS = "tree int, node int, feature int, cut int, gain double, weight double, total double, squares double, n double"
# Settings of an estimator that are followed here.
FOLLOWED = {
    "numTrees", "maxDepth", "featureSubsetStrategy", "seed", "bootstrap", "subsamplingRate",
    "maxBins", "minInfoGain", "minInstancesPerNode", "labelCol", "featuresCol", "weightCol",
}


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    seed: int
    bootstrap: bool
    rate: float
    bins: int
    least_gain: float
    least_rows: int
    classes: bool
    per_node: int
    n_features: int
    weighted: bool

    @property
    def statistics(self) -> int:
        """Of a bin: weight and total, and the number of rows where that is not the weight."""
        return 3 if self.weighted else 2


def supported(estimator) -> bool:
    """Whether all that is set on the estimator is followed here."""
    named = {param.name for param, _ in estimator.extractParamMap().items() if estimator.isSet(param)}
    return named <= FOLLOWED and estimator.getMaxBins() <= 256


def features_per_node(strategy: str, n: int, trees: int, classes: bool) -> int:
    """How many features a node chooses from, by MLlib's rules."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    if strategy == "all":
        return n
    if strategy in ("sqrt", "log2", "onethird"):
        share = {"sqrt": math.sqrt(n), "log2": math.log2(n), "onethird": n / 3}[strategy]
        return max(1, math.ceil(share))
    number = float(strategy)
    return min(n, int(number)) if strategy.isdigit() else max(1, math.ceil(number * n))


def candidate_cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """Midpoints of neighbouring values: all of them, or those that part the weight evenly, as MLlib takes them."""
    distinct, place = np.unique(values, return_inverse=True)
    middles = ((distinct[:-1] + distinct[1:]) / 2).tolist()
    if len(middles) < bins:
        return middles
    counts = np.bincount(place, weights=weights)
    below = np.cumsum(counts).tolist()
    stride = below[-1] / bins
    target, cuts = stride, []
    for middle, previous, current in zip(middles, below, below[1:]):
        if abs(previous - target) < abs(current - target):
            cuts.append(middle)
            target += stride
    return cuts


def _cuts(rows: DataFrame, features: Sequence[str], keys: Sequence[str], n: int, bins: int) -> list[np.ndarray]:
    every = max(1, n // CUT_ROWS)
    some = rows.where(F.pmod(F.xxhash64(*keys, F.lit("cuts")), F.lit(every)) == 0)
    entries = [F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)]
    long = some.select("_weight", F.inline(F.array(*entries)))

    def choose(group: pa.Table) -> pa.Table:
        found = candidate_cuts(group.column("x").to_numpy(), group.column("_weight").to_numpy(), bins)
        return pa.table({"i": group.column("i").slice(0, 1), "cuts": pa.array([found], pa.list_(pa.float64()))})

    found = {r.i: r.cuts for r in long.groupBy("i").applyInArrow(choose, "i int, cuts array<double>").collect()}
    return [np.array(found.get(i, []), dtype=float) for i in range(len(features))]  # one row per feature


def pack(batches: Iterator[pa.RecordBatch], features: Sequence[str], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per part: the bins (features x rows), labels, weights and hashed keys of its rows."""
    parts = []
    for batch in batches:
        columns = [batch.column(c) for c in (*features, "_label", "_weight")]
        arrays = [c.to_numpy(zero_copy_only=False) for c in columns]
        if any(c.null_count for c in columns) or any(np.isnan(a).any() for a in arrays):
            raise ValueError("missing values among the features, labels or weights")
        binned = [np.searchsorted(c, a).astype(np.uint8) for c, a in zip(cuts, arrays)]
        parts.append((np.stack(binned), *arrays[-2:], batch.column("_hash").to_numpy().view(np.uint64)))
    if not parts:
        return
    bins, target, weight, draw = (np.concatenate(p, axis=-1) for p in zip(*parts))
    # Rows with equal keys lie side by side; each draws for itself.
    place = np.arange(len(draw), dtype=np.uint64)
    first = np.append(True, draw[1:] != draw[:-1])
    run = place - np.maximum.accumulate(np.where(first, place, np.uint64(0)))
    draw = draw + run * np.uint64(0x9E3779B97F4A7C15)
    names = [entry.split()[0] for entry in PART.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (bins, target, weight, draw)], names)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Evenly spread 32 bits of 64 (the end of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def drawn(draw: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """How often a tree draws each row: Poisson numbers, or 0 and 1 without a bootstrap."""
    if not settings.bootstrap and settings.rate >= 1:
        return np.ones(len(draw), dtype=np.uint8)
    start = int(np.random.SeedSequence([settings.seed % 2**63, tree]).generate_state(1, np.uint64)[0])
    chance = _mixed(draw ^ np.uint64(start))
    if not settings.bootstrap:
        return (chance < settings.rate * 2.0**32).astype(np.uint8)
    counts = np.zeros(len(draw), dtype=np.uint8)
    below, term, k = 0.0, math.exp(-settings.rate), 0
    while (limit := round((below := below + term) * 2.0**32)) < 2**32 and k < 255:
        counts += chance >= limit
        k += 1
        term *= settings.rate / k
    return counts


def chosen_features(settings: Settings, tree: int, level: int, nodes: int) -> np.ndarray:
    """(nodes, per node): the features each node of a level chooses from, in order."""
    if settings.per_node == settings.n_features:
        return np.broadcast_to(np.arange(settings.n_features), (nodes, settings.n_features))
    random = np.random.default_rng([settings.seed % 2**63, tree, level])
    picked = random.random((nodes, settings.n_features)).argsort(axis=1)[:, : settings.per_node]
    return np.sort(picked, axis=1)


@dataclass
class Tree:
    """Nodes in the order they were made, level by level; a leaf stays with itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    first: int  # the first node of the deepest level


def level_stats(
    batches: Iterator[pa.RecordBatch], trees: dict[int, Tree], level: int, settings: Settings, last: bool
) -> Iterator[pa.RecordBatch]:
    """Per tree and chunk of its deepest nodes: weight, total, squares and number, then the histograms."""
    part = TaskContext.get().partitionId()
    names = [entry.split()[0] for entry in STATS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            target, weight = (np.frombuffer(row[c]) for c in ("target", "weight"))
            bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, len(target))
            by_row = np.ascontiguousarray(bins.T).reshape(-1)
            draw = np.frombuffer(row["draw"], dtype=np.uint64)
            room = Room(min(ROWS_AT_ONCE, len(target)))
            for number, tree in trees.items():
                nodes = len(tree.left) - tree.first
                totals = np.zeros((nodes, 4))
                histograms = np.zeros((0 if last else nodes, settings.per_node, settings.bins, settings.statistics))
                picked = chosen_features(settings, number, level, nodes)
                for begin in range(0, len(target), ROWS_AT_ONCE):
                    at = slice(begin, begin + ROWS_AT_ONCE)
                    these = by_row[begin * settings.n_features : (begin + ROWS_AT_ONCE) * settings.n_features]
                    counts = drawn(draw[at], number, settings)
                    reached = _nodes(counts, these, tree, level, settings.n_features, room)
                    _add_stats(totals, histograms, bins[:, at], target[at], weight[at], counts, *reached, picked, settings, room)
                for chunk, start in enumerate(range(0, len(totals), NODES_PER_CHUNK)):
                    some = slice(start, start + NODES_PER_CHUNK)
                    stats = totals[some].tobytes() + histograms[some].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], pa.int32()) for v in (number, chunk, part)] + [pa.array([stats], pa.binary())], names
                    )


class Room:
    """Arrays that are used again: a new one for every feature costs more than the sums that it holds."""

    def __init__(self, rows: int):
        self.bytes, self.more_bytes, self.flags = (np.empty(rows, kind) for kind in (np.uint8, np.uint8, bool))
        self.places, self.codes = (np.empty(rows, np.int64) for _ in range(2))
        self.measures = [np.empty(rows) for _ in range(3)]


def _take(values: np.ndarray, places: np.ndarray, room: np.ndarray) -> np.ndarray:
    return np.take(values, places, out=room[: len(places)], mode="clip")  # without a copy in between


def _nodes(counts, by_row, tree: Tree, level: int, n_features: int, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """The drawn rows that reach the deepest level, and the place of their node in it."""
    rows = np.flatnonzero(counts)
    node, at = np.zeros(len(rows), dtype=np.int64), rows * n_features
    for _ in range(level):
        place = _take(tree.feature, node, room.places)
        place += at
        above = np.greater(_take(by_row, place, room.bytes), _take(tree.cut, node, room.more_bytes), out=room.flags[: len(rows)])
        node[:] = _take(tree.left, node, room.codes)
        node += above
    deep = node >= tree.first
    if not deep.all():
        rows, node = rows[deep], node[deep]
    return rows, node - tree.first


def _add_stats(totals, histograms, bins, target, weight, counts, rows, node, picked, settings: Settings, room: Room) -> None:
    """Add rows to ``totals`` (nodes x weight, total, squares, number), and, unless they are empty, to the
    ``histograms`` (nodes x chosen features x bins x statistics)."""
    nodes, y, n = len(totals), target[rows], counts[rows].astype(float)
    w = n * weight[rows] if settings.weighted else n
    s = w * y
    for k, m in enumerate((w, s, s * y, n)):
        totals[:, k] += np.bincount(node, weights=m, minlength=nodes)
    if not len(histograms):
        return
    measures, base = (w, s, n)[: settings.statistics], node * settings.bins
    whole = settings.per_node == settings.n_features
    for f in range(settings.n_features):
        own, slot, of, start, held = slice(None), f, rows, base, measures
        if not whole:
            own, slot = np.nonzero(picked == f)
            if not len(own):
                continue
            wanted = np.zeros(nodes, dtype=bool)
            wanted[own] = True
            mine = np.flatnonzero(_take(wanted, node, room.flags))
            of, start = _take(rows, mine, room.places), base[mine]
            held = [_take(m, mine, into) for m, into in zip(measures, room.measures)]
        code = np.add(start, _take(bins[f], of, room.bytes), out=room.codes[: len(of)])
        for k, m in enumerate(held):
            summed = np.bincount(code, weights=m, minlength=nodes * settings.bins)
            histograms[own, slot, :, k] += summed.reshape(nodes, settings.bins)[own]


def best_splits(key: tuple, group: pa.Table, level: int, settings: Settings, last: bool) -> pa.Table:
    """The split of every node of a chunk (feature -1 for none), and the node's own statistics."""
    number, chunk = (k.as_py() for k in key)
    group = group.sort_by("part")
    stats = sum(np.frombuffer(value) for value in group.column("stats").to_pylist())
    per_node = 4 + (0 if last else settings.per_node * settings.bins * settings.statistics)
    nodes = len(stats) // per_node
    totals = stats[: nodes * 4].reshape(nodes, 4)
    weight, total, squares, n = totals.T
    mean_square = np.divide(squares, weight, out=np.zeros(nodes), where=weight > 0)
    feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes)
    if not last:
        left = stats[nodes * 4 :].reshape(nodes, settings.per_node, settings.bins, settings.statistics)
        left = left.cumsum(axis=2)[:, :, :-1]
        lw, ls, ln = left[..., 0], left[..., 1], left[..., -1 if settings.weighted else 0]
        rw, rs, rn = (t[:, None, None] - m for t, m in ((weight, lw), (total, ls), (n, ln)))
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = (ls * ls / lw + rs * rs / rw - (total * total / weight)[:, None, None]) / weight[:, None, None]
            gains *= 1 + settings.classes  # Gini impurity of two classes is twice the variance
            allowed = (ln >= settings.least_rows) & (rn >= settings.least_rows) & (lw > 0) & (rw > 0)
            gains = np.where(allowed & (gains >= settings.least_gain), gains, -np.inf).reshape(nodes, -1)
            best = gains.argmax(axis=1)
            gain = gains[np.arange(nodes), best]
            pure = mean_square - (total / weight) ** 2 <= PURE * mean_square
        splits = (gain > PURE * mean_square) & ~pure
        whole = NODES_PER_CHUNK * chunk
        picked = chosen_features(settings, number, level, whole + nodes)[whole:]
        feature = np.where(splits, picked[np.arange(nodes), best // (settings.bins - 1)], -1)
        cut = best % (settings.bins - 1)
    columns = (np.full(nodes, number), np.arange(nodes) + NODES_PER_CHUNK * chunk, feature, cut, gain, weight, total, squares, n)
    kinds = [pa.int32()] * 4 + [pa.float64()] * 5
    names = [entry.split()[0] for entry in SPLITS.split(", ")]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds)})


def _splitter(level: int, settings: Settings, last: bool):
    def split(key: tuple, group: pa.Table) -> pa.Table:
        return best_splits(key, group, level, settings, last)

    return split


def _grown(parts: DataFrame, settings: Settings) -> list[dict[str, np.ndarray]]:
    """Per tree its nodes in the order they were made: feature (-1 for a leaf), cut, left child, gain, statistics."""
    none = np.zeros(1, dtype=np.int64)
    trees = {t: Tree(none, none.astype(np.uint8), none, 0) for t in range(settings.trees)}
    made = [[] for _ in range(settings.trees)]
    for level in range(settings.depth + 1):
        last = level == settings.depth

        stats = parts.mapInArrow(partial(level_stats, trees=trees, level=level, settings=settings, last=last), STATS)
        splits = stats.groupBy("tree", "chunk").applyInArrow(_splitter(level, settings, last), SPLITS)
        table = splits.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        found = {c: table.column(c).to_numpy() for c in table.column_names}  # one row per node of the level
        starts = np.append(np.flatnonzero(np.diff(found["tree"], prepend=-1)), len(found["tree"]))
        grown = {}
        for begin, end in zip(starts, starts[1:]):
            t = int(found["tree"][begin])
            here = {c: column[begin:end] for c, column in found.items()}
            old, splits = trees[t], here["feature"] >= 0
            n, children = old.first + end - begin, 2 * np.cumsum(splits)
            here["left"] = np.where(splits, n + children - 2, -1)
            made[t].append(here)
            if not splits.any():
                continue
            ids, below = np.arange(old.first, n), int(children[-1])
            filler = np.zeros(below, dtype=np.int64)
            grown[t] = Tree(
                np.concatenate([old.feature[: old.first], np.where(splits, here["feature"], 0), filler]),
                # No bin is above 255, so rows stay in a leaf.
                np.concatenate([old.cut[: old.first], np.where(splits, here["cut"], 255), filler]).astype(np.uint8),
                np.concatenate([old.left[: old.first], np.where(splits, here["left"], ids), filler]),
                n,
            )
        trees = grown
        if not trees:
            break
    return [{c: np.concatenate([level[c] for level in levels]) for c in levels[0]} for levels in made]


def _node_rows(number: int, tree: dict[str, np.ndarray], cuts: list[np.ndarray], classes: bool) -> list[tuple]:
    """Rows of MLlib's node table, in depth-first order. Like MLlib's, leaves of one parent that predict the same become one."""
    column = {c: v.tolist() for c, v in tree.items()}
    n = len(column["left"])
    weight, total, squares = column["weight"], column["total"], column["squares"]
    means = [t / w if w else 0.0 for t, w in zip(total, weight)]
    predicted = [float(2 * t > w) for t, w in zip(total, weight)] if classes else means
    left = column["left"]
    for i in reversed(range(n)):  # children come after their parents
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and predicted[a] == predicted[a + 1]:
            left[i] = -1
            predicted[i] = predicted[a]
    order, pending = [], [0]
    while pending:
        i = pending.pop()
        order.append(i)
        if left[i] >= 0:
            pending += [left[i] + 1, left[i]]
    place = {i: k for k, i in enumerate(order)}
    rows = []
    for i in order:
        w, t, q, a = weight[i], total[i], squares[i], left[i]
        stats = [w - t, t] if classes else [w, t, q]
        impurity = (1 - ((w - t) / w) ** 2 - (t / w) ** 2 if classes else q / w - (t / w) ** 2) if w else 0.0
        split = (column["feature"][i], [float(cuts[column["feature"][i]][column["cut"][i]])]) if a >= 0 else (-1, [])
        ends = (column["gain"][i], place[a], place[a + 1]) if a >= 0 else (-1.0, -1, -1)
        if column["gain"][i] == -math.inf:
            impurity = -1.0  # MLlib's for a node that no cut could part
        rows.append((number, place[i], predicted[i], impurity, stats, int(column["n"][i]), *ends, *split))
    return rows


NODES = {
    "tree": pa.int32(), "id": pa.int32(), "prediction": pa.float64(), "impurity": pa.float64(),
    "stats": pa.list_(pa.float64()), "n": pa.int64(), "gain": pa.float64(), "left": pa.int32(),
    "right": pa.int32(), "feature": pa.int32(), "cut": pa.list_(pa.float64()),
}
NODE_DATA = (
    "tree AS treeID",
    "named_struct('id', id, 'prediction', prediction, 'impurity', impurity, 'impurityStats', stats, 'rawCount', n, "
    "'gain', gain, 'leftChild', left, 'rightChild', right, 'split', "
    "named_struct('featureIndex', feature, 'leftCategoriesOrThreshold', cut, 'numCategories', -1)) AS nodeData",
)


def _as_model(spark: SparkSession, estimator, rows: list[tuple], n_features: int) -> Model:
    """MLlib's model with these nodes: the settings come from a fit on rows that have nothing to split."""
    same = Vectors.dense([0.0] * n_features)
    columns = [estimator.getLabelCol(), estimator.getFeaturesCol()]
    values = [(0.0, same), (1.0, same)]
    if estimator.isSet("weightCol"):
        columns, values = [*columns, estimator.getWeightCol()], [(*v, 1.0) for v in values]
    empty = estimator.fit(spark.createDataFrame(values, columns).coalesce(1))
    path = new_path(spark, "forest")
    empty.write().save(path)
    nodes = pa.table({name: pa.array(c, kind) for (name, kind), c in zip(NODES.items(), zip(*rows))})
    spark.createDataFrame(nodes).selectExpr(*NODE_DATA).write.mode("overwrite").parquet(f"{path}/data")
    return type(empty).load(path)


def fit_forest(rows: DataFrame, features: Sequence[str], keys: Sequence[str], estimator, n: int, classes: bool) -> Model:
    """The estimator's model of ``rows`` (keys, features, _label, _weight), which are ``n``; labels 0 and 1 for ``classes``."""
    trees = estimator.getNumTrees()
    cuts = _cuts(rows, features, keys, n, estimator.getMaxBins())
    settings = Settings(
        trees,
        estimator.getMaxDepth(),
        estimator.getSeed(),
        estimator.getBootstrap(),
        estimator.getSubsamplingRate(),
        max(2, 1 + max(map(len, cuts))),
        estimator.getMinInfoGain(),
        estimator.getMinInstancesPerNode(),
        classes,
        features_per_node(estimator.getFeatureSubsetStrategy(), len(features), trees, classes),
        len(features),
        estimator.isSet("weightCol"),
    )
    needed = [F.col(f).cast("double").alias(f) for f in features]
    dealt = rows.select(*keys, *needed, "_label", "_weight", F.xxhash64(*keys).alias("_hash")).repartition(
        max(LEAST_PARTS, -(-n // ROWS_PER_PART)), *keys
    )
    # Rows with one key are told apart by all they hold, so that each draws the same wherever it lies.
    ordered = dealt.sortWithinPartitions("_hash", *keys, *features, "_label", "_weight")
    parts = ordered.mapInArrow(partial(pack, features=list(features), cuts=cuts), PART)
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grown = _grown(parts, settings)
    finally:
        parts.unpersist()
    nodes = [row for number, tree in enumerate(grown) for row in _node_rows(number, tree, cuts, classes)]
    return _as_model(rows.sparkSession, estimator, nodes, len(features))
