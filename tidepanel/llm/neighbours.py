"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put into its leaf.
A query walks the tree best bin first: a priority queue holds the branches not
yet taken, and the one whose centre is nearest to the query is opened next. How
many leaves a query visits is widened until the exact neighbours of a sample of
queries, found among all vectors, are reached often enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import shared
from tidepanel.storage import materialise

# Bounds of what the tree is fitted on and of its size; it is broadcast.
SAMPLE_ROWS = 16_384
MOST_LEAVES = 4096
BRANCHES = 8
LLOYD_ROUNDS = 8
# Queries whose exact neighbours calibrate the search, and the share of them to reach.
CALIBRATION_QUERIES = 256
RECALL = 0.97
# Rows of a cell in which vectors of one leaf meet queries.
CELL_VECTORS = 8192
CELL_QUERIES = 4096
# Vectors and queries whose products are held at a time.
STEP = 1024
# Products closer than this to the last kept one are worked out again pair by pair.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled with 0."""
    lengths = {len(v) for v in vectors}
    if len(lengths) <= 1:
        return np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    out = np.zeros((len(vectors), max(lengths)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """The vectors of a column without nulls, as rows of doubles."""
    lists = batch.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.min() != lengths.max():
        return matrix(lists.to_pylist())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with at least ``width`` columns."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, the same for a pair wherever it is worked out."""
    dot, na, nb = (a * b).sum(axis=1), (a * a).sum(axis=1), (b * b).sum(axis=1)
    plain = (np.minimum(na, nb) > 1e-250) & (np.maximum(na, nb) < 1e250)
    with np.errstate(all="ignore"):
        return np.where(plain, dot / (np.sqrt(na) * np.sqrt(nb)), (units(a) * units(b)).sum(axis=1))


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes; ``children[node]`` are its nodes, empty for a leaf. Node 0 is the root."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]

    @property
    def leaves(self) -> list[int]:
        return [n for n, below in enumerate(self.children) if not below]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors: the nearest child, level by level."""
        at = np.zeros(len(x), dtype=np.int64)
        pending = [(0, np.arange(len(x)))]
        while pending:
            node, rows = pending.pop()
            below = np.array(self.children[node], dtype=np.int64)
            if not len(below) or not len(rows):
                at[rows] = node
                continue
            nearest = below[nearest_centre(x[rows], self.centres[below])]
            pending += [(child, rows[nearest == child]) for child in below.tolist()]
        return at

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order a query opens them, best bin first; equal bins by their number."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            below = self.children[node]
            if not below:
                yield node
                continue
            apart = ((self.centres[list(below)] - q) ** 2).sum(axis=1)
            for far, child in zip(apart.tolist(), below):
                heapq.heappush(queue, (far, child))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def split(x: np.ndarray, branches: int, random: np.random.Generator) -> np.ndarray | None:
    """The group of each row after k-means with ``branches`` spread starts; None for rows that are all equal."""
    centres = [x[random.integers(len(x))]]
    apart = np.full(len(x), np.inf)
    while len(centres) < branches:
        apart = np.minimum(apart, ((x - centres[-1]) ** 2).sum(axis=1))
        if apart.max() < 1e-18:
            break
        centres.append(x[random.choice(len(x), p=apart / apart.sum())])
    if len(centres) == 1:
        return None
    means = np.array(centres)
    for _ in range(LLOYD_ROUNDS):
        group = nearest_centre(x, means)
        n = np.bincount(group, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, group, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    group = np.unique(nearest_centre(x, means), return_inverse=True)[1]
    return group if group.max() > 0 else None


def fit_tree(x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 3) -> Tree:
    """A tree of at most ``leaves`` leaves over the unit rows of ``x``; the fullest leaf is split next."""
    random = np.random.Generator(np.random.PCG64(seed))
    centres, children = [x.mean(axis=0)], [()]
    queue, n_leaves = [(-len(x), 0, np.arange(len(x)))], 1
    while queue and n_leaves < leaves:
        _, node, rows = heapq.heappop(queue)
        group = split(x[rows], min(branches, leaves - n_leaves + 1), random) if len(rows) > 1 else None
        if group is None:
            continue
        below = []
        for g in range(group.max() + 1):
            members = rows[group == g]
            below.append(len(centres))
            centres.append(x[members].mean(axis=0))
            children.append(())
            heapq.heappush(queue, (-len(members), below[-1], members))
        children[node] = tuple(below)
        n_leaves += len(below) - 1
    return Tree(np.array(centres), tuple(children))


def sample(df: DataFrame, rows: int, bound: int, *key: str) -> DataFrame:
    """At most ``bound`` of ``rows`` rows, by the least hash of ``key``; the same rows on every run."""
    hashed = F.pmod(F.xxhash64(F.lit(31), *key), F.lit(shared.HASH_RANGE))
    rate = min(1.0, 2 * bound / max(rows, 1))
    near = df.withColumn("_hash", hashed).filter(F.col("_hash") < F.lit(int(rate * shared.HASH_RANGE)))
    return near.orderBy("_hash", *key).limit(bound).drop("_hash")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether a product is, or may be after exact work, among the best ``k`` of its row."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, dtype=bool)
    edge = np.partition(scores, -k, axis=1)[:, -k]
    return scores >= edge[:, None] - SLACK


class Nearest:
    """The best ``k`` (score, id) per query over blocks of vectors, each with its least ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = query_ids, queries, k
        self.unit = units(queries) if len(queries) else queries
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, vectors: np.ndarray, vector_ids: Sequence[Sequence[int]], leaves: np.ndarray | None = None) -> None:
        """One more block; ``vector_ids`` are each vector's least k + 1 ids."""
        width = max(vectors.shape[1], self.queries.shape[1])
        vectors, queries, unit = (widened(x, width) for x in (vectors, self.queries, self.unit))
        n_ids = np.array([len(i) for i in vector_ids])
        flat = np.array([i for ids in vector_ids for i in ids], dtype=np.int64)
        first = np.cumsum(n_ids) - n_ids
        only = np.where(n_ids == 1, flat[first], -1) if len(flat) else n_ids
        for at in range(0, len(vectors), STEP):
            block = vectors[at : at + STEP]
            near = unit @ units(block).T
            # A vector that only the query itself has.
            near[(only[at : at + STEP] == self.ids[:, None]) & (n_ids[at : at + STEP] == 1)] = -np.inf
            q, c = np.nonzero(best(near, self.k))
            exact = cosines(queries[q], block[c])
            c = c + at
            n = n_ids[c]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n)
            q, score, ids = np.repeat(q, n), np.repeat(exact, n), flat[place]
            leaf = np.repeat(leaves[c], n) if leaves is not None else np.zeros(len(q), dtype=np.int64)
            others = ids != self.ids[q]
            self.found.append((q[others], score[others], ids[others], leaf[others]))
            if sum(len(f[0]) for f in self.found) > 64 * STEP:
                self.found = [self.merged()]
        self.found = [self.merged()]

    def merged(self) -> tuple[np.ndarray, ...]:
        """The best k of each query so far, ties to the smaller id."""
        if not self.found:
            return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.float64, np.int64, np.int64))
        q, score, ids, leaf = (np.concatenate(parts) for parts in zip(*self.found))
        order = np.lexsort((ids, -score, q))
        q, score, ids, leaf = q[order], score[order], ids[order], leaf[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        keep = place < self.k
        return q[keep], score[keep], ids[keep], leaf[keep]

    def rows(self) -> pa.RecordBatch:
        q, score, ids, leaf = self.merged()
        return pa.record_batch(
            {
                "query_id": pa.array(self.ids[q], pa.int64()),
                "vec_id": pa.array(ids, pa.int64()),
                "score": pa.array(score, pa.float64()),
                "leaf": pa.array(leaf, pa.int64()),
            }
        )


FOUND = "query_id long, vec_id long, score double, leaf long"


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector once, with its least k + 1 ids.

    However many rows share a vector, no more of them can be anyone's k nearest.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    # Ranked before the shuffle as well, so a hot vector is a few rows per task.
    few = vectors.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def indexed(vectors: DataFrame, tree) -> DataFrame:
    """``vectors`` with the leaf of each (``tree`` is broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_here = tree.value
        for batch in batches:
            if batch.num_rows:
                x = widened(units(_column(batch, "vector")), tree_here.centres.shape[1])
                leaf = tree_here.leaf_of(x[:, : tree_here.centres.shape[1]])
                yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, leaf long")


def exact(queries: list, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the true k nearest of a few queries, and their leaves."""
    sent = index.sparkSession.sparkContext.broadcast(  # a bounded sample
        (np.array([q.vec_id for q in queries], dtype=np.int64), matrix([q.vector for q in queries]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(*sent.value, k)
        for batch in batches:
            if batch.num_rows:
                leaves = batch.column("leaf").to_numpy()
                nearest.add(_column(batch, "vector"), batch.column("ids").to_pylist(), leaves)
        yield nearest.rows()

    return ranked(index.select("vector", "ids", "leaf").mapInArrow(run, FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(tree: Tree, queries: list, truth: list, share: float) -> int:
    """How many leaves a query must visit so that ``share`` of the true neighbours lie in them.

    The visits are widened leaf by leaf, for all sampled queries alike.
    """
    wanted: dict[int, list[int]] = {}
    for row in truth:
        wanted.setdefault(row.query_id, []).append(row.leaf)
    reached = np.zeros(len(tree.leaves) + 1)
    for query in queries:
        q = widened(units(matrix([query.vector])), tree.centres.shape[1])[0, : tree.centres.shape[1]]
        place = {leaf: n for n, leaf in enumerate(tree.visits(q), 1)}
        for leaf in wanted.get(query.vec_id, ()):
            reached[place[leaf]] += 1
    if not reached.sum():
        return 1
    return max(1, int(np.searchsorted(np.cumsum(reached), share * reached.sum())))


def opened(queries: DataFrame, tree, visits: int, sizes: dict[int, int], k: int) -> DataFrame:
    """(vec_id, vector, leaf): each query with the leaves it visits.

    That is ``visits`` of them, and more while they hold fewer than k + 1 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_here = tree.value
        width = tree_here.centres.shape[1]
        for batch in batches:
            row, leaf = [], []
            for i, q in enumerate(widened(units(_column(batch, "vector")), width)[:, :width] if batch.num_rows else ()):
                n = rows = 0
                for node in tree_here.visits(q):
                    if n >= visits and rows > k:
                        break
                    n += 1
                    if node in sizes:
                        rows += sizes[node]
                        row.append(i)
                        leaf.append(node)
            yield batch.take(pa.array(row, pa.int64())).append_column("leaf", pa.array(leaf, pa.int64()))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in queries.dtypes)
    return queries.mapInArrow(run, f"{schema}, leaf long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell of a partition that is sorted by ``cell``."""
    cell, held = None, []
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if held and cells[start] != cell:
                yield pa.Table.from_batches(held)
                held = []
            cell = cells[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            is_query = pc.is_valid(rows.column("query_id"))
            asked, given = rows.filter(is_query), rows.filter(pc.invert(is_query))
            if not asked.num_rows or not given.num_rows:
                continue
            vectors, ids = _column(given, "vector"), given.column("ids").to_pylist()
            query_ids = asked.column("query_id").to_numpy()
            queries = _column(asked, "vector")
            for at in range(0, len(queries), STEP):
                nearest = Nearest(query_ids[at : at + STEP], queries[at : at + STEP], k)
                nearest.add(vectors, ids)
                yield nearest.rows()

    return run


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    calibration_queries: int = CALIBRATION_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found among ``vectors``, by cosine.

    Both sides have ``vec_id`` (long) and ``vector`` (array of numbers); other
    columns are not looked at. Null ids, and vectors that are null, zero or hold
    null or non-finite components, take no part; shorter vectors are filled with
    0. A query is not compared with rows of its own id. Equal rows count once;
    an id that repeats among the queries counts once, with its smallest vector.
    Ties go to the smaller id. A query for which there are fewer than k others
    gets all of them; no queries or no vectors give no rows.

    The tree is fitted on at most ``sample_rows`` vectors, and has about a leaf
    for each square root of the rows, so that visiting and searching leaves grow
    alike. Rows of a leaf are cut into cells of bounded size, and so are the
    queries that visit it; a leaf's rows are copied once per ``CELL_QUERIES``
    visitors, which is little beside comparing them.
    """
    vectors = vectors.select("vec_id", "vector").filter(F.col("vec_id").isNotNull() & usable("vector"))
    queries = queries.select("vec_id", "vector").filter(F.col("vec_id").isNotNull() & usable("vector"))
    queries = materialise(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    context = vectors.sparkSession.sparkContext
    distinct = materialise(classes(vectors, k), "classes")
    rows = distinct.count()
    none = distinct.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_queries = queries.count()
    if not rows or not n_queries:
        return none
    learnt = _column(sample(distinct.select("vector"), rows, sample_rows, "vector").toArrow(), "vector")
    fitted = fit_tree(units(learnt), min(MOST_LEAVES, max(1, round(rows**0.5))))
    tree = context.broadcast(fitted)
    index = materialise(indexed(distinct, tree), "index")
    asked = sample(queries, n_queries, calibration_queries, "vec_id").collect()
    visits = calibrated(fitted, asked, exact(asked, index, k).collect(), recall)
    # One row per leaf: how many rows it has (of each vector, its least ids).
    counted = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    visiting = materialise(opened(queries, tree, visits, {r.leaf: r.ids for r in counted}, k), "visits")
    visitors = {r.leaf: r["count"] for r in visiting.groupBy("leaf").count().collect()}
    plan, cells_before = [], 0
    for r in counted:
        if r.leaf in visitors:
            parts, blocks = -(-r.n // CELL_VECTORS), -(-visitors[r.leaf] // CELL_QUERIES)
            plan.append((r.leaf, cells_before, parts, blocks))
            cells_before += parts * blocks
    cuts = F.broadcast(  # at most MOST_LEAVES rows
        distinct.sparkSession.createDataFrame(plan, "leaf long, first long, parts int, blocks int")
    )
    cell = (F.col("first") + F.col("part") * F.col("blocks") + F.col("block")).alias("cell")
    part = F.pmod(F.xxhash64(F.lit(11), "vector"), "parts")
    block = F.pmod(F.xxhash64(F.lit(12), "vec_id"), "blocks")
    given = index.join(cuts, "leaf").select(
        "first", "blocks", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("long").alias("query_id"), "vector", "ids",
    )
    met = visiting.join(cuts, "leaf").select(
        "first", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"),
        F.col("vec_id").alias("query_id"), "vector", F.lit(None).cast("array<long>").alias("ids"),
    )
    cells = given.unionByName(met).select(cell, "query_id", "vector", "ids")
    found = (
        cells.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(search(k), FOUND)
    )
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
