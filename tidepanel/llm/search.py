"""Exact top-k inner products with MaxScore over shards of integer vectors.

The dimensions a query uses are its terms. In a shard, a term's impact on a
vector is measured from the least favourable value the shard holds, so it is
never negative and has an upper bound. Terms whose bounds together stay below
the query's k-th best score are non-essential: the essential ones are summed
first, and the others are probed, strongest bound first, only for vectors that
can still compete. Every query knows a score it must reach before it meets its
first shard: its k-th best among a few vectors that all queries are held against.
The best k of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.storage import materialise

# Vectors of a shard, queries of a block, and vectors between two updates of a threshold.
SHARD_ROWS = 8192
QUERY_ROWS = 8192
STEP_ROWS = 4096
# Vectors that give every query its first threshold.
SEED_ROWS = 1024
# Half of the non-essential terms are probed between two checks, the stronger ones, and the last few at once;
# from this share of vectors alive on, all of a block are probed in one go.
PROBED = 4
MANY_ALIVE = 0.25
EXACT = 2**53


def usable(vector: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def quantised(vector: str, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class TopK:
    """The best k (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []

    def add(self, scores, ids) -> None:
        s, i = [*self.scores, *scores], [*self.ids, *ids]
        order = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k]
        self.scores, self.ids = [s[j] for j in order], [i[j] for j in order]

    @property
    def threshold(self):
        return self.scores[-1] if len(self.scores) == self.k else None


def max_score(query: np.ndarray, query_id: int, ids: np.ndarray, columns: np.ndarray, low, high, k: int, least=None) -> TopK:
    """The best ``k`` of a shard for one query, without the query's own id.

    ``columns`` are the shard's vectors, a row per term; ``low`` and ``high`` are
    each term's least and greatest component. Scores below ``least`` need not be found.
    """
    top = TopK(k)
    terms = np.flatnonzero(query != 0)
    q = query[terms]
    # Impact of term t on vector c: q * c - worst, between 0 and bound.
    worst = np.where(q > 0, q * low[terms], q * high[terms])
    bounds = np.where(q > 0, q * high[terms], q * low[terms]) - worst
    order = np.argsort(bounds, kind="stable")
    terms, q, worst, bounds = terms[order], q[order], worst[order], bounds[order]
    base = worst.sum() if len(worst) else 0
    reach = np.concatenate([[0], np.cumsum(bounds)])  # what the weakest terms can add together
    for at in range(0, len(ids), STEP_ROWS):
        needed = max((t for t in (least, top.threshold) if t is not None), default=None)
        split = 0
        if needed is not None:
            if reach[-1] + base < needed:
                break  # nothing in this shard can compete
            # An equal score may still win by its id, so only sums below it are non-essential.
            split = int(np.searchsorted(reach, needed - base, side="left")) - 1
            split = min(max(split, 0), len(terms))
        block, block_ids = columns[:, at : at + STEP_ROWS], ids[at : at + STEP_ROWS]
        scores = q[split:] @ block[terms[split:]] + (base - worst[split:].sum())
        alive = np.flatnonzero(block_ids != query_id)
        while True:
            if needed is not None:
                alive = alive[scores[alive] + reach[split] >= needed]
            if not split or not len(alive):
                break
            first = split // 2 if split > PROBED else 0
            probe, weights, offset = terms[first:split], q[first:split], worst[first:split].sum()
            if len(alive) > MANY_ALIVE * len(scores):
                scores += weights @ block[probe] - offset
            else:
                scores[alive] += weights @ block[np.ix_(probe, alive)] - offset
            split = first
        found, found_ids = scores[alive], block_ids[alive]
        if len(found) > 4 * k:
            best = found >= np.sort(found)[-k]
            found, found_ids = found[best], found_ids[best]
        top.add(found.tolist(), found_ids.tolist())
    return top


def matrix(vectors: list) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled with 0."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact_numbers(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables in numbers in which sums of products are exact: doubles below 2^53, else Python's integers."""
    largest = max(int(np.abs(t.astype(float)).max(initial=0)) for t in tables)
    width = max(1, *(t.shape[1] for t in tables))
    kind = float if largest * largest * width * 4 < EXACT else object
    return [np.pad(t, ((0, 0), (0, width - t.shape[1]))).astype(kind) for t in tables]


def search_cell(rows: pa.Table, k: int) -> pa.RecordBatch:
    """Top k of every query of a block among the vectors of a shard."""
    is_query = rows.column("is_query").to_numpy(zero_copy_only=False)
    ids = rows.column("vec_id").to_numpy(zero_copy_only=False)
    (numbers,) = exact_numbers(matrix(rows.column("vector").to_pylist()))
    out = {"query_id": [], "vec_id": [], "score": []}
    if not is_query.all():
        vectors, vector_ids = numbers[~is_query], ids[~is_query]
        low, high, columns = vectors.min(axis=0), vectors.max(axis=0), np.ascontiguousarray(vectors.T)
        thresholds = rows.column("least").filter(rows.column("is_query")).to_pylist()
        for query, query_id, least in zip(numbers[is_query], ids[is_query], thresholds):
            top = max_score(query, query_id, vector_ids, columns, low, high, k, least)
            out["query_id"] += [int(query_id)] * len(top.ids)
            out["vec_id"] += top.ids
            out["score"] += [int(s) for s in top.scores]
    return pa.record_batch({n: pa.array(v, pa.int64()) for n, v in out.items()})


def with_threshold(queries: DataFrame, vectors: DataFrame, rows: int, k: int) -> DataFrame:
    """``queries`` with ``least``, their k-th best score among ``SEED_ROWS`` vectors; null if there are fewer than k."""
    hashed = F.pmod(F.xxhash64(F.lit(7), "vec_id", "vector"), F.lit(1 << 40))
    rate = min(1.0, 2 * SEED_ROWS / max(rows, 1))
    seeds = vectors.withColumn("_hash", hashed).filter(F.col("_hash") < F.lit(int(rate * (1 << 40))))
    table = seeds.orderBy("_hash", "vec_id", "vector").limit(SEED_ROWS).select("vec_id", "vector").toArrow()
    sent = queries.sparkSession.sparkContext.broadcast(  # a bounded sample
        (table.column("vec_id").to_numpy(), matrix(table.column("vector").to_pylist()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seed_vectors = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            least = []
            asked, given = exact_numbers(matrix(batch.column("vector").to_pylist()), seed_vectors)
            for query, query_id in zip(asked, ids):
                scores = (given @ query)[seed_ids != query_id]
                least.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else None)
            yield batch.append_column("least", pa.array(least, pa.int64()))

    return queries.mapInArrow(run, "vec_id long, vector array<long>, least long")


def search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Search cell after cell of a partition that is sorted by ``cell``."""
    cell, held = None, []
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if held and cells[start] != cell:
                yield search_cell(pa.Table.from_batches(held), k)
                held = []
            cell = cells[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield search_cell(pa.Table.from_batches(held), k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best among ``vectors``.

    Both sides have ``vec_id`` and ``vector`` (array of long). Rows with a null
    in either take no part. A query is not compared with rows of its own id;
    an id that repeats among the queries counts once, with its smallest vector.
    Ties go to the smaller id; repeated rows count each; other columns are not
    looked at; an empty side gives no rows. Queries and vectors meet in cells of
    bounded size (a block of queries and a shard of vectors), so neither side is
    broadcast or held whole.
    """
    queries = queries.select("vec_id", "vector").dropna().groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors = vectors.select("vec_id", "vector").dropna()
    rows = vectors.count()
    asked = materialise(with_threshold(queries, vectors, rows, k), "queries")
    shards = max(1, -(-rows // SHARD_ROWS))
    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(query_blocks))
    # Rows of one repeated id are spread as well.
    shard = F.pmod(F.xxhash64(F.lit(6), "vec_id", "vector"), F.lit(shards))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        block.alias("block"),
        "vec_id",
        "vector",
        "least",
        F.lit(True).alias("is_query"),
    )
    given = vectors.select(
        shard.alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"),
        "vec_id",
        "vector",
        F.lit(None).cast("long").alias("least"),
        F.lit(False).alias("is_query"),
    )
    cell = (F.col("shard") * query_blocks + F.col("block")).alias("cell")
    cells = asked.select(*given.columns).union(given).select(cell, "vec_id", "vector", "least", "is_query")
    found = (
        cells.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(lambda b: search_batches(b, k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
