"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has a 16-bit MinHash value per position; the distance of two
signatures is the number of positions that differ. The positions are split into
chunks. By the pigeonhole principle two signatures within the threshold
distance agree in some chunk up to one position, so each chunk is indexed once
for every position left out: all pairs within the threshold share a key.

Keys that hold the same members are looked at once. Members of a key are
compared in blocks of bounded size, and a task returns only a spanning forest
of the pairs within the threshold over all its keys, never all pairs. Its components hold every
candidate pair; inside them, again in blocks, pairs are confirmed on their full
shingle sets, and the components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared, shingles
from tidepanel.llm.components import components
from tidepanel.storage import materialise

CHUNK = 5  # positions of a chunk
# Chance that two sets exactly at the similarity threshold differ in more positions than the join allows.
MISS = 2e-5
# Members of a block of a key (a signature is some hundred bytes, and a row goes to as many cells as its
# key has blocks), texts of a block of a component, and shingles of such a block.
KEY_BLOCK = 4096
# Signatures whose keys one task makes (50 to 85 a signature), about. What a task groups and shuffles stays small.
KEYED_ROWS = 4096
# Rows of keys with the same first member that one task takes, about.
TASK_ROWS = 2_000
TEXT_BLOCK = 256
TEXT_BLOCK_SHINGLES = 4_000_000


@dataclass(frozen=True)
class Shape:
    """Shingles of ``width`` words; linked from ``percent`` per cent of the union on."""

    width: int
    percent: int

    @property
    def chunks(self) -> int:
        """The fewest chunks for which a pair at the threshold is missed with chance MISS at most."""
        differs = 1 - self.percent / 100
        for m in range(2, 100):
            k = m * CHUNK
            missed = sum(comb(k, i) * differs**i * (1 - differs) ** (k - i) for i in range(2 * m, k + 1))
            if missed <= MISS:
                return m
        raise ValueError("the similarity threshold is too low for this join")

    @property
    def positions(self) -> int:
        return self.chunks * CHUNK

    @property
    def distance(self) -> int:
        """The largest distance for which the join finds every pair."""
        return 2 * self.chunks - 1


def signatures(df: DataFrame, shape: Shape, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_shingles``, the set's two keys ``h1`` and ``h2``, and its ``signature``."""
    factors = shingles.multipliers(shape.positions)
    long = T.LongType()
    schema = shared.fields(df, [key], ("n_shingles", long), ("h1", long), ("h2", long), ("signature", T.BinaryType()))

    def start():
        def step(batch):
            sizes, first, second, signs = [], [], [], []
            for words in shingles.words_of(shared.texts_of(batch)):
                found = shingles.shingle_set(words, shape.width)
                a, b = shingles.set_keys(found)
                sizes.append(len(found))
                first.append(a)
                second.append(b)
                signs.append(shingles.signature(found, factors).tobytes())
            columns = [batch.column(key), *[pa.array(v, pa.int64()) for v in (sizes, first, second)]]
            return pa.record_batch([*columns, pa.array(signs, pa.binary())], schema.names)

        return step

    return shared.map_batches(df.select(key, "text"), start, schema)


def chunk_keys(shape: Shape) -> Column:
    """The keys of a signature: every chunk with each of its positions left out."""
    keys = []
    for chunk in range(shape.chunks):
        for out in range(CHUNK):
            begin = 2 * chunk * CHUNK
            before = F.substring("signature", begin + 1, 2 * out)
            after = F.substring("signature", begin + 2 * out + 3, 2 * (CHUNK - out - 1))
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + out), before, after))
    return F.explode(F.array(*keys)).alias("key")


def keyed_classes(classes: DataFrame, shape: Shape) -> DataFrame:
    """(rep, key) of every key of every class, in tasks of about ``KEYED_ROWS`` classes."""
    tasks = max(1, -(-classes.count() // KEYED_ROWS))
    return classes.select("rep", "signature").repartition(tasks, "rep").select("rep", chunk_keys(shape))


def in_cells(members: DataFrame, group: str, member: str, blocks: Column) -> DataFrame:
    """Deal the members of each group to ``blocks`` blocks by hash, and pair up the blocks.

    Each row goes to the cells of its block with every block; ``own`` is its
    block and (``low``, ``high``) the pair of the cell.
    """
    own = F.pmod(F.xxhash64(F.lit(3), member), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    )
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    rest = [c for c in members.columns if c != group]
    return dealt.select(group, low, high, "own", *rest)


def cells_of(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of each cell, from a partition sorted by group, low and high."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = np.column_stack(
            [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (group, "low", "high")]
        )
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for start, end in zip(edges, edges[1:]):
            if end == start:
                continue
            now = tuple(ids[start].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


class Links:
    """Which ids a task has linked so far, over all its cells."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def differing(signs: np.ndarray) -> Callable[[int], np.ndarray]:
    """For a row, in how many positions each later row differs from it."""
    return lambda i: (signs[i + 1 :] != signs[i]).sum(axis=1)


def forest(
    links: Links,
    ids: list[int],
    own: np.ndarray,
    apart_from: Callable[[int], np.ndarray],
    distance: float,
    confirmed: Callable[[int, int], bool] | None = None,
) -> list[tuple[int, int]]:
    """Edges (pairs of ids) of a spanning forest of the cell's pairs within ``distance``.

    ``apart_from`` gives the distances of a row to all later ones. Only pairs of
    two different blocks count if the cell has two. Pairs that the task has
    connected already are skipped, others must be ``confirmed``.
    """
    n = len(own)
    two = own.min() != own.max()
    left, edges = len({links.find(x) for x in ids}), []
    for i in range(n - 1):
        if left == 1:
            break
        apart = apart_from(i)
        near = apart <= distance
        if two:
            near &= own[i + 1 :] != own[i]
        places = np.flatnonzero(near)
        # The nearest first: they are the likeliest links, and links spare comparisons.
        for j in (places[np.argsort(apart[places], kind="stable")] + i + 1).tolist():
            if links.find(ids[i]) != links.find(ids[j]) and (confirmed is None or confirmed(i, j)):
                links.join(ids[i], ids[j])
                edges.append((ids[i], ids[j]))
                left -= 1
    return edges


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array([e[k] for e in edges], pa.int64()) for k, n in enumerate("ab")})


def candidate_forest(classes: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): edges that connect every pair of representatives within the threshold distance."""
    keyed = keyed_classes(classes, shape)
    held = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rep").alias("first"),
        F.max("rep").alias("last"),
        F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("y"),
    )
    # Keys with the same members ask for the same comparisons: one of them stays.
    several = held.filter("n > 1").groupBy("n", "first", "last", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / KEY_BLOCK)
    # Keys with the same first member mostly hold the same documents. They go to one task, which then
    # links those once, or to as many tasks as their cells have rows for.
    shares = several.groupBy("first").agg(F.ceil(F.sum(F.col("n") * blocks) / TASK_ROWS).alias("shares"))
    several = several.join(shares, "first").select("key", "n", "first", "shares")
    cells = in_cells(keyed.join(several, "key"), "key", "rep", blocks)
    share = F.pmod(F.xxhash64("key", "low", "high"), "shares")
    cells = cells.withColumn("task", F.xxhash64("first", share)).drop("n", "first", "shares")
    cells = cells.join(classes.select("rep", "signature"), "rep")

    def run(batches):
        links = Links()
        for cell in cells_of(batches, "key"):
            signs = np.stack([np.frombuffer(s, np.uint16) for s in cell.column("signature").to_pylist()])
            own = cell.column("own").to_numpy()
            edges = forest(links, cell.column("rep").to_pylist(), own, differing(signs), shape.distance)
            if edges:
                yield edge_batch(edges)

    dealt = cells.repartition("task").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def confirmed_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): confirmed links that connect every confirmed pair of each cluster."""
    members = clusters.join(classes, F.col("node") == F.col("rep")).select(
        "rep", "n_shingles", "h1", "h2", "signature", F.col("component").alias("cluster")
    )
    sizes = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / TEXT_BLOCK), F.ceil(F.sum("n_shingles") / TEXT_BLOCK_SHINGLES)
        ).alias("blocks")
    )
    members = members.join(sizes, "cluster")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").filter("rep IS NOT NULL")
    cells = in_cells(members.join(texts, "rep"), "cluster", "rep", F.col("blocks"))
    order = ["cluster", "low", "high"]

    def run(batches):
        links = Links()
        for cell in cells_of(batches, "cluster"):
            rows = cell.drop_columns(["text"]).to_pylist()
            found = [shingles.shingle_set(w, shape.width) for w in shingles.words_of(shared.texts_of(cell))]
            # An id may repeat: the row counts whose set is the representative's, once.
            seen, places = set(), []
            for i, row in enumerate(rows):
                if (row["rep"], row["h1"]) not in seen and shingles.set_keys(found[i]) == (row["h1"], row["h2"]):
                    seen.add((row["rep"], row["h1"]))
                    places.append(i)
            if len(places) < 2:
                continue
            rows, found = [rows[i] for i in places], [found[i] for i in places]

            def confirmed(i: int, j: int) -> bool:
                a, b = found[i], found[j]
                if 100 * min(len(a), len(b)) < shape.percent * max(len(a), len(b)):
                    return False
                both = len(np.intersect1d(a, b, assume_unique=True))
                return 100 * both >= shape.percent * (len(a) + len(b) - both)

            signs = np.stack([np.frombuffer(row["signature"], np.uint16) for row in rows])
            own = np.array([row["own"] for row in rows])
            edges = forest(links, [row["rep"] for row in rows], own, differing(signs), shape.distance, confirmed)
            if edges:
                yield edge_batch(edges)

    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shape: Shape) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs`` (doc_id, text).

    Words are the runs without ASCII white space, A-Z lower-cased. Documents are
    linked from ``shape.percent`` of the union of their shingle sets on;
    ``component_id`` is the smallest id reachable. Equal sets are one class, so
    copies are never paired with each other. A text without words, null
    included, and a row without id are linked with nothing; the latter has a
    null component and is kept. Rows that repeat an id are one document. Other
    columns are ignored.
    """
    signed = materialise(signatures(docs, shape), "signatures")
    of_set = ["h1", "h2", "n_shingles"]
    classes = (
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*of_set)
        .agg(F.min(F.struct("doc_id", "signature")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(*of_set, F.col("first.doc_id").alias("rep"), F.col("first.signature").alias("signature"), "copies")
    )
    classes = materialise(classes, "classes")
    clusters = components(candidate_forest(classes, shape))
    links = confirmed_links(docs, classes, clusters, shape)
    # A repeated id with several texts ties their classes together.
    ties = signed.filter("n_shingles > 0").select(F.col("doc_id").alias("a"), *of_set)
    ties = ties.join(classes.select(*of_set, F.col("rep").alias("b")), of_set).select("a", "b").filter("a <> b")
    repeated = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    ties = ties.join(repeated.select(F.col("doc_id").alias("a")), "a", "left_semi")
    found = components(links.union(ties.select("a", "b")))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.filter("component IS NOT NULL OR copies > 1").select(
        *of_set, F.coalesce("component", "rep").alias("component")
    )
    rows = signed.drop("signature").join(named, of_set, "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_first(docs: DataFrame, shape: Shape) -> DataFrame:
    """The documents, all columns, that stay: one row of each group.

    That is the row of the group's smallest id; of rows that repeat this id, the
    first in the order of a hash of their text stays (null last; of equal texts,
    any). Rows without id or words all stay. An empty table gives none; columns
    may have any names.
    """
    kept = near_duplicates(docs, shape).filter("kept AND doc_id IS NOT NULL AND n_shingles > 0")
    key, place = shared.free_names(docs, "_kept", "_place")
    ids = kept.select(F.col("doc_id").alias(key)).distinct()
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    loose = docs.filter(F.col("doc_id").isNull() | ~words)
    firm = docs.filter(F.col("doc_id").isNotNull() & words).join(ids, F.col("doc_id") == F.col(key), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = firm.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return first.unionByName(loose)
