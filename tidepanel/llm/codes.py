"""Compressed vector codes: product quantisation trained by Lloyd rounds over cover trees.

Blocks of rows keep a cover tree per part position, built once where the rows
are. A node knows a radius that holds all its points and, through cumulative
sums in tree order, their number and sum. In each round a node goes as a whole
to the entry nearest to its centre where the triangle inequality leaves no point
of it another choice; only ambiguous nodes are opened, and the points of
ambiguous leaves are compared with every entry. All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.storage import materialise

# Rows whose points make a tree, and points under which a node is a leaf.
TREE_ROWS = 1024
LEAF_ROWS = 8
# A table of sums per label is broadcast up to this many labels.
BROADCAST_LABELS = 100_000


def usable(vector: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def limit(width: int) -> int:
    """The greatest integer component, so that squared distances of ``width`` components fit into 64 bits."""
    return int((2.0**62 / width) ** 0.5) // 2


def quantised(vectors: Sequence[Sequence[float]], parts: int, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as rows x parts x width; shorter vectors are filled with 0."""
    lengths = {len(v) for v in vectors}
    if lengths == {parts * width}:
        out = np.array(vectors, dtype=np.float64)
    else:
        out = np.zeros((len(vectors), parts * width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    most = limit(width)
    return np.clip(np.floor(out * scale), -most, most).astype(np.int64).reshape(len(vectors), parts, width)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * largest * largest < 2**53:  # exact in doubles, which multiply faster
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(axis=1)


@dataclass(frozen=True)
class CoverTree:
    """Nodes cover ``order[start:end]``; children are numbered one after another, none for a leaf."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> CoverTree:
        """Top down: a node's children lie within half its radius of centres that are further apart than that."""
        apart = np.sqrt(distances(points, points).astype(np.float64))
        order = np.arange(len(points))
        nodes = [(0, len(points), 0)]
        radius, child, children = [], [], []
        at = 0
        while at < len(nodes):
            start, end, centre = nodes[at]
            at += 1
            members = order[start:end]
            far = apart[centre, members]
            reach = float(far.max())
            radius.append(reach)
            child.append(len(nodes))
            if reach == 0 or len(members) <= LEAF_ROWS:
                children.append(0)
                continue
            place, free = start, np.ones(len(members), dtype=bool)
            arranged, below, next_centre = [], 0, centre
            while True:
                # The node's own centre first, then the first point that nobody covers yet.
                near = free & (apart[next_centre, members] <= reach / 2)
                free &= ~near
                covered = members[near]
                arranged.append(covered)
                nodes.append((place, place + len(covered), next_centre))
                place += len(covered)
                below += 1
                if not free.any():
                    break
                next_centre = members[free.argmax()]
            order[start:end] = np.concatenate(arranged)
            children.append(below)
        start, end, centre = np.array(nodes).T
        return CoverTree(order, start, end, centre, np.array(radius), np.array(child), np.array(children))

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry of each point in tree order, points compared one by one); ties to the lower entry."""
        nearest = np.empty(len(points), dtype=np.int64)
        exact = []
        level = np.zeros(1, dtype=np.int64)
        while len(level):
            far = distances(points[self.centre[level]], entries)
            first = far.argmin(axis=1)
            root = np.sqrt(far.astype(np.float64))
            if root.shape[1] > 1:
                least, second = np.partition(root, 1, axis=1)[:, :2].T
            else:
                least, second = root[:, 0], np.full(len(root), np.inf)
            radius = self.radius[level]
            # A point is at most the radius nearer to any other entry and further from the first.
            sure = (radius == 0) | (least + 2 * radius < second * (1 - 1e-12) - 1e-6)
            for node, entry in zip(level[sure].tolist(), first[sure].tolist()):
                nearest[self.start[node] : self.end[node]] = entry
            doubtful = level[~sure]
            leaf = self.children[doubtful] == 0
            exact += [np.arange(self.start[n], self.end[n]) for n in doubtful[leaf].tolist()]
            opened = doubtful[~leaf]
            n = self.children[opened]
            level = np.repeat(self.child[opened] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        places = np.concatenate(exact) if exact else np.zeros(0, dtype=np.int64)
        if len(places):
            nearest[places] = distances(points[self.order[places]], entries).argmin(axis=1)
        return nearest, places

    def totals(self, points: np.ndarray, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each entry: differences of cumulative sums over runs of one entry."""
        edge = np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))
        ends = np.append(edge[1:], len(nearest))
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)])
        count, sums = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
        np.add.at(count, nearest[edge], ends - edge)
        np.add.at(sums, nearest[edge], running[ends] - running[edge])
        return count, sums


def packed(points: np.ndarray, trees: Sequence[CoverTree]) -> bytes:
    """A block's points (rows x parts x width) and its tree per part, in the smallest whole numbers that hold them."""
    kinds = [np.int16, np.int32, np.int64]
    most = int(np.abs(points).max(initial=0))
    arrays = {"points": points.astype(next(k for k in kinds if most <= np.iinfo(k).max))}
    for p, tree in enumerate(trees):
        for f in fields(tree):
            values = getattr(tree, f.name)
            arrays[f"{f.name}{p}"] = values if f.name == "radius" else values.astype(np.int16)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> tuple[np.ndarray, list[CoverTree]]:
    with np.load(io.BytesIO(data)) as arrays:
        points = arrays["points"].astype(np.int64)
        trees = []
        for p in range(points.shape[1]):
            values = {f.name: arrays[f"{f.name}{p}"] for f in fields(CoverTree)}
            trees.append(CoverTree(**{n: v if n == "radius" else v.astype(np.int64) for n, v in values.items()}))
    return points, trees


def planted(rows: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """(ids, labels, trees): one row per block of rows, with its points and trees; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                block = batch.slice(at, TREE_ROWS)
                points = quantised(block.column("vector").to_pylist(), parts, width, scale)
                trees = [CoverTree.of(points[:, p]) for p in range(parts)]
                lists = [
                    pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(c))
                    for c in ("vec_id", "label")
                ]
                columns = [*lists, pa.array([packed(points, trees)], pa.binary())]
                yield pa.record_batch(columns, names=["ids", "labels", "trees"])

    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)),
            T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
            T.StructField("trees", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def round_sums(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and sum of the points nearest to each entry (parts x entries x width)."""
    sent = blocks.sparkSession.sparkContext.broadcast(codebooks)
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                points, trees = unpacked(data.as_py())
                for p, tree in enumerate(trees):
                    found = tree.totals(points[:, p], tree.assign(points[:, p], books[p])[0], entries)
                    count[p] += found[0]
                    sums[p] += found[1]
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *sums[part, entry].T]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
    partial = blocks.select("trees").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return partial.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]])


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning all points and moving each used entry to its floored mean."""
    books = codebooks
    for _ in range(rounds):
        books = books.copy()
        for row in round_sums(blocks, codebooks).collect():  # one row per entry
            books[row.part, row.entry] = [s // row.n for s in row[3:]]
        codebooks = books
    return codebooks


def coded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row: its entries in hex, and the squared distances to them."""
    sent = blocks.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for i, data in enumerate(batch.column("trees")):
                points, trees = unpacked(data.as_py())
                entry = np.empty(points.shape[:2], dtype=np.int64)
                for p, tree in enumerate(trees):
                    entry[tree.order, p] = tree.assign(points[:, p], books[p])[0]
                apart = points - np.stack([books[p][entry[:, p]] for p in range(len(trees))], axis=1)
                error = (apart * apart).sum(axis=(1, 2))
                code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
                kept = [batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels")]
                columns = [*kept, pa.array(code), pa.array(error, pa.int64())]
                yield pa.record_batch(columns, names=["vec_id", "label", "code", "error"])

    schema = T.StructType(
        [
            T.StructField("vec_id", blocks.schema["ids"].dataType.elementType),
            T.StructField("label", blocks.schema["labels"].dataType.elementType),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    return blocks.mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def product_codes(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every usable row, and the codebooks (parts x entries x width).

    ``df`` has ``vec_id``, ``vector`` (array of numbers) and ``label``; other
    columns are not looked at. Rows whose vector is null or holds null or
    non-finite components are left out. Vectors are filled with 0 to the next
    multiple of ``parts`` of the longest one. Integer components are cut at
    ``limit(width)`` (2^28 for 16 of them). The codebooks start as the parts of
    the rows with the smallest vec_ids (ties by vector); a null vec_id starts no
    entry, but its row is coded. Repeated rows count and are returned each. An
    empty table gives no rows, and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    rows = df.select("vec_id", "label", "vector").filter(usable("vector"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    first = rows.filter(F.col("vec_id").isNotNull()).orderBy("vec_id", "vector").limit(entries).collect()
    codebooks = quantised([r.vector for r in first], parts, width, scale).transpose(1, 0, 2)
    blocks = materialise(planted(rows, parts, width, scale), "trees")
    if not first:
        if longest is not None:
            raise ValueError("no row has a vec_id, so that no codebook can start")
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumn("label_error", F.col("error")).limit(0), codebooks
    codebooks = trained(blocks, codebooks, rounds)
    final = materialise(coded(blocks, codebooks), "codes")
    sums = materialise(final.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return final.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), codebooks
