"""Helpers of the text operators: row maps, bounded text blocks, hashed counts, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of text a task holds as numbers at a time.
BLOCK_CHARS = 1 << 18
# Rows whose dense counts a task holds at a time.
BLOCK_ROWS = 256
# Rows of an Arrow batch that a row map works on at a time.
SLICE_ROWS = 1024
# Hashes that a sample is drawn from: far more than any table has rows, so that no rate comes down to none.
HASH_RANGE = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """Whether labels of this row may not be learnt: crc32 of the id as text mod 3 is 1 (null id: false)."""
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (crc % 3 == 1).alias("held_out")


def map_batches(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply to slices of each Arrow batch the function that ``start`` makes once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, kept: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    """Columns ``kept`` of ``df`` with their types, then ``more``."""
    return T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in more])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def lowered(text: str) -> str:
    """Lower case, character by character: the one character whose lower case is two keeps the first of them."""
    return text.replace("İ", "i").lower()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blocks(texts: Sequence[str], reach: int) -> Iterator[tuple[int, int, list[tuple[int, str, int]]]]:
    """Cut texts into blocks of bounded size for n-grams of at most ``reach`` characters.

    Yields (first row, last row + 1, pieces). A piece is (row, string, starts):
    n-grams that begin at the first ``starts`` places of the string belong to
    it, so that a long text is counted whole, without gaps or repeats.
    """
    first, size, pieces = 0, 0, []
    for row, text in enumerate(texts):
        if row - first >= BLOCK_ROWS:
            yield first, row, pieces
            first, size, pieces = row, 0, []
        for at in range(0, len(text), BLOCK_CHARS):
            starts = min(BLOCK_CHARS, len(text) - at)
            if size + starts > BLOCK_CHARS and pieces:
                yield first, row + (pieces[-1][0] == row), pieces
                first, size, pieces = row, 0, []
            pieces.append((row, text[at : at + starts + reach - 1], starts))
            size += starts
    if first < len(texts):
        yield first, len(texts), pieces


def ngram_ids(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """A bucket for each run of ``order`` codes, by a seeded multiplicative hash."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), np.uint64(0x9E3779B97F4A7C15 * order & (2**64 - 1)), dtype=np.uint64)
    for k in range(order):
        h ^= codes[k : k + n].astype(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


def dense_counts(
    texts: Sequence[str], orders: Sequence[int], buckets: int, codes_of: Callable[[str], np.ndarray]
) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of the rows from there) for hashed n-grams; every row once, whole.

    ``codes_of`` turns a string into one number per character.
    """
    total, start = None, 0
    for first, end, pieces in blocks(texts, max(orders)):
        counts = np.zeros((end - first) * buckets)
        for order in orders:
            ids = []
            for row, text, starts in pieces:
                grams = ngram_ids(codes_of(text), order, buckets)[:starts]
                ids.append(grams + (row - first) * buckets)
            if ids:
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
        counts = counts.reshape(end - first, buckets)
        # A long text goes on from the block before.
        if total is not None and first < start + len(total):
            total[first - start] += counts[0]
            if end - first > 1:
                total = np.concatenate([total, counts[1:]])
        else:
            if total is not None:
                yield start, total
            total, start = counts, first
        if len(total) > 2 * BLOCK_ROWS:
            yield start, total[:-1]
            total, start = total[-1:], start + len(total) - 1
    if total is not None:
        yield start, total


def summed(df: DataFrame, size: int, count: Callable[[], tuple[Callable, Callable]]) -> np.ndarray:
    """The sum over all rows of a vector of fixed ``size``, counted per task and added up.

    ``count`` gives a task (add batch, get vector). Only the sums reach the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, get = count()
        for batch in batches:
            add(batch)
        vector = np.asarray(get(), dtype=np.float64)
        place = np.flatnonzero(vector)
        yield pa.record_batch({"i": pa.array(place, pa.int32()), "n": pa.array(vector[place], pa.float64())})

    sums = df.mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["n"].to_numpy()
    return out


def document_frequencies(
    df: DataFrame, counted: Callable[[list[str]], Iterator[tuple[int, np.ndarray]]], buckets: int, column: str = "text"
) -> tuple[np.ndarray, float]:
    """In how many of all documents each bucket occurs, and how many documents there are.

    ``counted`` gives the counts of texts in blocks, as ``dense_counts`` does.
    """

    def count():
        seen = np.zeros(buckets + 1)

        def add(batch):
            for _, counts in counted(texts_of(batch, column)):
                seen[:buckets] += (counts > 0).sum(axis=0)
                seen[buckets] += len(counts)

        return add, lambda: seen

    seen = summed(df.select(column), buckets + 1, count)
    return seen[:buckets], seen[buckets]


def idf(frequencies: np.ndarray, documents: float) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequencies)) + 1


def tfidf(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows log(1 + count) * weight of length 1; rows without counts stay 0."""
    rows = (np.log1p(counts) * weights).astype(np.float32)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, norms, out=rows, where=norms > 0)


def bounded_sample(
    df: DataFrame, bound: int, classes: str, even: bool = True, key: str = "doc_id", counts: dict | None = None
) -> DataFrame:
    """About ``bound`` rows at most, by the hash of ``key``; the same rows come on every run.

    Either evenly from the values of ``classes`` (a rare one is taken whole) or,
    with ``even=False``, in their own proportions. ``counts`` are the rows of
    each value, counted here unless given.
    """
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy(classes).count().collect()}
    if not counts:
        return df
    keep = F.lit(False)
    for value, n in counts.items():
        rate = min(1.0, bound / len(counts) / n if even else bound / sum(counts.values()))
        part = F.pmod(F.xxhash64(F.lit(97), F.col(key)), F.lit(HASH_RANGE)) < F.lit(int(rate * HASH_RANGE))
        keep = keep | (F.col(classes).eqNullSafe(F.lit(value)) & part)
    return df.filter(keep)


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled ids that may be learnt from; the greatest label of a repeated id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def learnt_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, even: bool = True) -> DataFrame:
    """(doc_id, text, label) of at most about ``bound`` labelled rows that may be learnt from.

    The sample of label rows is bounded, so it is broadcast and no text is shuffled.
    """
    sample = bounded_sample(learnable(labels, label), bound, "label", even).select(F.col("doc_id").alias("_learnt"), "label")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_learnt")).select("doc_id", "text", "label")
