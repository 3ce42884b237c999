"""Poisson bootstrap sums: every row in all replicates at once, as one vector of weights.

A task adds up weight vectors per date as matrix products and hands on one row
per date and replicate, so input rows are never repeated.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

DRAWS_PER_HASH = 4  # an md5 digest holds four numbers of eight hex digits
ROWS_PER_STEP = 512  # rows whose weight vectors a task holds at a time
DATES_HELD = 512  # dates a task adds up before it hands their sums on

# Executors need only this module's functions; sending them along spares the cluster an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def poisson_steps() -> list[str]:
    """Poisson(1) distribution function at 0, 1, 2, ... as a share of 2**32, in
    eight lower-case hex digits; it ends where the share rounds to 1."""
    steps, total, term, k = [], 0.0, math.exp(-1), 0
    while round((total + term) * 2**32) < 2**32:
        total += term
        steps.append(format(round(total * 2**32), "08x"))
        k += 1
        term /= k
    return steps


def weight_vectors(keys: Sequence[str], replicates: int) -> np.ndarray:
    """Poisson(1) weights of each key (rows) in each replicate (columns), from digests of "key|number"."""
    ends = [f"|{c}".encode() for c in range(-(-replicates // DRAWS_PER_HASH))]
    digests = b"".join(md5(key + end).digest() for key in (k.encode() for k in keys) for end in ends)
    draws = np.frombuffer(digests, dtype=">u4").reshape(len(keys), -1)[:, :replicates]
    steps = np.array([int(s, 16) for s in poisson_steps()], dtype=np.uint32)
    return np.searchsorted(steps, draws, side="right").astype(np.float64)


def replicate_sums(df: DataFrame, date: str, key: str, values: Sequence[str], replicates: int) -> DataFrame:
    """(date, _replicate, _sum0, _weight0, ...): per value the weighted sum and the weights of the rows that have it."""
    names = [f"{part}{i}" for i in range(len(values)) for part in ("_sum", "_weight")]
    sums = [StructField(n, DoubleType()) for n in names]
    rows = df.select(date, F.col(key).alias("_key"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    kind = rows.schema[date]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def handed_on(arrow: pa.DataType) -> pa.RecordBatch:
            dates = [d for d in held for _ in range(replicates)]
            table = np.concatenate([v.T for v in held.values()]) if held else np.zeros((0, len(names)))
            numbers = np.tile(np.arange(replicates, dtype=np.int32), len(held))
            columns = [pa.array(dates, arrow), pa.array(numbers), *map(pa.array, table.T)]
            held.clear()
            return pa.record_batch(columns, names=[date, "_replicate", *names])

        for batch in batches:
            arrow = batch.schema.field(date).type
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(at, ROWS_PER_STEP)
                weights = weight_vectors(part.column("_key").to_pylist(), replicates)
                factors = []
                for i in range(len(values)):
                    value = part.column(f"_v{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                    there = ~part.column(f"_v{i}").is_null().to_numpy(zero_copy_only=False)
                    factors += [np.where(there, value, 0.0), there.astype(np.float64)]
                dates = part.column(date).to_pylist()
                for d in dict.fromkeys(dates):
                    own = np.array([x == d for x in dates]) if d is not None else np.array([x is None for x in dates])
                    added = np.stack([f[own] for f in factors]) @ weights[own]
                    held[d] = held[d] + added if d in held else added
                if len(held) >= DATES_HELD:
                    yield handed_on(arrow)
        if held:
            yield handed_on(arrow)

    partial = rows.mapInArrow(run, StructType([kind, StructField("_replicate", IntegerType()), *sums]))
    return partial.groupBy(date, "_replicate").agg(*[F.sum(n).alias(n) for n in names])
