"""Global order without a global sort in one task.

Positions, cumulative sums and neighbour windows over a whole table are split
by *value ranges*: Spark's range partitioning deals the rows to ordered parts,
each part is summed by its own task, and the totals of the earlier parts are
added. How even the parts are never changes the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.storage import materialise

ROWS_PER_RANGE = 1_000_000


def range_count(df: DataFrame) -> int:
    """One range per million rows, and one per core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_RANGE))


def _ranged(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The table in ordered parts, written once, with ``_range``: the number of the row's part."""
    parts = df.repartitionByRange(range_count(df), *order_by).sortWithinPartitions(*order_by)
    return materialise(parts.withColumn("_range", F.spark_partition_id()), "ordered")


def prefix_sums(df: DataFrame, order_by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add, per entry of ``sums``, its total over all rows ordered before the row.

    ``order_by`` must identify a row. The rows are counted, then written in
    ranges; the totals and the rows are two passes over that copy.
    """
    ranged = _ranged(df, order_by)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    # One row per range, a millionth of the table.
    earlier_ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier_ranges), F.lit(0)).alias(f"_start_{n}") for n in sums],
    )
    earlier_rows = (
        Window.partitionBy("_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = [F.coalesce(F.sum(c).over(earlier_rows), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()]
    return (
        ranged.select("*", *inside)
        .join(F.broadcast(starts), "_range")
        .select(*df.columns, *[(F.col(f"_start_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])
    )


def ordered_index(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the given total order."""
    return prefix_sums(df, order_by, {name: F.lit(1).cast("bigint")})


def halo_blocks(df: DataFrame, position: str, block_rows: int, halo: int) -> DataFrame:
    """Cut a positioned table into blocks that overlap by ``halo`` rows.

    Each row is in the block of its position (``_own``) and, when later blocks
    look back on it, in those too. Only ``halo`` rows per block are copied.
    """
    own = F.floor(F.col(position) / block_rows)
    last = F.floor((F.col(position) + halo) / block_rows)
    return df.withColumn("_block", F.explode(F.sequence(own, last))).withColumn(
        "_own", F.col("_block") == own
    )
