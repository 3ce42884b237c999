"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in a global order by the hash of their text, so equal texts are
neighbours. Spark's range partitioning makes ordered parts; the totals of the
parts give each part its start, and a running sum inside a part gives each row
its place among all bytes. Cuts lie at equal targets. A cut that would fall
inside a small group of equal texts moves to the nearer end of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.storage import materialise

LAW = "bytes"
ROWS_PER_PART = 1_000_000
# A group of equal texts of at most this share of a shard is not cut.
WHOLE_GROUP_SHARE = 1 / 64


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text and one for its end; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _with_prefix_sums(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``_bytes`` and ``_rows``: what lies before the row in the global order.

    Parts follow the number of rows, so the table of part totals is about a
    millionth of the input; it is broadcast.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PART))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_b"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_start_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start_n"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in_b", F.coalesce(F.sum(size).over(before), F.lit(0)))
        .withColumn("_in_n", (F.row_number().over(inside) - 1).cast("long"))
        .join(F.broadcast(starts), "_part")
        .select(
            *df.columns, (F.col("_start_b") + F.col("_in_b")).alias("_bytes"), (F.col("_start_n") + F.col("_in_n")).alias("_rows")
        )
    )


def _cuts(placed: DataFrame, shards: int) -> list[int]:
    """Places of the cuts in bytes, from two passes that return at most ``shards`` rows each."""
    total = placed.agg(F.max(F.col("_bytes") + F.col("size"))).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    at_a_cut = F.lit(False)
    for t in targets:
        at_a_cut = at_a_cut | ((F.col("_bytes") < t) & (F.col("_bytes") + F.col("size") > t))
    # A cut between two rows of one group lies inside the group as well.
    for t in targets:
        at_a_cut = at_a_cut | (F.col("_bytes") == t)
    groups = [r[0] for r in placed.filter(at_a_cut).select("_group").distinct().collect()]
    ranges = (
        placed.filter(F.col("_group").isin(groups))
        .groupBy("_group")
        .agg(F.min("_bytes").alias("low"), F.max(F.col("_bytes") + F.col("size")).alias("high"))
        .collect()
    )
    cuts = []
    for t in targets:
        for r in ranges:
            if r.low < t < r.high and r.high - r.low <= WHOLE_GROUP_SHARE * total / shards:
                t = r.low if t - r.low <= r.high - t else r.high
                break
        cuts.append(t)
    return cuts


def byte_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard`` and ``slot`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1 (a null text has none and the
    checksum of an empty one). Shards 0 to ``shards`` - 1 hold neighbouring rows
    and differ by little more than a text or a small group of equal texts.
    ``slot`` counts the rows of a shard from 0. Ties of the order (equal texts)
    follow the key; repeated rows follow their place in the input. An empty
    table gives no rows; with fewer rows than shards, some shards stay empty.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        text_bytes(text).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.md5(content.cast("binary")).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = materialise(_with_prefix_sums(rows, ["_group", key, "_row"], "size"), "placed")
    shard = F.lit(0)
    for cut in _cuts(placed, shards):
        shard = shard + (2 * F.col("_bytes") + F.col("size") > 2 * cut).cast("int")
    sharded = placed.withColumn("shard", shard)
    firsts = sharded.groupBy("shard").agg(F.min("_rows").alias("_first"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_rows") - F.col("_first")).alias("slot")
    )
