"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.storage import materialise, new_path, remove


def components(edges: DataFrame, ids: str = "long") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Alternates two steps until nothing changes: every node passes the smallest
    of its neighbourhood on to its larger neighbours, then to itself and its
    smaller ones. Each round is written, so lineage stays short, and the table
    of the round before goes. A round only joins edges with one row per node; a
    node with very many edges is split by the adaptive skew join.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialise(links, "links", path)
    state = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, path = path, new_path(spark, "links")
        links = materialise(small, "links", path)
        remove(spark, before)
        new = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            break
        state = new
    roots = links.select(F.col("b").alias("node")).distinct()
    return (
        links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
        .select(F.col("node").cast(ids), F.col("component").cast(ids))
    )
