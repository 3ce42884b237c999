"""Quantiles from mergeable sketches: one pass, bounded memory, and sketches of parts add up.

A KLL sketch keeps every value of a group up to its size, and beyond that a
sample whose ranks are off by at most ``rank_error``. Sketches can be stored, a
row per month say, and merged into any coarser group later without the rows.
The sample is random: what needs the same quantiles twice writes them first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4096
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def rank_error(size: int = SIZE) -> float:
    """By what share of a group's values the rank of a quantile may be off, with a chance of 99 %."""
    return 2.296 / size**0.9021  # fixed values of the sketch


def value_sketches(df: DataFrame, by: Sequence[str], values: Sequence[str], size: int = SIZE) -> DataFrame:
    """One row per group of ``by`` with a sketch of each column of ``values``, under the column's name.

    Null and NaN are not counted. Sketches of a group are merged map-side, so a
    group of any size is one sketch per task. Without ``by`` there is one row,
    also for an empty table.
    """
    sketched = [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(size)).alias(v) for v in values]
    return df.groupBy(*by).agg(*sketched)


def merged(sketches: DataFrame, by: Sequence[str], values: Sequence[str], size: int = SIZE) -> DataFrame:
    """The sketches of finer groups merged into those of ``by``."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(v, size).alias(v) for v in values])


def quantiles(
    sketches: DataFrame, by: Sequence[str], values: Sequence[str], levels: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """(by, measure, n, a column per level): a row per group and sketched column.

    A quantile is the smallest value that at least the level's share of the
    values does not exceed; null in a group without values.
    """
    rows = []
    for v in values:
        n = F.kll_sketch_get_n_double(v)
        at = [F.when(n > 0, F.kll_sketch_get_quantile_double(v, F.lit(level))).alias(name) for name, level in levels.items()]
        rows.append(F.struct(F.lit(v).alias("measure"), n.alias("n"), *at))
    return sketches.select(*by, F.inline(F.array(*rows)))
