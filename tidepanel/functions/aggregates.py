"""Aggregate column expressions; all of them combine map-side in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """NULL when the weights add up to 0; rows without a value carry no weight."""
    counted = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(counted))


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def root_mean_squared_error(actual: Column, predicted: Column) -> Column:
    error = actual - predicted
    return F.sqrt(F.avg(error * error))


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 - SSE/SST; a constant actual scores 1 when met exactly and 0 otherwise."""
    actual = F.when(predicted.isNotNull(), actual)
    error = actual - predicted
    sse = F.sum(error * error)
    sst = F.var_pop(actual) * F.count(error)
    flat = F.when(sse == 0, 1.0).when(sse.isNotNull(), 0.0)
    return F.when(F.min(actual) == F.max(actual), flat).otherwise(1 - F.try_divide(sse, sst))


def diebold_mariano(actual: Column, first: Column, second: Column) -> Column:
    """Statistic of the squared-loss difference; 0 when the difference never varies."""
    d = (actual - first) * (actual - first) - (actual - second) * (actual - second)
    spread = F.sqrt(F.var_pop(d) / F.count(d))
    return F.when(F.min(d) == F.max(d), 0.0).otherwise(F.try_divide(F.avg(d), spread))


def _rows(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def accuracy(label: Column, predicted: Column) -> Column:
    return F.avg((label == predicted).cast("double"))


def precision(label: Column, predicted: Column) -> Column:
    return _ratio(_rows((label == 1) & (predicted == 1)), _rows(predicted == 1))


def recall(label: Column, predicted: Column) -> Column:
    return _ratio(_rows((label == 1) & (predicted == 1)), _rows(label == 1))


def f1(label: Column, predicted: Column) -> Column:
    hits = _rows((label == 1) & (predicted == 1))
    return _ratio(2 * hits, _rows(label == 1) + _rows(predicted == 1))
