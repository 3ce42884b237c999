"""Column expressions on dates, numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the spellings of a number that count as numeric in a text column.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_date(date: Column, strict: bool = True) -> Column:
    """Cast to a date; a value that is no date raises, or becomes NULL if not strict."""
    return date.cast("date") if strict else date.try_cast("date")


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "MM")


def is_december(date: Column) -> Column:
    return (F.month(date) == 12).cast("int")


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMM")


def coerce_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes 0.

    White space around the number does not count. An infinite rate is no
    number, however it is spelt.
    """
    trimmed = F.trim(text, F.lit(" \t\r\n"))
    number = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def to_log(target: Column) -> Column:
    """log(1 + y). The target is a rate, so values of -1 or less are an input error."""
    return F.when(
        target <= -1, F.raise_error(F.lit("log target needs values above -1")).cast("double")
    ).otherwise(F.log1p(target))


def from_log(prediction: Column) -> Column:
    """exp(p) - 1, never below 0; NaN and NULL stay what they are."""
    rate = F.expm1(prediction)
    return F.when(rate < 0, F.lit(0.0)).otherwise(rate)


def residual_sign(residual: Column) -> Column:
    """'over' where the forecast exceeds the actual value, else 'under'."""
    return F.when(residual < 0, "over").otherwise("under")


def class_label(value: Column) -> Column:
    """A class number from any number or numeric text: what is behind the point is cut off, towards 0."""
    return value.cast("double").cast("int")
