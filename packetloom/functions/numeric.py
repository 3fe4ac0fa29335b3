"""Scalar numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """F1. numerator / denominator, 0 where the denominator is NULL or not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F2. NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def normalize_score(value: Column, minimum: float, maximum: float) -> Column:
    """F2. Position of value in [minimum, maximum], clamped to [0, 1]."""
    if maximum <= minimum:
        return F.lit(0.0)
    return clamp((value - F.lit(minimum)) / F.lit(maximum - minimum))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite(value: Column) -> Column:
    """P6. The value as double, or NULL where it is blank, unparsable, NaN or infinite."""
    number = F.expr("NULL") if value is None else F.trim(value.cast("string")).try_cast("double")
    return F.when(is_finite(number), number)


def finite_double(value: Column) -> Column:
    """P6 for columns that are numeric already."""
    number = value.cast("double")
    return F.when(is_finite(number), number)


def sigmoid(value: Column) -> Column:
    """F4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def arg_max(values: Column) -> Column:
    """F4. 0-based position of the first maximum of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def top_two_margin(values: Column) -> Column:
    """F4. Largest minus second largest value of an array."""
    ordered = F.sort_array(values, asc=False)
    return ordered[0] - ordered[1]


def log_clip(value: Column) -> Column:
    """F6. log1p of the value clipped at zero."""
    return F.log1p(F.when(value < 0, 0.0).otherwise(value))


def pct_change(value: Column, previous: Column) -> Column:
    """W5. Relative change; a zero base gives +/-infinity or NaN as in IEEE division."""
    value, previous = value.cast("double"), previous.cast("double")
    zero_base = (
        F.when(value > 0, F.lit(float("inf"))).when(value < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )
    return F.when(previous.isNull() | value.isNull(), F.lit(0.0)).when(previous == 0, zero_base).otherwise(
        (value - previous) / F.when(previous != 0, previous)
    )


def distinct_with_null(column: Column) -> Column:
    """Distinct count in which NULL counts as one value."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))




def distinct_of_few(column: Column) -> Column:
    """Distinct count of a column with a bounded range, such as ports (at most 65,536) or protocols.

    The values of a group are held as a set, so that several such counts in one aggregation copy no rows;
    ``count_distinct`` copies each row per counted column and shuffles twice.
    """
    return F.size(F.collect_set(column)).cast("long")


def bind(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
