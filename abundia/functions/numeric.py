"""Guarded arithmetic on columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(above: Column, below: Column) -> Column:
    """``above / below``; x/0 is 0 for x != 0, and 0/0 is NULL."""
    return F.when((below == 0) & (above != 0), F.lit(0.0)).otherwise(F.try_divide(above, below))


def finite_or_zero(column: Column) -> Column:
    """Replace an infinite value by 0."""
    return F.when(F.abs(column) == float("inf"), F.lit(0.0)).otherwise(column)


def cut_off(column: Column, threshold: float) -> Column:
    """Values below the threshold count as absent."""
    return F.when(column < threshold, F.lit(0.0)).otherwise(column)


def binary(column: Column) -> Column:
    """1 where the value is not 0, else 0."""
    return (column != 0).cast("int")


def positive(column: Column) -> Column:
    """1 where the value is above 0, else 0; NULL counts as 0."""
    return F.when(column > 0, 1).otherwise(0)


def row_sum(columns: Sequence[str]) -> Column:
    """Sum of several columns of one row, NULL as 0."""
    return functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def standard_error(total: Column, spread: Column, present: Column, n: int) -> Column:
    """Standard error of the mean of ``n`` cells, of which only ``present`` exist and the others are 0.

    ``spread`` is the centred sum of squares of the cells that exist (their
    number times ``var_pop``), so large values that differ little keep their
    digits. The zero cells join it in closed form: no zero rows are needed.
    """
    if n < 2:
        return F.lit(None).cast("double")
    between = F.coalesce(F.try_divide(total * total, present), F.lit(0.0)) * (F.lit(n) - present) / n
    return F.sqrt((spread + between) / (n - 1)) / F.sqrt(F.lit(float(n)))


def rescaled(value: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Map [low, high] onto ``to``; a constant becomes the midpoint of ``to``."""
    start, end = to
    moved = (value - low) / F.nullif(high - low, F.lit(0.0)) * (end - start) + start
    return F.when(value.isNotNull(), F.coalesce(moved, F.lit((start + end) / 2)))
