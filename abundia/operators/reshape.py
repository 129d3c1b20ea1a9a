"""Wide <-> long reshaping of keyed matrices."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zero_filled(cells: DataFrame, keys: Sequence[str], column: str, values: Sequence[Any], measures: Sequence[str]) -> DataFrame:
    """One row per (keys, value) for every listed value; absent cells are 0.

    The cells of a key are packed into one map, whose size the value list
    bounds, and read back for each value. (keys, column) must be unique. A row
    whose ``column`` is NULL only makes its keys known.
    """
    packed = F.when(F.col(column).isNotNull(), F.struct(F.col(column), F.struct(*measures)))
    wide = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(packed)).alias("_cells"))
    kind = cells.schema[column].dataType
    listed = F.array(*[F.lit(v).cast(kind) for v in values])
    long = wide.select(*keys, "_cells", F.explode(listed).alias(column))
    cell = F.try_element_at("_cells", F.col(column))
    filled = [F.coalesce(cell[m], F.lit(0).cast(cells.schema[m].dataType)).alias(m) for m in measures]
    return long.select(*keys, column, *filled)


def to_wide(cells: DataFrame, keys: Sequence[str], column: str, values: Sequence[Any], measure: str) -> DataFrame:
    """Sum ``measure`` into one column per listed value, 0 where there is no cell."""
    wide = cells.groupBy(*keys).pivot(column, list(values)).agg(F.sum(measure))
    zero = F.lit(0).cast(cells.schema[measure].dataType)
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), zero).alias(str(v)) for v in values])


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, measure: str) -> DataFrame:
    """One row per key and listed column."""
    return df.unpivot(list(keys), list(columns), name, measure)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the contiguous columns from ``first`` to ``last``."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def transposed(df: DataFrame, key: str, columns: Sequence[str], rows: Sequence[Any], name: str) -> DataFrame:
    """Flip a keyed matrix: the columns become rows, the listed row keys become columns."""
    cells = df.unpivot([key], list(columns), name, "_value")
    return cells.groupBy(name).pivot(key, list(rows)).agg(F.first("_value"))
