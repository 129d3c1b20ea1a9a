"""Sums of outer products over all rows of a table, and block-wise pair work.

Each task adds up its own rows in Arrow batches and emits one small matrix, so
no pair of columns is ever a row of a shuffle per input row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.sources.scratch import small_table

MAX_COLUMNS = 2048
#: Rows of a block that meet those of another at once.
TILE = 2048
#: Rows that a task of pair work hands on at once.
ROWS_OUT = 10_000


def index_of(df: DataFrame, column: str, values: Sequence[Any], out: str = "i") -> DataFrame:
    """Attach the place (from 0) of a key in a bounded list; other keys are dropped."""
    kind = df.schema[column].dataType.simpleString()
    places = [(v, i) for i, v in enumerate(values)]
    lookup = small_table(df.sparkSession, places, f"`{column}` {kind}, `{out}` int")
    return df.join(lookup, column)


def sparse_rows(cells: DataFrame, key: str, value: str, index: str = "i") -> DataFrame:
    """One row per key with its cells as ``array<struct<i, x>>``; the column list bounds its length."""
    return cells.groupBy(key).agg(
        F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("x"))).alias("cells")
    )


def _dense_chunks(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Dense (rows x size) matrices of one batch, at most about 4M cells each."""
    lists = batch.column(0)
    offsets = lists.offsets.to_numpy()
    step = max(1, 4_000_000 // max(size, 1))
    for start in range(0, len(lists), step):
        stop = min(start + step, len(lists))
        flat = lists.values.slice(offsets[start], offsets[stop] - offsets[start])
        rows = np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))
        dense = np.zeros((stop - start, size))
        dense[rows, flat.field("i").to_numpy()] = flat.field("x").to_numpy()
        yield dense


def gram(rows: DataFrame, size: int) -> DataFrame:
    """(i, j, value) with i <= j: the sum of x_i * x_j over all rows of ``sparse_rows``."""
    if size > MAX_COLUMNS:
        raise ValueError(f"{size} columns are more than {MAX_COLUMNS}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for dense in _dense_chunks(batch, size):
                total += dense.T @ dense
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"]
        )

    sums = rows.select("cells").mapInArrow(task, "i int, j int, value double")
    return sums.groupBy("i", "j").agg(F.sum("value").alias("value"))


def as_matrix(sums: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix of ``gram``: ``size`` is bounded, the input rows are not."""
    matrix = np.zeros((size, size))
    for i, j, value in sums.select("i", "j", "value").collect():
        matrix[i, j] = matrix[j, i] = value
    return matrix


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long double arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_count(values: int, largest: int = 1 << 22, smallest: int = 1 << 13, tasks: int = 8) -> int:
    """Blocks for pair work on so many numbers: never above ``largest`` of them each, and several tasks when there is work for them."""
    return max(1, math.ceil(values / largest), min(math.ceil(values / smallest), tasks))


def each_block_pair(
    rows: DataFrame,
    blocks: int,
    tiles: Callable[[pa.Table], Sequence[Any]],
    work: Callable[[Any, Any | None], pa.Table | None],
    schema: str,
    meeting: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Run ``work`` on the tiles of every pair of blocks of a table that has a ``block`` column.

    A row is copied once per block, never once per other row, so blocks are as
    large as a task can hold. ``tiles`` cuts a block into parts small enough
    to meet each other at once; ``work`` sees two of them, or one and None for
    pairs inside it, and returns only the rows that matter. ``meeting`` names the
    (low, high) pairs of blocks that can give any rows; without it all meet.
    """
    if meeting is None:
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
        spread = rows.select("*", other)
    else:
        ways = sorted({(i, j) for pair in meeting for i, j in (pair, pair[::-1])})
        spread = rows.join(rows.sparkSession.createDataFrame(ways, "block int, _other int"), "block")
    names = [c for c in rows.columns if c != "block"]
    low, high = F.least("block", "_other").alias("_low"), F.greatest("block", "_other").alias("_high")
    spread = spread.select(*names, low, high, (F.col("block") < F.col("_other")).alias("_first"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        inside = table.column("_low")[0] == table.column("_high")[0]
        first = table.column("_first")
        table = table.select(names)
        if inside:
            a = b = tiles(table)
        else:
            a, b = tiles(table.filter(first)), tiles(table.filter(pa.compute.invert(first)))
        del table, first
        held, size = [], 0
        for i, x in enumerate(a):
            for y in [None, *a[i + 1 :]] if inside else b:
                found = work(x, y)
                if found is not None and found.num_rows:
                    held, size = [*held, found], size + found.num_rows
                if size >= ROWS_OUT:
                    yield from pa.concat_tables(held).combine_chunks().to_batches(ROWS_OUT)
                    held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches(ROWS_OUT)

    return spread.groupBy("_low", "_high").applyInArrow(task, schema)
