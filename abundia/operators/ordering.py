"""Running totals, positions and ranks that do not put a group in one task.

Rows are range-partitioned by (group, order), so a hot group is spread over
many tasks. The written table fixes which task holds which rows; totals per
task and group then give each task its starting offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundia.sources.scratch import saved, sized


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    amount: str | None = None,
    out: str = "before",
) -> DataFrame:
    """Add ``out``: the total of ``amount`` (or row count) over the earlier rows of a group.

    ``order`` must be unique within a group. NULL keys form a group of their own.
    """
    group = F.struct(*keys, "_slice")  # compares NULL fields as equal
    weight = F.lit(1).cast("long") if amount is None else F.col(amount)
    ranged = saved(
        df.withColumn("_weight", weight)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.unboundedPreceding, -1
    slices = ranged.groupBy(*keys, "_slice").agg(F.sum("_weight").alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*earlier)
    offset = F.coalesce(F.sum("_total").over(across), F.lit(0))
    offsets = slices.select(group.alias("_group"), offset.alias("_offset"))
    within = Window.partitionBy("_group").orderBy(*order).rowsBetween(*earlier)
    inside = F.coalesce(F.sum("_weight").over(within), F.lit(0))
    return (
        ranged.withColumn("_group", group)
        .join(offsets, "_group")
        .withColumn(out, F.col("_offset") + inside)
        .drop("_weight", "_slice", "_group", "_offset")
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (group, value): how often it occurs and its average rank.

    Ties are counted before anything is sorted, so a value that fills a third
    of the table is a single row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    placed = running_total(counts, keys, [F.col(value)], "ties")
    return placed.select(*keys, value, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("avg_rank"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``avg_rank``: rank within the group, tied values sharing their mean rank."""
    ranks = value_ranks(df, keys, value).drop("ties")
    return df.join(ranks, [*keys, value], "left")


def dense_positions(df: DataFrame, columns: Sequence[Column], out: str = "ord") -> DataFrame:
    """Number the rows of a table with unique ``columns`` from 1 in that order."""
    placed = running_total(df, [], columns, out=out)
    return placed.withColumn(out, F.col(out) + 1)


def make_unique(df: DataFrame, label: str, order: str, out: str = "unique_label") -> DataFrame:
    """Tell equal labels apart: ``a``, ``a.1``, ``a.2`` in the given row order; NULL stays NULL.

    A suffix that some label already carries is skipped. The k-th repeat of a
    label takes the k-th whole number that is free, which is k plus the taken
    suffixes t_i (i-th smallest) with t_i - i < k.
    """
    placed = running_total(df, [label], [F.col(order)], out="_repeat")
    number = F.col("_repeat")
    repeats = placed.where((F.col("_repeat") > 0) & F.col(label).isNotNull())
    pattern = r"^(.*)[.]([1-9][0-9]*)$"
    base, digits = F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2)
    numbered = placed.select(label).where(F.col(label).rlike(pattern)).distinct()
    taken = numbered.select(base.alias("_base"), digits.try_cast("bigint").alias("_suffix")).where("_suffix IS NOT NULL")
    taken = sized(taken.join(repeats.select(F.col(label).alias("_base")), "_base", "left_semi"))
    if not taken.isEmpty():
        placed = placed.join(_skipped(taken, repeats, label), [label, "_repeat"], "left")
        number = number + F.coalesce("_skipped", F.lit(0))
    first = (F.col("_repeat") == 0) | F.col(label).isNull()
    unique = F.when(first, F.col(label)).otherwise(F.concat_ws(".", F.col(label), number.cast("string")))
    return placed.withColumn(out, unique).drop("_repeat", "_skipped")


def _skipped(taken: DataFrame, repeats: DataFrame, label: str) -> DataFrame:
    """(label, _repeat, _skipped): how many taken suffixes each repeat steps over.

    Only labels with a taken suffix are looked at. A taken suffix counts for a
    repeat when its mark lies before it, so at one place repeats sort first.
    """
    ranked = running_total(taken, ["_base"], [F.col("_suffix")], out="_i")
    marks = ranked.select(
        F.col("_base").alias(label),
        (F.col("_suffix") - F.col("_i") - 1).alias("_at"),
        F.lit(1).alias("_mark"),
        F.col("_i").alias("_tie"),
    )
    copies = repeats.join(taken.select(F.col("_base").alias(label)), label, "left_semi").select(
        label, F.col("_repeat").alias("_at"), F.lit(0).alias("_mark"), F.lit(0).cast("long").alias("_tie")
    )
    order = [F.col("_at"), F.col("_mark"), F.col("_tie")]
    shifted = running_total(marks.unionByName(copies), [label], order, "_mark", "_skipped")
    return shifted.where("_mark = 0").select(label, F.col("_at").alias("_repeat"), "_skipped")
