"""Filling missing covariates: by mean and mode, or by iterated random forests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundia.sources.scratch import saved

#: Rows of the table that one task grows trees on.
ROWS_PER_TASK = 4096


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def impute_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill numbers with the column mean and text with the most frequent value (ties: first in text order)."""
    numbers = [c for c in columns if not _is_text(df, c)]
    fill = df.agg(*[F.avg(c).alias(c) for c in numbers]).first().asDict() if numbers else {}
    for column in columns:
        if column not in fill:
            counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
            top = counts.agg(F.min(F.struct(-F.col("count"), F.col(column).alias("v"))).alias("top")).first()["top"]
            fill[column] = top and top["v"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def impute_forest(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    max_iter: int = 10,
    trees: int = 100,
    depth: int = 8,
    seed: int = 82,
) -> DataFrame:
    """Fill missing cells by forests trained on the other columns, in repeated passes.

    Starts from mean and mode. Each pass refits one forest per column that has
    missing cells, fewest first, on the rows where it is known, and replaces
    the missing cells by its predictions. Passes stop when the change of the
    filled cells shrinks no more, of numbers nor of text, and the table before that pass is returned; observed
    cells are never touched. The trees of a forest are grown by Spark over the
    whole table; only the loop over columns runs on the driver.
    """
    *empty, rows = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)) for c in columns], F.count("*")).first()
    missing = dict(zip(columns, empty))
    order = sorted((c for c in columns if missing[c]), key=lambda c: (missing[c], c))
    if not order:
        return df
    holes = {f"_hole_{i}": F.col(c).isNull() for i, c in enumerate(order)}
    marked = df.withColumns(holes)
    tasks = math.ceil(rows / ROWS_PER_TASK)
    current = saved(_dealt(impute_baseline(marked, columns), key, tasks))
    best, last = current, None
    for _ in range(max_iter):
        filled = current
        for i, target in enumerate(order):
            others = [c for c in columns if c != target]
            filled = saved(_refit(filled, key, target, f"_hole_{i}", others, trees, depth, seed, tasks))
        change = _change(current, filled, key, order)
        if last is not None and settled(change, last):
            break
        best, current, last = filled, filled, change
    return best.drop(*holes)


def settled(change: Sequence[float | None], last: Sequence[float | None]) -> bool:
    """Whether no kind of change, numbers or text, is smaller than in the pass before."""
    return not any(c < l for c, l in zip(change, last) if c is not None and l is not None)


def _dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows dealt by key to so many tasks, in the same order each time, since trees draw rows by place.

    A forest is grown by as many tasks as its table has partitions, and few files come as one.
    """
    return df.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else df


def _refit(
    df: DataFrame, key: str, target: str, hole: str, others: Sequence[str], trees: int, depth: int, seed: int, tasks: int
) -> DataFrame:
    """Replace the holes of one column by the predictions of a forest fitted on the rest.

    Text features enter as their rank by frequency, for any number of values.
    """
    columns = df.columns
    for c in [c for c in others if _is_text(df, c)]:
        index = StringIndexer(inputCol=c, outputCol=f"_ix_{c}", handleInvalid="keep").fit(df)
        # adding 0 turns the index into a plain number, so its values need no bins of their own
        df = index.transform(df).withColumn(f"_ix_{c}", F.col(f"_ix_{c}") + 0.0)
    inputs = [f"_ix_{c}" if _is_text(df, c) else c for c in others]
    stages = [VectorAssembler(inputCols=inputs, outputCol="_features")]
    known = _dealt(df.where(~F.col(hole)), key, tasks)
    options = dict(featuresCol="_features", predictionCol="_guess", numTrees=trees, maxDepth=depth, seed=seed, maxBins=128)
    if _is_text(df, target):
        index = StringIndexer(inputCol=target, outputCol="_label", handleInvalid="keep").fit(known)
        stages += [
            index,
            RandomForestClassifier(labelCol="_label", probabilityCol="_prob", rawPredictionCol="_raw", **options),
            IndexToString(inputCol="_guess", outputCol="_text", labels=index.labels),
        ]
        guess = F.col("_text")
    else:
        stages.append(RandomForestRegressor(labelCol=target, **options))
        guess = F.col("_guess")
    model = Pipeline(stages=stages).fit(known)
    predicted = model.transform(df)
    return predicted.withColumn(target, F.when(F.col(hole), guess).otherwise(F.col(target))).select(*columns)


def _change(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> tuple[float | None, float | None]:
    """Relative squared change of the filled numbers, and share of filled text that changed."""
    numbers = [c for c in columns if not _is_text(before, c)]
    texts = [c for c in columns if _is_text(before, c)]
    old = before.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    both = after.join(old, key)
    moved, scale = F.lit(0.0), F.lit(0.0)
    for c in numbers:
        moved = moved + F.pow(F.col(c) - F.col(f"_old_{c}"), 2)
        scale = scale + F.pow(F.col(c), 2)
    swapped = F.lit(0)
    for c in texts:
        swapped = swapped + (F.col(c) != F.col(f"_old_{c}")).cast("int")
    row = both.agg(F.sum(moved).alias("m"), F.sum(scale).alias("s"), F.sum(swapped).alias("t"), F.count("*").alias("n")).first()
    numeric = row["m"] / row["s"] if numbers and row["s"] else None
    text = row["t"] / (row["n"] * len(texts)) if texts and row["n"] else None
    return numeric, text


def masked_error(truth: DataFrame, filled: DataFrame, holes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Root mean squared error per column over the cells listed as (key, column) in ``holes``."""
    known = truth.unpivot([key], list(columns), "column", "truth")
    guess = filled.unpivot([key], list(columns), "column", "guess")
    hidden = known.join(holes.select(key, "column"), [key, "column"], "left_semi").join(guess, [key, "column"])
    return hidden.groupBy("column").agg(F.sqrt(F.avg(F.pow(F.col("guess") - F.col("truth"), 2))).alias("rmse"))
