"""Standard transformations before ordination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.sources.scratch import sized


def hellinger(cells: DataFrame) -> DataFrame:
    """Square root of each cell's share of its site; a site without abundance gives 0."""
    totals = sized(cells.groupBy("site").agg(F.sum("abundance").alias("_total")))
    share = F.try_divide(F.col("abundance"), F.col("_total"))
    return cells.join(totals, "site").withColumn("abundance", F.sqrt(F.coalesce(share, F.lit(0.0)))).drop("_total")


def zscore(covariates: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, covariate, value, z) with the sample standard deviation; a constant column gives NULL."""
    long = covariates.unpivot([key], list(names), "covariate", "value")
    stats = sized(long.groupBy("covariate").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd")))
    z = F.try_divide(F.col("value") - F.col("_mean"), F.col("_sd"))
    return long.join(stats, "covariate").select(key, "covariate", "value", z.alias("z"))


def zscore_wide(covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """The covariate table with the named columns z-scored in place."""
    stats = covariates.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    scaled = {}
    for i, name in enumerate(names):
        mean, sd = stats[f"m{i}"], stats[f"s{i}"]
        scaled[name] = (F.col(name) - mean) / sd if sd else F.lit(None).cast("double")
    return covariates.withColumns(scaled)
