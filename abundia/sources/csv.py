"""CSV scan and sink. A header is matched by position to a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """Read headed CSV files; ``NA`` is NULL and a leading BOM is dropped.

    Without a schema all columns arrive as text, so that no inference pass
    over the data is needed; ``numeric`` then parses the ones wanted.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.withColumnsRenamed(rename or {})


def read_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Concatenate files by column name; a column one file lacks is NULL there."""
    if schema is not None:
        return read_csv(spark, paths, schema)
    first, *rest = [read_csv(spark, path) for path in paths]
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parse text columns as doubles; text that is no number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns})


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result table as parquet or headed CSV, one file per task."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(kind).save(path)


def abundance_from_wide(df: DataFrame, entity: str, sites: Sequence[str]) -> DataFrame:
    """Turn a wide abundance sheet into the long (entity, site, abundance) table.

    Abundance is non-null by contract: a NULL cell stops the query.
    """
    cell = F.when(F.col("abundance").isNull(), F.raise_error(F.lit("abundance must not be NULL")))
    return (
        df.unpivot([entity], list(sites), "site", "abundance")
        .withColumnRenamed(entity, "entity")
        .withColumn("abundance", cell.otherwise(F.col("abundance").cast("double")))
    )
