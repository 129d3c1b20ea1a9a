"""Written tables that cut lineage and give Catalyst true sizes.

A table written to the cluster's shared folder survives the loss of any
executor, and its file sizes let Spark decide by itself whether a side is
small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="abundia-")
    return _local_root


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back as a plain parquet table; the shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Materialise a side that is expected to be small before it meets a large table.

    Its true size is then known when the join is planned: below the session's
    broadcast threshold the large table is not shuffled at all, above it the
    join is a sort-merge join, whose hot partitions adaptive execution splits.
    """
    return saved(df)


def bounded_values(df: DataFrame, column: str, limit: int) -> list:
    """Sorted distinct values of a dimension that must stay below ``limit``.

    Used for site lists and covariate names only. More than ``limit`` values
    is an error, not a truncation.
    """
    rows = df.select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(row[0] for row in rows)


MAX_SMALL_ROWS = 10_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table from literal rows, marked for broadcast because its size is known here."""
    if len(rows) > MAX_SMALL_ROWS:
        raise ValueError(f"{len(rows)} literal rows are more than {MAX_SMALL_ROWS}; read them as a table")
    return F.broadcast(spark.createDataFrame(rows, schema))
