"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its texts into one run: digests in order, with the number
of rows and the extreme identifiers of each. In round r the runs of ``fan`` ** r
neighbouring partitions meet: Spark's sort merges the incoming runs and a linear
scan folds equal digests, so a digest that half of all rows share has one row per
run from the first round on. A run is dealt by ranges of the digest, so no task
ever holds a whole run. After the last round one run is left, and every row finds
its group in it.

Two rows count as equal when SHA-256, a second digest of another family and the
byte length all agree, at every level; the kept identifier is retained only for
such verified groups.

Defined cases: null text counts as empty; empty texts form one group; a null
doc_id is kept only where the group has no other id; rows that repeat with the
same doc_id are one group, and the row that stays is told by its id, so all
repeated rows of that id are kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.llm.common import saved

RUN = "part long, slice int, digest string, check long, size long, rows long, keep long"
KEY = ["digest", "check", "size"]


def _digest() -> list[Column]:
    """The id and the verified digest of a row's text."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id").cast("long"), F.sha2(text, 256), F.xxhash64(text), F.octet_length(text).cast("long")]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the verified digest of each text."""
    return docs.select(*[expr.alias(name) for name, expr in zip(["doc_id", *KEY], _digest())])


def fold(largest: bool):
    """Scan rows sorted by (part, slice, digest, ...) and join equal neighbours, also across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # by name and type alone: Spark's columns may be marked as never null, the row carried over is not
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for name in ("part", "slice", "digest", "check", "size"):
                column = table[name].chunk(0)
                new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            keep, known = table["keep"].chunk(0), ~np.asarray(table["keep"].chunk(0).is_null())
            worst = np.int64(-(1 << 63)) if largest else np.int64((1 << 63) - 1)
            ids = np.where(known, keep.fill_null(0).to_numpy(), worst)
            best = (np.maximum if largest else np.minimum).reduceat(ids, first)
            seen = np.maximum.reduceat(known, first)
            out = table.take(pa.array(first)).select(["part", "slice", "digest", "check", "size"])
            out = out.append_column("rows", pa.array(np.add.reduceat(table["rows"].to_numpy(), first)))
            out = out.append_column("keep", pa.array(best, mask=~seen)).combine_chunks()
            done = out.num_rows - 1
            if done:
                yield from out.slice(0, done).to_batches()
            held = out.slice(done).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return run


def runs(rows: DataFrame, parts: int, largest: bool) -> DataFrame:
    """Merge the rows of equal (part, slice) into sorted runs."""
    order = ["part", "slice", *KEY]
    dealt = rows.repartition(parts, "part", "slice") if parts else rows
    return dealt.sortWithinPartitions(*order).mapInArrow(fold(largest), RUN)


def merged_run(keyed: DataFrame, largest: bool = False, fan: int = 8) -> DataFrame:
    """One row per verified digest: rows, keep. Binomial rounds over the partitions."""
    spark = keyed.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_of = F.pmod(F.conv(F.substring("digest", 1, 6), 16, 10).cast("long"), F.lit(wide)).cast("int")
    first = keyed.select(
        F.spark_partition_id().cast("long").alias("part"), slice_of.alias("slice"), *KEY, F.lit(1).cast("long").alias("rows"), F.col("doc_id").alias("keep")
    )
    level = saved(runs(first, 0, largest))
    left = (level.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        step = level.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        level, left = saved(runs(step, wide, largest)), -(-left // fan)
    return level.select(*KEY, "rows", "keep")


def groups(docs: DataFrame, largest: bool = False) -> DataFrame:
    """Per row: doc_id, digest, keep_id, group_size, kept."""
    keyed = digests(docs)
    index = merged_run(keyed, largest).select(*KEY, F.col("rows").alias("group_size"), F.col("keep").alias("keep_id"))
    return keyed.join(index, KEY).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def dedup(docs: DataFrame, largest: bool = False) -> DataFrame:
    """The rows that stay, with all their columns."""
    # the row travels as one column, so no name of its own can clash
    keyed = docs.select(
        F.struct("*").alias("row"), *[expr.alias(name) for name, expr in zip(["id", *KEY], _digest())]
    )
    index = merged_run(digests(docs), largest).drop("rows")
    return keyed.join(index, KEY).where(F.col("id").eqNullSafe(F.col("keep"))).select("row.*")
