"""Substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words. A word is removed when a window that
covers it also starts in a document with a smaller doc_id.

First pass: every partition counts its windows, by anchor (see ``windows``), into
a sketch of two bits a cell; the merged sketch overestimates, so a window it calls
unique is unique. Second pass: only windows estimated repeated are grouped
exactly. They travel as runs of windows with a common anchor. Of equal runs the
smallest doc_id owns it and all others are removed as a whole; owners that share an
anchor with a different run are split into single windows, and those are grouped.

The sketch has a fixed size (8 MB as broadcast). On a corpus with far more anchors
than cells it filters less and the second pass grows towards all runs, which it
groups all the same: the result is exact at every load.

Defined cases: a null text has no words; a null doc_id counts as smaller than any
other; rows with the same doc_id are not compared with each other; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm import windows as W
from abundia.llm.common import drop_table, saved

WINDOW = 50
GRAM = 25


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, text_key, start, end): word ranges to remove."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(W.repeat_sketch(docs, W.word_tokens, window, gram, within=False))
    rows = saved(W.run_rows(docs, W.word_tokens, window, gram, sketch).drop("again"))
    owners = saved(rows.groupBy("run").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.min("anchor").alias("anchor")))
    whole = rows.join(owners.where("last > owner").select("run", "owner"), "run").where("id > owner")
    shared = owners.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    split = owners.join(shared, "anchor").select("run", F.col("owner").alias("id"))
    wanted = rows.join(split, ["run", "id"], "left_semi").select("id", "text_key", "start", "count")
    single = saved(W.single_windows(docs, wanted, W.word_tokens, window))
    first = single.groupBy("w").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("w", "first")
    hits = single.join(first, "w").where("id > first").select("id", "text_key", "start", (F.col("start") + window).alias("end"))
    ranges = whole.select("id", "text_key", "start", (F.col("start") + F.col("count") - 1 + window).alias("end"))
    found = saved(ranges.union(hits))
    for table in (rows, owners, single):
        drop_table(table)
    return found


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept text (words joined by one space), n_words, n_removed."""

    def run(batches):
        for batch in batches:
            texts, n, removed = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()  # bytes: exactly the six ASCII blanks
                gone = W.removed_mask(len(words), ranges)
                n.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                texts.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return W.with_spans(docs, spans(docs, window, gram)).mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")
