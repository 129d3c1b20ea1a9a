"""Suffix-array deduplication with a logarithmic family of indexes.

A byte is removed when a string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller doc_id, or earlier in the same document.

Indexes are sparse suffix arrays: of all suffixes only one per run of windows is
kept (see ``windows``), placed where content decides, so a match of ``length``
bytes always meets a kept suffix. Entries are pointers ordered by the fingerprint of the suffix's
anchor and then of its run; fingerprints keep an entry at a few bytes where the
suffix itself would take ``length``, and equal prefixes, which is all a duplicate
needs, stay neighbours.

The corpus comes in ``batches`` by doc_id. A new batch is sorted into an array of its
own and merge-scanned (a sort-merge join on the run) against every level of the
family; then it becomes level 0, and two arrays of the same level merge into one of
the next, so an entry is rewritten once per doubling. A scan finds equal runs, which
are removed as a whole. Runs that share an anchor but differ are neighbours in the
family's order; only those are looked at closer, first by runs of longer grams, then
by single windows. When the whole corpus is at hand, a sketch
first drops suffixes that provably have no partner.

Defined cases: a null text is empty; a null doc_id counts as smaller than any
other; rows with the same doc_id are one document, matched only by place; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm import windows as W
from abundia.llm.common import drop_table, id_or_least, saved

LENGTH = 100
GRAM = 32
BATCHES = 4
#: Windows that a gram of the second cut shares at most, less one.
FINER = 12
SPAN = ["id", "text_key", "start", "count"]


class SuffixFamily:
    """Levels of suffix arrays; level k holds 2 ** k batches."""

    def __init__(self) -> None:
        self.levels: list[DataFrame | None] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Add a batch whose ids follow those of all batches before; returns the spans of runs that were met before."""
        array = saved(entries.groupBy("run").agg(F.min("id").alias("owner")))
        known = entries.join(array, "run").withColumn("met", F.col("id") > F.col("owner"))
        for level in self.levels:
            if level is not None:
                before = level.select("run", F.lit(True).alias("before"))
                known = known.join(before, "run", "left").withColumn("met", F.col("met") | F.col("before").isNotNull()).drop("before")
        scanned = saved(known.select("anchor", "run", *SPAN, "met"))
        self._carry(scanned.where("NOT met").select("anchor", "run", *SPAN).dropDuplicates(["run"]))
        drop_table(array)
        return scanned.where("met").select(*SPAN)

    def unlike(self) -> DataFrame:
        """Spans of entries that share an anchor with a different run; every run has one entry in the family."""
        entries = _union([level for level in self.levels if level is not None])
        shared = entries.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
        return entries.join(shared, "anchor", "left_semi").select(*SPAN)

    def drop(self) -> None:
        """Delete the levels."""
        for level in self.levels:
            if level is not None:
                drop_table(level)

    def _carry(self, array: DataFrame) -> None:
        """Binary addition of arrays."""
        merged = []
        for k, level in enumerate(self.levels):
            if level is None:
                self.levels[k] = _sorted(array)
                break
            array, self.levels[k] = array.unionByName(level), None
            merged.append(level)
        else:
            self.levels.append(_sorted(array))
        for level in merged:
            drop_table(level)


def _sorted(array: DataFrame) -> DataFrame:
    """An array on disk: ranges of the order, each sorted."""
    return saved(array.select("anchor", "run", *SPAN).repartitionByRange("anchor", "run").sortWithinPartitions("anchor", "run"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(id, text_key, start, end): byte ranges to remove."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(W.repeat_sketch(docs, W.byte_tokens, length, gram, within=True))
    rows = saved(W.run_rows(docs, W.byte_tokens, length, gram, sketch))
    cuts = docs.select(F.percentile_approx(id_or_least(), [i / batches for i in range(1, batches)]).alias("c")).first()[0] or []
    family, whole, low = SuffixFamily(), [rows.where("again").select(*SPAN)], None
    for high in [*sorted(set(cuts)), None]:
        part = rows.where("NOT again")
        part = part if low is None else part.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        whole.append(family.add(part))
        low = high
    # unlike runs are cut into shorter ones by longer grams, and what is still unlike into windows
    finer = saved(W.sub_runs(docs, family.unlike(), W.byte_tokens, length, length - FINER))
    family.drop()
    owners = saved(finer.groupBy("run").agg(F.min(F.struct("id", "start")).alias("f"), F.min("anchor").alias("anchor"), F.count("*").alias("k")))
    after = "id > f.id OR (id = f.id AND start > f.start)"
    whole.append(finer.join(owners.where("k > 1").select("run", "f"), "run").where(after).select(*SPAN))
    shared = owners.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    split = owners.join(shared, "anchor", "left_semi").select("run", "f.id", "f.start")
    wanted = finer.join(split, ["run", "id", "start"], "left_semi").select(*SPAN)
    single = saved(W.single_windows(docs, wanted, W.byte_tokens, length))
    first = single.groupBy("w").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("k")).where("k > 1").select("w", "f")
    hits = single.join(first, "w").where(after).select("id", "text_key", "start", (F.col("start") + length).alias("end"))
    ranges = _union(whole).select("id", "text_key", "start", (F.col("start") + F.col("count") - 1 + length).alias("end"))
    found = saved(ranges.union(hits))
    for table in (rows, finer, owners, single):
        drop_table(table)
    return found


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the removed runs as flat (start, end) pairs, kept_sha256."""

    def run(parts):
        for batch in parts:
            out = [[] for _ in range(5)]
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                gone = W.removed_mask(len(raw), ranges)
                edges = np.zeros(0, np.int64)
                kept = raw
                if gone is not None:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = len(raw), len(raw) - len(kept), len(edges) // 2, edges.tolist(), hashlib.sha256(kept).hexdigest()
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"],
            )

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string"
    return W.with_spans(docs, spans(docs, length, gram, batches)).mapInArrow(run, kind)
